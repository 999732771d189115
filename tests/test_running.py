"""Running sums over ranges, percentiles by counts, and what is built on them, against loops."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talea.operators import streams
from talea.operators.running import percentiles, running


def test_running_equals_a_loop(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), i, i // 7, rnd.choice([None, rnd.randrange(-5, 9)])) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, t int, p int, v int")
    want, state = {}, defaultdict(lambda: (0, None))
    for g, t, _, v in rows:
        s, m = state[g]
        state[g] = s + (v or 0), v if m is None else m if v is None else max(m, v)
        want[t] = state[g]
    assert {r.t: (r.s, r.m) for r in running(df, ["g"], "p", ["t"], {"s": "v"}, {"m": "v"}).collect()} == want
    assert running(df.limit(0), ["g"], "p", ["t"], {"s": "v"}).count() == 0


def test_percentiles_equal_numpy(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([rnd.uniform(-1e6, 1e6), float(rnd.randrange(-3, 4)), 1e-9])) for g in ("a", "b", "one")[:2] for _ in range(301)] + [("one", 5.0), ("null", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    got = {r.g: r for r in percentiles(df, ["g"], "v", {"med": 0.5, "p99": 0.99, "top": 1.0}).collect()}
    assert set(got) == set(by)
    for g, vs in by.items():
        assert (got[g].n, got[g].least, got[g].most) == (len(vs), min(vs), max(vs))
        for name, q in (("med", 50), ("p99", 99), ("top", 100)):
            assert got[g][name] == pytest.approx(np.percentile(vs, q))
    whole = percentiles(df, [], "v", {"med": 0.5}).first()
    assert whole.med == pytest.approx(np.median([v for _, v in rows if v is not None])) and percentiles(df.limit(0), [], "v", {"med": 0.5}).count() == 0


@pytest.mark.parametrize("part", [10, 1000])
def test_batches_over_ranges_of_time(spark, part):
    """Batches that cross the ranges, gaps longer than a range, ties in time."""
    rnd = random.Random(part)
    t, rows = 0, []
    for i in range(200):
        t += rnd.choice([0, 1, 2, 30])
        rows.append(("g", t, i))
    got = {r.id: r.batch for r in streams.flush_batches(spark.createDataFrame(rows, "g string, us bigint, id int"), "g", "us", "id", 4, 25, part).collect()}
    batch, held, last, want = 0, 0, None, {}
    for _, t, i in rows:
        if last is None or held == 4 or t - last >= 25:
            batch, held = batch + 1, 0
        held, last = held + 1, t
        want[i] = batch
    assert got == want


def test_in_flight_over_ranges_of_time(spark):
    rows = [("g", 0, 35), ("g", 5, 12), ("g", 12, 50), ("g", 20, 21)]
    got = streams.in_flight(spark.createDataFrame(rows, "g string, a bigint, b bigint"), "g", F.col("a"), F.col("b"), 10).collect()
    assert sorted((r.us, r.in_flight) for r in got) == [(0, 1), (5, 2), (12, 2), (20, 3), (21, 2), (35, 1), (50, 0)]


def test_shed_requests_take_no_place(spark):
    rows = [("g", 0, 10), ("g", 1, 10), ("g", 2, 3), ("g", 10, 20), ("g", 10, 20), ("h", 0, 1)]
    got = streams.shed(spark.createDataFrame(rows, "g string, a bigint, b bigint"), "g", "a", "b", 2).collect()
    assert sorted((r.g, r.a, r.let_in) for r in got) == [("g", 0, True), ("g", 1, True), ("g", 2, False), ("g", 10, True), ("g", 10, True), ("h", 0, True)]
