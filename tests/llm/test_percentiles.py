"""Multi-select against sorting, and the bound of combined figures."""

import math
import random
from collections import defaultdict

import pytest

from talea.llm import percentiles as p
from talea.llm.queries import QUERIES, SQL
from tests.compare import same

BP = (0, 1, 5000, 9000, 9999, 10000)


@pytest.mark.parametrize("name", ["p1_percentiles", "p1_spans"])
def test_same_as_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck, SQL[name])


def test_equals_sorting(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.randrange(-50, 50), rnd.randrange(-(2**62), 2**62)]), "clash") for _ in range(800)]
    rows += [("one", 7, ""), ("ties", 3, "")] * 1 + [("ties", 3, "")] * 50 + [("nulls", None, ""), ("a", None, ""), ("deep", -(2**63) + 1, ""), ("deep", 2**63 - 1, "")]
    df = spark.createDataFrame(rows, "s string, x bigint, lo string").repartition(7)
    by = defaultdict(list)
    for s, x, _ in rows:
        if x is not None:
            by[s].append(x)
    want = {(s, b): (len(v), sorted(v)[max(1, math.ceil(b * len(v) / 10000)) - 1]) for s, v in by.items() for b in BP}
    got = {(r.s, r.bp): (r.n, r.value) for r in p.percentiles(df, ["s"], "x", BP).collect()}
    assert got == want


def test_empty_table_and_equal_values(spark):
    df = spark.createDataFrame([], "s string, x int")
    assert p.percentiles(df, ["s"], "x", BP).count() == 0
    same_value = spark.range(300).selectExpr("'g' as s", "5 as x")
    assert {r.value for r in p.percentiles(same_value, ["s"], "x", BP).collect()} == {5}


@pytest.mark.parametrize("days, points", [([1, 3, 150, 400, 2, 77], 20), ([1000], 100), ([101, 99, 100], 100), ([37] * 9, 10)])
def test_combined_days_keep_their_bound(spark, days, points):
    rnd = random.Random(sum(days))
    values = {d: [int(rnd.lognormvariate(3 + d / 3, 1) * 10) for _ in range(n)] for d, n in enumerate(days)}
    if days == [1000]:
        values = {0: list(range(1000))}
    df = spark.createDataFrame([("s", d, v) for d, vs in values.items() for v in vs], "s string, d int, x bigint")
    out = p.combined(p.summary(df, ["s", "d"], "x", points), ["s"], (100, 1000, 4910, 5000, 9500, 10000)).collect()
    everything = sorted(v for vs in values.values() for v in vs)
    n = len(everything)
    for r in out:
        assert r.n == n and r.rank <= r.rank_high <= r.rank + n / points
        assert everything[r.rank - 1] <= r.value <= everything[min(r.rank_high, n) - 1]


def test_proposals_are_weighted_medians():
    def frame(rows, at):
        return p.pd.DataFrame([dict(zip(("rid", "v"), r)) | dict.fromkeys(p.PIVOTS, at) | {"p1": 3} for r in rows])

    said = p._said(frame([(1, v) for v in (5, 1, 9, 3, 3, 3, 7, 2, 8)], 8))
    assert [tuple(r) for r in said[["rid", "slot", "n", "lo", "hi", "p4"]].itertuples(index=False)] == [(1, 0, 2, 1, 2, 1), (1, 1, 3, 3, 3, 3), (1, 2, 2, 5, 7, 5), (1, 3, 1, 8, 8, 8), (1, 4, 1, 9, 9, 9)]
    assert p._said(frame([(2, 4)], 4))["slot"].tolist() == [3]
    a = p.pd.DataFrame({"rid": [7, 7, 7], "slot": [0, 0, 0], "n": [1, 5, 2], "lo": [4, 1, 9], "hi": [4, 6, 9]} | {c: [4, k, 9] for k, c in enumerate(p.PIVOTS)})
    assert p._joined([a[:1], a[1:]]).iloc[0].tolist() == [7, 0, 8, 1, 9, 0, 1, 2, 3, 4, 5, 6]
