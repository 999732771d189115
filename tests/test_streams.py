"""Stream operators, on recorded events and as streams; time series on small cases."""

import json
import time
from collections import OrderedDict

from pyspark.sql import functions as F

from talea.operators import diagnostics, streams, telemetry
from talea.streaming import folds, pipes


def test_idle_gap_and_size_end_a_batch(spark):
    us = [0, 249, 499, 748, 1000, 1001, 1002]
    df = spark.createDataFrame([("s", t * 1000, i) for i, t in enumerate(us)], "g string, us bigint, id int")
    got = [r.batch for r in streams.flush_batches(df, "g", "us", "id", 2, 250_000).orderBy("id").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4]


def test_bounded_dedupe_equals_a_loop(spark):
    ids = [i * 7 % 13 for i in range(200)]
    known, want = OrderedDict(), []
    for i in ids:
        want.append(i not in known)
        if i not in known:
            known[i] = 1
            if len(known) > 5:
                known.popitem(last=False)
    df = spark.createDataFrame([("g", n, str(i)) for n, i in enumerate(ids)], "g string, n int, id string")
    assert [r.fresh for r in streams.bounded_dedupe(df, "g", ["n"], "id", 5).orderBy("n").collect()] == want


def test_rate_limit_window_begins_at_the_first_request(spark):
    s = 1_000_000
    df = spark.createDataFrame([("a", t) for t in (5 * s, 6 * s, 7 * s, 15 * s - 1, 15 * s, 16 * s)] + [("b", 0), (None, 1)], "k string, us bigint")
    got = [r.allowed for r in streams.rate_limited(df, "k", "us", 0, 2).where("k = 'a'").orderBy("us").collect()]
    # a limit of 2 in a window of 1 s
    assert got == [True] * 6
    got = [r.allowed for r in streams.rate_limited(df, "k", "us", 1, 10).orderBy("k", "us").collect()]
    assert all(got)
    burst = spark.createDataFrame([("a", t) for t in range(5)], "k string, us bigint")
    assert [r.allowed for r in streams.rate_limited(burst, "k", "us", 1, 3).orderBy("us").collect()] == [True, True, True, False, False]


def test_breaker(spark):
    calls = [(0, True), (1, True), (2, False), (40, True), (41, False), (50, False), (80, False), (81, False)]
    df = spark.createDataFrame([("d", t * 1_000_000, bad) for t, bad in calls], "d string, us bigint, bad boolean")
    out = streams.breaker_states(df, "d", "us", "bad", threshold=2, recovery_us=30_000_000, probes=1, successes=1).orderBy("us").collect()
    assert [(r.admitted, r.state) for r in out] == [(True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_notifications(spark):
    p = {"from_account": "ACC_0000001", "to_account": "ACC_0000002", "amount": "12.34", "currency": "IDR", "reference_id": "ref-1"}
    bodies = [p, {k: v for k, v in p.items() if k != "reference_id"}, {k: v for k, v in p.items() if k != "to_account"}]
    df = spark.createDataFrame([(str(i), "transactions.committed", json.dumps(b)) for i, b in enumerate(bodies)] + [("8", "other", json.dumps(p)), ("9", "transactions.committed", "no json")], "id string, name string, payload string").withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.id: (r.recipient, r.summary) for r in streams.notifications(df).collect()}
    assert got == {"0": ("ACC_0000002", "Received 12.34 IDR from ACC_0000001 (ref ref-1)"), "1": ("ACC_0000002", "Received 12.34 IDR from ACC_0000001")}


def test_counter_restart_and_rate(spark):
    df = spark.createDataFrame([("s", t, v) for t, v in ((10, 5.0), (20, 8.0), (30, 2.0), (40, 2.0))], "s string, t bigint, value double")
    assert [r.delta for r in telemetry.increases(df, ["s"]).orderBy("t").collect()] == [0.0, 3.0, 2.0, 0.0]
    assert [r.rate for r in telemetry.rate(df, ["s"], 20).orderBy("t").collect()] == [0.0, 3 / 20, 5 / 20, 2 / 20]
    assert telemetry.extrapolated_rate(df, ["s"], 20).orderBy("t").collect()[0].rate is None


def test_histogram_quantile(spark):
    inf = float("inf")
    b = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 20), ("a", inf, 20), ("e", 1.0, 0), ("e", inf, 0), ("i", 1.0, 0), ("i", inf, 4)], "s string, le double, n bigint")
    got = {r.s: r.quantile for r in telemetry.histogram_quantile(b, ["s"], 0.75).collect()}
    assert got == {"a": 1.5, "e": None, "i": 1.0}


def test_alert_needs_an_unbroken_span(spark):
    df = spark.createDataFrame([("s", t, v) for t, v in ((0, 1), (60, 1), (120, 1), (180, 0), (240, 1), (300, None), (360, 1))], "s string, t bigint, v int")
    got = telemetry.held(df, ["s"], F.col("v") > 0, 120).collect()
    assert [(r.since, r.until, r.firing_from) for r in got] == [(0, 120, 120)]
    assert telemetry.held(df.limit(0), ["s"], F.col("v") > 0, 120).count() == 0


def test_blocking(spark):
    act = spark.createDataFrame([(1, "Lock", "tuple", "a  b", "active", [2, 3]), (2, None, None, "c\nd", "idle", None), (4, "Lock", None, "x", "active", [])], "pid int, wait_event_type string, wait_event string, query string, state string, blocked_by array<int>")
    assert [tuple(r) for r in diagnostics.blocking(act).collect()] == [(1, "tuple", "a b", 2, "idle", "c d")]


def _feed(tmp_path, name, lines):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.txt").write_text("\n".join(lines))
    return str(folder)


def test_stream_takes_each_message_once(spark, tmp_path):
    message = lambda r, a="1.00": json.dumps({"from_account": "A", "to_account": "B", "amount": a, "currency": "IDR", "reference_id": r})
    folder = _feed(tmp_path, "a", [message("1"), message("2"), message("1"), "no json", message(None), message("3", "-1")])
    out = str(tmp_path / "out")

    def run():
        good = pipes.routed(pipes.queue(spark, folder, 1)).where("reject_reason is null")
        keyed = good.select(F.get_json_object("body", "$.reference_id").alias("reference_id"), "body")
        q = pipes.once(keyed, out, str(tmp_path / "ck"), ["reference_id"]).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.reference_id for r in spark.read.parquet(out).collect())

    assert run() == ["1", "2"]
    _feed(tmp_path, "b", [message("2"), message("4")])
    assert run() == ["1", "2", "4"]


def test_stream_fold_keeps_its_state(spark, tmp_path):
    folder = _feed(tmp_path, "a", [f"g,{i},{i % 3}" for i in range(5)])
    parts = lambda: F.split("body", ",")

    def run(name):
        events = pipes.queue(spark, folder, 1).select(parts()[0].alias("g"), parts()[1].cast("int").alias("n"), parts()[2].alias("id"))
        q = folds.stream_fold(events, ["g"], ["n"], streams.dedupe_step("id", 10), dict, "fresh boolean").writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {r.n: r.fresh for r in spark.read.parquet(str(tmp_path / "o")).collect()}

    assert run("a") == {0: True, 1: True, 2: True, 3: False, 4: False}
    _feed(tmp_path, "b", ["g,9,2", "g,10,7"])
    assert run("b") | {} == {0: True, 1: True, 2: True, 3: False, 4: False, 9: False, 10: True}


def test_stream_batches_by_size_and_by_silence(spark, tmp_path):
    folder = _feed(tmp_path, "a", [f"g,{i}" for i in range(7)])
    events = pipes.queue(spark, folder, 1).select(F.split("body", ",")[0].alias("g"), F.split("body", ",")[1].alias("id"))
    q = folds.stream_batches(events, "g", "id", 3, 500).writeStream.format("memory").queryName("batches").outputMode("append").trigger(processingTime="200 milliseconds").start()
    got = []
    try:
        for _ in range(60):
            got = sorted((r.batch, r.n) for r in spark.sql("select * from batches").collect())
            if len(got) == 3:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert got == [(1, 3), (2, 3), (3, 1)]


def test_each_subscriber_gets_everything(spark, tmp_path):
    folder = _feed(tmp_path, "a", ["x", "y", "z"])
    to = lambda name: lambda s: s.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True)
    started = pipes.fan_out(pipes.queue(spark, folder, 1), {"one": to("one"), "two": lambda s: to("two")(s.where("body <> 'y'"))})
    for q in started.values():
        q.awaitTermination(120)
    assert {n: sorted(r.body for r in spark.read.parquet(str(tmp_path / n)).collect()) for n in started} == {"one": ["x", "y", "z"], "two": ["x", "z"]}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    row = lambda minute, kind: f"2024-01-01T00:{minute:02d}:00Z,{kind}"
    folder = _feed(tmp_path, "a", [row(1, "k"), row(2, "k"), row(7, "k")])
    cut = F.split("body", ",")
    made = lambda: folds.windowed_counts(pipes.queue(spark, folder, 1).select(cut[0].cast("timestamp").alias("at"), cut[1].alias("kind")), "at", ["kind"], "10 minutes", "5 minutes")

    def run():
        q = made().writeStream.format("parquet").option("path", str(tmp_path / "w")).option("checkpointLocation", str(tmp_path / "cw")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.window_start.minute, r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "w")).collect())

    run()
    _feed(tmp_path, "b", [row(30, "k")])
    run()
    _feed(tmp_path, "c", [row(1, "k"), row(31, "k")])  # the first is too late
    assert run() == [(0, "k", 2), (5, "k", 1)]
