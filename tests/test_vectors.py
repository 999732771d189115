"""Vectors over metric samples on small cases."""

from pyspark.sql import functions as F

from talea.operators import vectors as v
from talea.sources.metrics import relabelled


def samples(spark, *rows):
    df = spark.createDataFrame([(m, labels, t, float(x)) for m, labels, t, x in rows], "metric string, labels map<string,string>, t bigint, value double")
    return df.withColumn("series", F.to_json("labels"))


def test_matchers_sums_and_matches(spark):
    s = samples(spark, *[("up", {"job": j, "i": i}, t, x) for j, i, t, x in (("a", "1", 0, 1), ("a", "2", 0, 0), ("ab", "1", 0, 1), ("a", "1", 60, 1))], ("other", {}, 0, 9))
    up = v.instant(s, "up", "job", job="a|x")
    assert sorted((r.t, r.value) for r in v.aggregated(up.where("value = 1"), F.count("value")).collect()) == [(0, 1), (60, 1)]
    by = v.aggregated(v.instant(s, "up", "job"), F.sum("value"), "job")
    assert sorted((r.job, r.t, r.value) for r in by.collect()) == [("a", 0, 1.0), ("a", 60, 1.0), ("ab", 0, 1.0)]
    total, other = v.aggregated(by, F.sum("value")), v.aggregated(v.instant(s, "other"), F.sum("value"))
    assert [tuple(r) for r in v.matched(total, other, F.col("a") + F.col("b")).collect()] == [(0, 11.0)]
    assert sorted(tuple(r) for r in v.or_zero(other, total).collect()) == [(0, 9.0), (60, 0.0)]
    assert [(r.job, r.place) for r in v.top(by.where("t = 0"), 1, ["job"]).collect()] == [("a", 1)]


def test_one_number_or_none(spark):
    s = samples(spark, ("x", {"a": "1"}, 0, 5), ("x", {"a": "1"}, 60, 7), ("n", {}, 60, float("nan")))
    assert v.scalar(v.instant(s, "x")).first().value == 7.0 and v.scalar(v.instant(s, "x"), 0).first().value == 5.0
    assert v.scalar(v.instant(s, "n")).collect()[0].value is None and v.scalar(v.instant(s, "none")).collect()[0].value is None


def test_quantile_of_rates_forgets_what_was_before(spark):
    """All old observations are slow, all in the range are fast; a restart lies in between."""
    rows = []
    for le, counts in (("1.0", [0, 0, 4, 8]), ("2.0", [50, 50, 4, 8]), ("+Inf", [50, 50, 4, 8])):
        rows += [("h", {"le": le}, t * 60, c) for t, c in enumerate(counts)]
    got = {r.t: r.value for r in v.quantile_of_rates(samples(spark, *rows), "h", 0.5, 120).collect()}
    assert got[180] == 0.5 and got[0] is None


def test_relabelling(spark):
    df = spark.createDataFrame([("/app-1",), ("app-1",), ("/x-app-1",), ("/pg-",), (None,)], "p string")
    assert [r.n for r in df.select(relabelled(F.col("p")).alias("n")).collect()] == ["app-1", None, None, "pg-", None]
