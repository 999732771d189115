"""Operators over vectors: the values of many series at each scrape.

A vector has a column for each label it keeps, the time ``t`` and ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talea.operators import telemetry


def instant(samples: DataFrame, metric: str, *labels: str, **matchers: str) -> DataFrame:
    """The series of a metric as a vector with ``series`` and the given labels; ``matchers`` must match a label as a whole."""
    found = samples.where(F.col("metric") == metric)
    for name, pattern in matchers.items():
        found = found.where(F.col("labels")[name].rlike(rf"\A(?:{pattern})\z"))
    return found.select("series", *[F.col("labels")[x].alias(x) for x in labels], "t", "value")


def rate(samples: DataFrame, metric: str, seconds: int, *labels: str, **matchers: str) -> DataFrame:
    """Increase by the second over ``seconds``, restarts allowed for, per series."""
    found = instant(samples, metric, *labels, **matchers)
    return telemetry.rate(found, ["series", *labels], seconds).withColumnRenamed("rate", "value")


def aggregated(vector: DataFrame, how: Column, *by: str) -> DataFrame:
    """``how`` over the values at each time, by the labels named; a time without values has no row."""
    return vector.groupBy(*by, "t").agg(how.alias("value"))


def matched(left: DataFrame, right: DataFrame, value: Column, *on: str) -> DataFrame:
    """Two vectors combined where their labels and times are equal; ``value`` refers to ``a`` and ``b``."""
    both = left.withColumnRenamed("value", "a").join(right.withColumnRenamed("value", "b"), [*on, "t"])
    return both.select(*on, "t", value.alias("value"))


def or_zero(vector: DataFrame, spine: DataFrame) -> DataFrame:
    """A vector without labels, with 0 at the times of the spine at which it has no value."""
    return spine.select("t").distinct().join(vector, "t", "left").select("t", F.coalesce("value", F.lit(0.0)).alias("value"))


def scalar(vector: DataFrame, t: int | None = None) -> DataFrame:
    """``value``, one row: that of the first series at ``t`` (the last time there is, if not given); null if there is none or it is no number."""
    at = vector if t is None else vector.where(F.col("t") == t)
    order = [F.desc("t"), *[c for c in vector.columns if c not in ("t", "value")]]
    first = at.orderBy(*order).limit(1).select(F.when(~F.isnan("value"), F.col("value")).alias("value"))
    return first.agg(F.first("value").alias("value"))


def quantile_of_rates(samples: DataFrame, metric: str, q: float, seconds: int, *by: str) -> DataFrame:
    """The quantile of a histogram over ``seconds``: rates of its buckets, summed by bound and labels, then interpolated.

    Increases take the place of rates, of which they are a fixed multiple: their sums are exact.
    """
    r = rate(samples, metric, seconds, "le", *by).withColumn("value", F.round(F.col("value") * seconds))
    le = F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.col("le").try_cast("double"))
    sums = r.groupBy(*by, "t", le.alias("le")).agg(F.sum("value").alias("n"))
    return telemetry.histogram_quantile(sums, [*by, "t"], q).withColumnRenamed("quantile", "value")


def top(vector: DataFrame, k: int, labels: Sequence[str]) -> DataFrame:
    """The ``k`` greatest values at each time with ``place``; ties by the labels."""
    nth = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("value"), *labels))
    return vector.withColumn("place", nth).where(F.col("place") <= k)
