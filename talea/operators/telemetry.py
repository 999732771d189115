"""Time-series operators over counters, gauges and histograms.

Samples are rows of a series (its label columns), a time ``t`` in seconds and
a value. Samples are few against the events behind them: a series has one per
scrape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talea.operators.running import percentiles

# Bounds of the latency buckets in seconds, and the objectives.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
BUDGET, FAST_BURN, SLOW_BURN, UNDER_SLO = 0.001, 14.4, 6.0, 0.95


def tick(us: str, step: int) -> Column:
    """The first scrape, every ``step`` s, that sees an event."""
    return (F.floor(F.col(us) / (step * 1_000_000)) + 1).cast("bigint") * step


def scraped(events: DataFrame, labels: Sequence[str], us: str, step: int, life: int) -> DataFrame:
    """``labels, t, value``: counters of events as scrapes every ``step`` s see them; they restart every ``life`` s.

    Events are counted per series and scrape before anything is gathered.
    """
    return accumulated(events.groupBy(*labels, tick(us, step).alias("t")).agg(F.count("*").alias("c")), labels, step, life)


def accumulated(counts: DataFrame, labels: Sequence[str], step: int, life: int) -> DataFrame:
    """``labels, t, value``: counters from what is added (``c``) by each scrape ``t``.

    A series lasts from its first to its last addition; scrapes without one
    repeat the value.
    """
    span = counts.groupBy(*labels).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = span.select(*labels, F.explode(F.sequence("a", "b", F.lit(step).cast("bigint"))).alias("t"))
    filled = grid.join(counts, [*labels, "t"], "left").select(*labels, "t", F.coalesce("c", F.lit(0)).alias("c"))
    run = Window.partitionBy(*labels, F.floor((F.col("t") - 1) / life)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(*labels, "t", F.sum("c").over(run).cast("double").alias("value"))


def increases(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Samples with ``delta`` since the sample before; after a restart the new value itself."""
    before = F.lag("value").over(Window.partitionBy(*labels).orderBy("t"))
    return samples.withColumn("delta", F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def _range(labels: Sequence[str], seconds: int) -> Window:
    return Window.partitionBy(*labels).orderBy("t").rangeBetween(-(seconds - 1), 0)


def rate(samples: DataFrame, labels: Sequence[str], seconds: int) -> DataFrame:
    """``labels, t, rate``: the increase in (t - seconds, t] by the second, without extrapolation."""
    return increases(samples, labels).select(*labels, "t", (F.sum("delta").over(_range(labels, seconds)) / seconds).alias("rate"))


def extrapolated_rate(samples: DataFrame, labels: Sequence[str], seconds: int) -> DataFrame:
    """``labels, t, rate`` carried on to the range's ends, as Prometheus documents it; null for fewer than two samples.

    A series is carried on by at most half its sampling interval where the end
    is more than 1.1 intervals away, and never below zero.
    """
    w = _range(labels, seconds)
    first, last, n = F.first("t").over(w), F.col("t"), F.count("*").over(w)
    rise = F.sum("delta").over(w) - F.first("delta").over(w)
    s = increases(samples, labels).select(*labels, "t", first.alias("a"), n.alias("n"), rise.alias("rise"), F.first("value").over(w).alias("v"))
    span = (last - F.col("a")).cast("double")
    gap = span / (F.col("n") - 1)
    start = (F.col("a") - (last - seconds)).cast("double")
    zero = F.when((F.col("rise") > 0) & (F.col("v") >= 0), span * F.col("v") / F.col("rise"))
    start = F.least(F.when(start >= gap * 1.1, gap / 2).otherwise(start), zero)
    return s.select(*labels, "t", F.when(F.col("n") > 1, F.col("rise") * ((span + start) / span) / seconds).alias("rate"))


def bucketed(events: DataFrame, labels: Sequence[str], seconds: str, bounds: Sequence[float] = BUCKETS) -> DataFrame:
    """``labels, le, n``: cumulative bucket counts; the last bound is infinite. One pass, combined before the shuffle."""
    counts = events.groupBy(*labels).agg(*[F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(seconds).alias("b_inf"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("b_inf").alias("n")))
    return counts.select(*labels, F.explode(rows).alias("r")).select(*labels, "r.le", "r.n")


def histogram_quantile(buckets: DataFrame, labels: Sequence[str], q: float, value: str = "n") -> DataFrame:
    """``labels, quantile``: by linear interpolation in the first bucket that reaches q.

    Null without observations; the greatest finite bound if the infinite bucket holds it.
    """
    order = Window.partitionBy(*labels).orderBy("le")
    total = F.max(value).over(Window.partitionBy(*labels))
    b = buckets.select(*labels, "le", F.col(value).cast("double").alias("c"), F.lag("le", 1, 0.0).over(order).alias("lo"), F.coalesce(F.lag(value).over(order), F.lit(0)).cast("double").alias("before"), total.cast("double").alias("total"))
    hit = b.where((F.col("total") > 0) & (F.col("c") >= F.col("total") * q)).groupBy(*labels).agg(F.min(F.struct("le", "lo", "c", "before", "total")).alias("_hit"))
    inside = F.col("_hit.lo") + (F.col("_hit.le") - F.col("_hit.lo")) * F.try_divide(F.col("_hit.total") * q - F.col("_hit.before"), F.col("_hit.c") - F.col("_hit.before"))
    got = hit.select(*labels, F.when(F.col("_hit.le") == float("inf"), F.col("_hit.lo")).otherwise(F.coalesce(inside, F.col("_hit.le"))).alias("quantile"))
    return buckets.select(*labels).distinct().join(got, list(labels), "left") if labels else got


def matching(label: str, pattern: str) -> Column:
    """A label matcher: the whole label must match."""
    return F.col(label).rlike(rf"\A(?:{pattern})\z")


def top_series(samples: DataFrame, k: int, value: str, labels: Sequence[str]) -> DataFrame:
    """The ``k`` greatest series at each time; ties by the labels."""
    nth = F.row_number().over(Window.partitionBy("t").orderBy(F.desc(value), *labels))
    return samples.withColumn("place", nth).where(F.col("place") <= k)


def held(samples: DataFrame, labels: Sequence[str], breach: Column, seconds: int) -> DataFrame:
    """``labels, since, until, firing_from``: the spans in which ``breach`` held for at least ``seconds`` without a break."""
    order = Window.partitionBy(*labels).orderBy("t")
    b = samples.select(*labels, "t", F.coalesce(breach, F.lit(False)).alias("b"))
    turn = b.withColumn("x", (F.col("b") != F.lag("b", 1, False).over(order)).cast("int"))
    isle = turn.withColumn("i", F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("b")
    spans = isle.groupBy(*labels, "i").agg(F.min("t").alias("since"), F.max("t").alias("until"))
    return spans.where(F.col("until") - F.col("since") >= seconds).select(*labels, "since", "until", (F.col("since") + seconds).alias("firing_from"))


def sli(events: DataFrame, us: str, status: str, duration: str, step: int, window: int, least: float = 1.0) -> DataFrame:
    """``t, requests, errors, availability, under_slo``: the recorded series of a service, one row per scrape.

    ``requests`` and ``errors`` are per second over ``window`` s; availability
    is 1 - errors / max(requests, least), ``under_slo`` the rate of requests of
    at most 0.5 s over max(requests, least). Events are counted per scrape first; what
    is left is one row per scrape, whatever the number of events.
    """
    c = events.groupBy(tick(us, step).alias("t")).agg(F.count("*").alias("r"), F.count_if(F.col(status).rlike(r"\A5..\z")).alias("e"), F.count_if(F.col(duration) <= 0.5).alias("u"))
    span = c.agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a is not null")
    spine = span.select(F.explode(F.sequence("a", "b", F.lit(step).cast("bigint"))).alias("t"))
    full = spine.join(c, "t", "left").select("t", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("r", "e", "u")])
    w = Window.orderBy("t").rangeBetween(-(window - 1), 0)
    s = full.select("t", *[(F.sum(x).over(w) / window).alias(x) for x in ("r", "e", "u")])
    n = F.greatest("r", F.lit(float(least)))
    return s.select("t", F.col("r").alias("requests"), F.col("e").alias("errors"), (1 - F.col("e") / n).alias("availability"), (F.col("u") / n).alias("under_slo"))


def burn_alerts(recorded: DataFrame, short: int = 3600, long: int = 21600, hold_fast: int = 120, hold_slow: int = 900, hold_latency: int = 600) -> DataFrame:
    """``alert, since, until, firing_from`` of the burn-rate and latency alerts over the recorded series."""
    w = lambda n: Window.orderBy("t").rangeBetween(-(n - 1), 0)
    s = recorded.select("t", "availability", "under_slo", F.avg("availability").over(w(short)).alias("a1"), F.avg("availability").over(w(long)).alias("a6"))
    fast = (1 - F.col("availability") > FAST_BURN * BUDGET) & (1 - F.col("a1") > FAST_BURN * BUDGET)
    slow = 1 - F.col("a6") > SLOW_BURN * BUDGET
    out = None
    for name, breach, hold in (("fast_burn", fast, hold_fast), ("slow_burn", slow, hold_slow), ("latency", F.col("under_slo") < UNDER_SLO, hold_latency)):
        part = held(s.withColumn("alert", F.lit(name)), ["alert"], breach, hold)
        out = part if out is None else out.unionByName(part)
    return out


def summary(events: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    """Count, mean, least, greatest and exact percentiles per label set; null label sets are left out."""
    p = percentiles(events, labels, value, {"med": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999})
    return p.join(events.groupBy(*labels).agg(F.avg(value).alias("mean")), list(labels)).select(*labels, "n", "mean", "least", "most", "med", "p90", "p95", "p99", "p999")


def verdicts(figures: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``rule, value, passed`` of the figures of one row against upper limits."""
    rows = F.array(*[F.struct(F.lit(f"{c}<{x:g}").alias("rule"), F.col(c).cast("double").alias("value"), (F.col(c) < x).alias("passed")) for c, x in limits.items()])
    return figures.select(F.explode(rows).alias("r")).select("r.*")
