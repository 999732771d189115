"""Rolling totals over trailing periods, kept as versioned daily state.

The state of a key on a day is, for each window of w days, the count and the
total of the days d-w+1 .. d. It follows from yesterday's:

    state(d) = state(d-1) + arrivals(d) - amounts(d-w)

Since this is linear, a range of days is advanced at once: each day's amounts
are posted as an addition on their day and as a deduction on the day they
expire, and a running sum carries the state on from the opening one. Only days
on which something arrives or expires are computed; the days between repeat
the state and are written out last. Rows are combined to one per key and day
before anything is gathered by key, so no key holds more rows than days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talea.functions.keys import account_key, utc_day
from talea.session import stored

WINDOWS = (7, 30)
MONEY = "decimal(38,2)"


def daily_amounts(rows: DataFrame, key: str = "from_account", amount: str = "amount", at: str = "created_at") -> DataFrame:
    """``key, day, n, total`` of rows with an account key and a time. A null amount counts as a transfer of 0."""
    return (
        rows.select(account_key(key).alias("key"), utc_day(at).alias("day"), F.coalesce(F.col(amount), F.lit(0)).alias("a"))
        .where("key is not null and day is not null")
        .groupBy("key", "day")
        .agg(F.count("*").alias("n"), F.sum("a").cast(MONEY).alias("total"))
    )


def _figures(windows: Sequence[int]) -> list[str]:
    return [f"{x}_{w}" for w in windows for x in ("n", "total")]


def _postings(daily: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Each day's amounts added on their day and deducted, window by window, on the day they expire."""

    def posting(after: int) -> Column:
        shares = []
        for w in windows:
            sign = 1 if after == 0 else -1 if after == w else 0
            shares += [(F.col("n") * sign).cast("bigint").alias(f"n_{w}"), (F.col("total") * sign).cast(MONEY).alias(f"total_{w}")]
        return F.struct(F.date_add("day", after).alias("day"), *shares)

    kept = [c for c in daily.columns if c not in ("day", "n", "total")]
    return daily.select(*kept, F.explode(F.array(posting(0), *[posting(w) for w in windows])).alias("p")).select(*kept, "p.*")


def _carried(postings: DataFrame, windows: Sequence[int]) -> DataFrame:
    """The state after each day with a posting, then written out for each day of ``first .. last``.

    ``postings`` is partitioned by key and has ``key, first, last, day`` and the figures.
    """
    names = _figures(windows)
    run = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.partitionBy("key").orderBy("day")
    changes = postings.groupBy("key", "first", "last", "day").agg(*[F.sum(c).alias(c) for c in names])
    states = changes.select(
        "key", "first", "last", "day", F.lead("day").over(order).alias("_next"),
        *[F.sum(c).over(run).cast("bigint" if c[0] == "n" else MONEY).alias(c) for c in names],
    )
    until = F.least(F.coalesce(F.date_sub("_next", 1), F.col("last")), F.col("last"))
    since = F.greatest(F.col("day"), F.col("first"))
    return states.where(until >= since).select("key", F.explode(F.sequence(since, until)).alias("day"), *names)


def rolling_state(daily: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """``key, day, n_w, total_w ...`` for each day from a key's first to its last day in ``daily``."""
    by_key = daily.repartition("key")
    whole = Window.partitionBy("key")
    spans = by_key.select("key", "day", "n", "total", F.min("day").over(whole).alias("first"), F.max("day").over(whole).alias("last"))
    return _carried(_postings(spans, windows), windows)


def with_averages(state: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Adds ``avg_w``: null for a period without transfers."""
    for w in windows:
        state = state.withColumn(f"avg_{w}", F.when(F.col(f"n_{w}") > 0, F.col(f"total_{w}").cast("double") / F.col(f"n_{w}")))
    return state


def arrival_changes(known: DataFrame, arrived: DataFrame, **columns: str) -> DataFrame:
    """What newly arrived records change in the daily amounts: ``key, day, n, total``, with deductions.

    ``known`` and ``arrived`` hold one row per ``id`` with ``updated_at``, the
    key, the amount and the time. An arrived version older than the known one
    changes nothing; a newer one takes the known one's place.
    """
    ids = arrived.select(F.col("id").alias("_id"), F.col("updated_at").alias("_u"))
    newer = F.col("updated_at").isNull() | (F.col("_u") > F.col("updated_at"))
    replaced = known.join(ids, F.col("id") == F.col("_id")).where(newer).drop("_id", "_u")
    have = known.select(F.col("id").alias("_id"), F.col("updated_at").alias("_u"), F.lit(True).alias("_known"))
    new = arrived.join(have, F.col("id") == F.col("_id"), "left").where(
        F.col("_known").isNull() | F.col("_u").isNull() | (F.col("updated_at") > F.col("_u"))
    )
    out = daily_amounts(replaced, **columns).select("key", "day", (-F.col("n")).alias("n"), (-F.col("total")).cast(MONEY).alias("total"))
    return (
        daily_amounts(new, **columns)
        .unionByName(out)
        .groupBy("key", "day")
        .agg(F.sum("n").alias("n"), F.sum("total").cast(MONEY).alias("total"))
        .where("n <> 0 or total <> 0")
    )


def changed_daily(daily: DataFrame, changes: DataFrame) -> DataFrame:
    """``daily`` after ``changes``; days left without transfers disappear."""
    return (
        daily.unionByName(changes)
        .groupBy("key", "day")
        .agg(F.sum("n").alias("n"), F.sum("total").cast(MONEY).alias("total"))
        .where("n > 0")
    )


def advanced(versions: DataFrame, earlier: DataFrame, daily: DataFrame, changes: DataFrame, version: int, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The rows of version ``version`` that ``changes`` cause: new days and recomputed ones.

    ``versions``: ``key, day, figures, version`` so far; ``earlier`` and
    ``daily``: the daily amounts before and after the changes. Per key with
    changes, the days from the first changed one to the last one that a change
    can reach are computed anew, starting from the state of the day before,
    which is all that is taken from the versions, and from the amounts that
    expire meanwhile. Days that no longer belong to the key's span are written
    with null figures, which :func:`latest` leaves out.
    """
    names, longest = _figures(windows), max(windows)
    touched = changes.groupBy("key").agg(F.min("day").alias("since"), F.date_add(F.max("day"), longest - 1).alias("reach"))

    def span(d: DataFrame, low: str, high: str) -> DataFrame:
        return d.groupBy("key").agg(F.min("day").alias(low), F.max("day").alias(high))

    # one row per key
    plan = stored(
        touched.join(span(daily, "lo", "hi"), "key", "left").join(span(earlier, "old_lo", "old_hi"), "key", "left")
        # a change before the old span, or to its first day, moves where the span begins
        .withColumn("a", F.least("since", F.coalesce(F.date_add("old_hi", 1), F.col("since"))))
        .withColumn("b", F.least(F.col("hi"), F.greatest(F.col("reach"), F.when(F.col("old_hi") < F.col("hi"), F.col("hi")), F.when(F.col("old_lo") > F.col("since"), F.col("old_lo")))))
        .withColumn("first", F.greatest("a", "lo"))
        .select("key", "a", "first", F.col("b").alias("last"), "lo", "hi", "old_lo", "old_hi")
    )
    keep = ["key", "first", "last"]
    eve = plan.where("hi is not null").select(*keep, "a", F.date_sub("a", 1).alias("day"))
    yesterday = versions.join(eve, ["key", "day"]).groupBy(*keep, "a").agg(F.max(F.struct("version", *names)).alias("s"))
    opening = yesterday.select(*keep, F.col("a").alias("day"), *[F.col(f"s.{c}").alias(c) for c in names]).where(F.col(names[0]).isNotNull())
    amounts = daily.join(plan.select(*keep, "a"), "key").where(F.col("day") >= F.date_sub("a", longest))
    posted = _postings(amounts.select(*keep, "a", "day", "n", "total"), windows).where("day >= a").drop("a")
    fresh = _carried(opening.select(*keep, "day", *names).unionByName(posted.select(*keep, "day", *names)).repartition("key"), windows)
    shrunk = plan.where("old_lo is not null and (lo is null or old_lo < lo or old_hi > hi)")
    gone = shrunk.select("key", "lo", "hi", F.explode(F.sequence("old_lo", "old_hi")).alias("day")).where("lo is null or day < lo or day > hi")
    empty = [F.lit(None).cast("bigint" if c[0] == "n" else MONEY).alias(c) for c in names]
    return fresh.unionByName(gone.select("key", "day", *empty)).withColumn("version", F.lit(version))


def latest(versions: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The newest version of each key and day."""
    names = _figures(windows)
    top = versions.groupBy("key", "day").agg(F.max(F.struct("version", *names)).alias("s"))
    return top.select("key", "day", *[F.col(f"s.{c}").alias(c) for c in names]).where(F.col(names[0]).isNotNull())
