"""Running sums and maxima of groups of any size, cut into ranges that are worked on side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: Sequence[str], part: str, order: Sequence[str], sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running sums and maxima of columns (new name: column), each up to the row itself.

    ``part`` is a range of the order: rows of a lower part come before all of
    a higher one. What the parts hold is summed first; a part's rows start
    from what the parts before it hold together. So a group with most rows is
    spread over its parts, and only one row per part is gathered by group.
    Nulls in sums count as 0; a maximum over nulls is null.
    """
    sums, maxima = sums or {}, maxima or {}
    totals = df.groupBy(*group, part).agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxima.items()])
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(
        *[F.col(c).alias(f"_{c}") for c in (*group, part)], *[F.sum(n).over(before).alias(f"_{n}") for n in sums], *[F.max(n).over(before).alias(f"_{n}") for n in maxima]
    )
    same = F.lit(True)
    for c in (*group, part):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(ahead, same).select(
        *df.columns,
        *[(F.coalesce(F.sum(c).over(own), F.lit(0)) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n, c in sums.items()],
        *[F.greatest(F.max(c).over(own), F.col(f"_{n}")).alias(n) for n, c in maxima.items()],
    )


def value_part(value: Column) -> Column:
    """A range of a number: about 3 % wide, in the order of the numbers; a few thousand cover all doubles."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 32).cast("int")


def percentiles(df: DataFrame, groups: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``groups, n, least, most`` and a column per share: exact percentiles by linear interpolation between ranks.

    Equal values are counted first; ranks come from running sums over ranges
    of values, so that no task holds all values of a group. Null values count
    nowhere; no rows give no group.
    """
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull()).groupBy(*groups, v.alias("_v")).agg(F.count("*").alias("_c")).withColumn("_part", value_part(F.col("_v")))
    ranked = running(counts, list(groups), "_part", ["_v"], {"_upto": "_c"})
    whole = counts.groupBy(*groups).agg(F.sum("_c").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    own = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    both = ranked.join(F.broadcast(whole.select(*own, "n", "least", "most")) if not groups else whole.select(*own, "n", "least", "most"), same)
    holds = lambda at: (F.col("_upto") - F.col("_c") <= at) & (at < F.col("_upto"))
    picks = []
    for name, q in shares.items():
        place = (F.col("n") - 1) * q
        low, high = F.floor(place), F.ceil(place)
        picks += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_l_{name}"), F.max(F.when(holds(high), F.col("_v"))).alias(f"_h_{name}"), F.max(place - low).alias(f"_f_{name}")]
    got = both.groupBy(*groups, "n", "least", "most").agg(*picks)
    between = [(F.col(f"_l_{x}") + (F.col(f"_h_{x}") - F.col(f"_l_{x}")) * F.col(f"_f_{x}")).alias(x) for x in shares]
    return got.select(*groups, "n", "least", "most", *between)
