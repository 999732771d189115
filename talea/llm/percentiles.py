"""Exact percentiles of very large numeric columns, and day figures that combine.

Distributed multi-select. Each part of the data proposes the median of the
values it still holds, per group and open range, and the medians of the halves
and quarters on its either side; the medians of these proposals, weighted by
how many values stand behind each, become the range's pivots. All parts count
their values below, at and above each pivot. A wanted rank is then found (a
pivot, or an end of the part it lies in), or known to lie between two of them:
what holds no wanted rank is discarded, the rest is searched in the next
round. Only counts and proposals are shuffled, at most one row per task, range
and part of it; each round leaves about an eighth of a range, so that n values
take about log8(n) rounds.

Error: none for the figures of a group. Figures kept at ``points`` evenly
spaced ranks combine over groups: the value given for rank R of N values lies
between the true values at R and at ``rank_high``, at most R + N / points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talea.session import discard, store

#: Into how many parts the tasks' proposals are gathered, before those of the parts are.
PARTS = 256
#: After how many rounds the values still wanted are written anew.
REWRITE = 3
#: How many proposals a task holds before it combines them.
HELD = 200_000
PIVOTS = tuple(f"p{k}" for k in range(1, 8))
_ENDS = ("lo", "hi")


def _rank(bp: Column, n: Column) -> Column:
    """ceil(bp * n / 10000), at least 1, in whole numbers."""
    top = bp.cast("bigint") * n + 9999
    return F.greatest(F.lit(1).cast("bigint"), ((top - F.pmod(top, F.lit(10000))) / 10000).cast("bigint"))


def ranks_at(basis_points: Sequence[int], n: Column) -> Column:
    """The ranks (from 1) of the smallest values that at least so many of 10,000 parts do not exceed, without repeats."""
    each = F.array(*[F.lit(int(p)).cast("bigint") for p in basis_points])
    return F.array_distinct(F.transform(each, lambda p: _rank(p, n)))


def _medians(keys: np.ndarray, first: np.ndarray, last: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per segment (``keys`` number them, in order) the least value up to which half of the segment's weight lies."""
    order = np.lexsort((values, keys))
    run = np.cumsum(weights[order])
    before = np.where(first > 0, run[first - 1], 0)
    half = (before + run[last] + 1) // 2
    return values[order][np.searchsorted(run, np.maximum(half, before + 1))]


def _segments(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: the number of each row's segment, and the places where segments begin and end."""
    n = len(keys[0])
    turn = np.ones(n, dtype=bool)
    turn[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(turn)
    return np.cumsum(turn) - 1, first, np.append(first[1:], n) - 1


_SAID = ("rid", "slot", "n", *_ENDS, *PIVOTS)


def _said(f: pd.DataFrame) -> pd.DataFrame:
    """Of values with their range and its pivots: per range and slot how many, the ends, the median and those of the halves.

    Odd slots are the pivots, even ones what lies between them. Equal pivots count once.
    """
    rid, v = f["rid"].to_numpy(), f["v"].to_numpy()
    p = [f[c].to_numpy() for c in PIVOTS]
    slot = np.zeros(len(v), dtype=np.int64)
    for i, x in enumerate(p):
        fresh = 1 if i == 0 else x > p[i - 1]
        slot += fresh * ((v >= x).astype(np.int64) + (v > x))
    order = np.lexsort((v, slot, rid))
    rid, slot, v = rid[order], slot[order], v[order]
    _, first, last = _segments(rid, slot)
    at = lambda k: v[first + (last - first) * k // 8]
    return pd.DataFrame({"rid": rid[first], "slot": slot[first], "n": last - first + 1, "lo": v[first], "hi": v[last]} | {c: at(k) for k, c in enumerate(PIVOTS, 1)})


def _joined(said: list[pd.DataFrame]) -> pd.DataFrame:
    """What several batches say, as one row per range and slot: weighted medians of the proposals."""
    f = pd.concat(said, ignore_index=True)
    order = np.lexsort((f["slot"].to_numpy(), f["rid"].to_numpy()))
    f = f.iloc[order]
    rid, slot, n = (f[c].to_numpy() for c in ("rid", "slot", "n"))
    keys, first, last = _segments(rid, slot)
    out = {"rid": rid[first], "slot": slot[first], "n": np.add.reduceat(n, first), "lo": np.minimum.reduceat(f["lo"].to_numpy(), first), "hi": np.maximum.reduceat(f["hi"].to_numpy(), first)}
    return pd.DataFrame(out | {c: _medians(keys, first, last, f[c].to_numpy(), n) for c in PIVOTS})


def _task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a task's values say; held per batch and combined now and then."""
    said, held = [], 0
    for f in frames:
        if len(f):
            said.append(_said(f))
            held += len(said[-1])
            if held > HELD:
                said = [_joined(said)]
                held = len(said[0])
                if held > HELD // 2:  # many ranges with few values each: nothing is gained by holding them
                    yield said[0].assign(part=_part())
                    said, held = [], 0
    if said:
        yield _joined(said).assign(part=_part())


def _part() -> int:
    return TaskContext.get().partitionId() % PARTS


def _weighted_median(at: str) -> str:
    """SQL: of the array ``says`` of (n, pivots) the least ``at`` up to which half of the weight lies."""
    half = "aggregate(says, 0L, (s, x) -> s + x.n) / 2"
    step = f"(a, x) -> named_struct('s', a.s + x.w, 'm', if(a.m is null and a.s + x.w >= {half}, x.m, a.m))"
    held = f"array_sort(transform(says, x -> named_struct('m', x.{at}, 'w', x.n)))"
    return f"aggregate({held}, named_struct('s', 0L, 'm', cast(null as bigint)), {step}, a -> a.m) as {at}"


_SAYS = f"collect_list(struct(n, {', '.join(PIVOTS)})) as says"
_MEDIANS = [_weighted_median(p) for p in PIVOTS]


def _heard(placed: DataFrame) -> DataFrame:
    """``rid, slot, n, lo, hi`` and pivots over all values of ``rid, v`` and pivots."""
    said = placed.mapInPandas(_task, ", ".join(f"{c} bigint" for c in (*_SAID, "part")))
    for by in (["part", "rid", "slot"], ["rid", "slot"]):
        said = said.groupBy(*by).agg(F.expr("sum(n) as n"), F.expr("min(lo) as lo"), F.expr("max(hi) as hi"), F.expr(_SAYS))
        said = said.selectExpr(*by, "n", "lo", "hi", *_MEDIANS)
    return said


def multi_select(df: DataFrame, groups: Sequence[str], value: str, basis_points: Sequence[int]) -> DataFrame:
    """``groups, n, rank, value``: the values at the ranks of ``basis_points``, exactly, per group.

    ``value`` is of an integer type. Null values count nowhere; a group of
    nothing but nulls, or an empty table, gives no rows. Null is a group of
    its own. Equal values share ranks as in a sorted list. Columns beyond
    ``groups`` and ``value`` are ignored. The number of rows per group is not
    limited, nor that of groups: the ranges are broadcast only where the
    session's own threshold allows it by their measured size.
    """
    spark = df.sparkSession
    scratch = []

    def kept(d: DataFrame) -> DataFrame:
        scratch.append(store(d))
        return spark.read.schema(d.schema).parquet(scratch[-1])

    slim = kept(df.where(F.col(value).isNotNull()).select(F.struct(*groups).alias("g"), F.col(value).cast("bigint").alias("v")))
    named = kept(slim.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("gid", F.monotonically_increasing_id()))
    rows = slim.join(named.select("g", "gid"), "g").select("gid", "v")

    # before the first round a group is one range, whose pivots nothing is known of
    open_ = named.select(F.col("gid").alias("rid"), "gid", "lo", "hi", *[F.col("lo").alias(p) for p in PIVOTS], F.expr("0L as base"), ranks_at(basis_points, F.col("n")).alias("ranks"))
    ahead = "coalesce(sum(n) over (partition by rid order by slot rows between unbounded preceding and 1 preceding), 0L)"
    # the ends of what holds a rank, and whatever has one value, are known
    known = "(lo = hi or r = base + 1 or r = base + n)"
    parts, turn = [], 0
    while True:
        turn += 1
        if turn == 2 or turn % REWRITE == 0:
            rows = kept(rows.join(open_.select("gid", "lo", "hi"), "gid").where("v between lo and hi").select("gid", "v"))
        placed = rows.join(open_.select("rid", "gid", "lo", "hi", *PIVOTS), "gid").where("v between lo and hi").select("rid", "v", *PIVOTS)
        judged = _heard(placed).selectExpr("*", f"{ahead} as ahead").join(open_.select("rid", "gid", "base", "ranks"), "rid")
        judged = judged.selectExpr("gid", "n", "lo", "hi", *PIVOTS, "base + ahead as base", "filter(ranks, r -> r > base + ahead and r <= base + ahead + n) as ranks").where("size(ranks) > 0")
        state = kept(judged.selectExpr(
            "monotonically_increasing_id() as rid", "gid", "lo", "hi", *PIVOTS, "base", f"filter(ranks, r -> not {known}) as ranks",
            f"transform(filter(ranks, r -> {known}), r -> named_struct('rank', r, 'value', if(r = base + 1, lo, hi))) as found",
        ))
        parts.append(scratch[-1])
        open_ = state.where("size(ranks) > 0").drop("found")
        if open_.isEmpty():
            break
    found = spark.read.schema(state.schema).parquet(*parts).selectExpr("gid", "inline(found)")
    out = kept(found.join(named.select("gid", "g", "n"), "gid").select(*[F.col(f"g.{c}").alias(c) for c in groups], "n", "rank", "value"))
    for path in scratch[:-1]:
        discard(spark, path)
    return out


def percentiles(df: DataFrame, groups: Sequence[str], value: str, basis_points: Sequence[int]) -> DataFrame:
    """``groups, n, bp, value``: one row per group and wanted percentile, in parts of 10,000."""
    at = multi_select(df, groups, value, basis_points)
    wanted = F.explode(F.array(*[F.lit(int(p)) for p in basis_points])).alias("bp")
    rank = _rank(F.col("bp"), F.col("n"))
    return at.select(*at.columns, wanted).where(F.col("rank") == rank).select(*groups, "n", "bp", "value")


def summary(df: DataFrame, groups: Sequence[str], value: str, points: int = 100) -> DataFrame:
    """``groups, n, rank, value, below, next``: a group's least value and those at ``points`` evenly spaced ranks.

    ``below``: how many ranks the point stands for, back to the point before;
    ``next``: how many follow until the next. Kept per day, combined by :func:`combined`.
    """
    at = multi_select(df, groups, value, [0, *[10000 * i // points for i in range(1, points + 1)]])
    order = Window.partitionBy(*groups).orderBy("rank")
    rank = F.col("rank")
    after = F.lead("rank").over(order)
    first = F.lag("rank").over(order).isNull()
    step = F.when(after.isNull(), F.lit(1)).otherwise(after - rank)
    return at.select(*groups, "n", "rank", "value", (rank - F.coalesce(F.lag("rank").over(order), F.lit(0))).alias("below"), F.when(first & after.isNotNull(), after - 1).otherwise(step).cast("bigint").alias("next"))


def combined(summaries: DataFrame, groups: Sequence[str], basis_points: Sequence[int]) -> DataFrame:
    """``groups, n, bp, rank, value, rank_high``: percentiles over all summaries of a group.

    ``value`` lies between the true values at ``rank`` and at ``rank_high``,
    which is at most rank + n / points. For the point ``value`` is the least
    whose ranks, summed over the summaries, reach ``rank``; so those of the
    point before sum to less. A summary of m values has less than its next gap,
    that is, at most m / points values strictly between the last point before
    ``value`` and the next, so at most (rank - 1) + n / points values are less
    than ``value``: that number, plus one, is ``rank_high``.
    """
    merged = summaries.groupBy(*groups, "value").agg(F.sum("below").alias("below"), F.sum("next").alias("next"))
    run = Window.partitionBy(*groups).orderBy("value")
    whole = Window.partitionBy(*groups)
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    less = F.coalesce(F.sum("next").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = merged.select(*groups, "value", F.sum("below").over(upto).alias("low"), less.alias("less"), F.sum("below").over(whole).alias("n"))
    wanted = F.explode(F.array(*[F.lit(int(p)) for p in basis_points])).alias("bp")
    rank = _rank(F.col("bp"), F.col("n"))
    reached = placed.select("*", wanted).withColumn("rank", rank).where("low >= rank")
    best = F.min(F.struct("value", "less")).alias("b")
    out = reached.groupBy(*groups, "n", "bp", "rank").agg(best)
    return out.select(*groups, "n", "bp", "rank", F.col("b.value").alias("value"), F.greatest("rank", F.col("b.less") + 1).alias("rank_high"))
