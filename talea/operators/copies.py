"""Differences between two copies of a dataset, with repeated keys.

Identical rows cancel by multiplicity; of what is left under a key, rows of
the two sides are paired so that the number of differing fields is least; what
remains unpaired is missing on the other side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talea.operators.assignment import StoredTransport, cheapest_transport
from talea.session import stored

#: The most arcs of a key's network that a task holds in memory, some 200 bytes each: with three fields, 700,000 distinct leftover rows. Larger ones lie in files.
ARCS = 5_000_000
#: Over how many parts of a key's left rows pairs are spread.
PARTS = 64
#: Pairs handed on at once.
BATCH = 100_000


def _struct(fields: Sequence[str], prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{f}").alias(f) for f in fields])


def cancelled(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], multiset: bool = True) -> DataFrame:
    """``key, fields, l, r``: how often each distinct row occurs on either side. Repeats count once unless ``multiset``."""
    ones = [left.select(key, *fields, F.lit(1).alias("l"), F.lit(0).alias("r")), right.select(key, *fields, F.lit(0).alias("l"), F.lit(1).alias("r"))]
    both = ones[0].unionByName(ones[1]).where(F.col(key).isNotNull())
    how = F.sum if multiset else F.max
    return both.groupBy(key, *fields).agg(how("l").cast("bigint").alias("l"), how("r").cast("bigint").alias("r"))


def compare_copies(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], multiset: bool = True, arcs: int = ARCS) -> DataFrame:
    """``key, kind, field, left_value, right_value, n``: one row per difference, ``n`` times.

    ``kind``: ``missing_right`` / ``missing_left``: the other side has no row of
    the key (one row for the key, ``n``: how many rows it has); ``field``: one
    row per field in which a pair of rows differs (``n``: so many equal pairs;
    the same values may come in several rows); ``extra_left`` / ``extra_right``:
    a key that both sides have, with ``n`` more rows on one side.
    Values are compared as given, null equal to null only; normalise before.
    Rows with a null key name nothing and are left out. Columns beyond key and
    fields are ignored. Empty tables give the other side's keys as missing.

    Pairs under a key are those of least cost, the cost of a pair being the
    number of fields that differ. One row against any number: a distributed
    minimum. Several against several: distinct rows are assigned with their
    multiplicities in one task a key, by a network that grows with the distinct
    rows, not with their pairs. A network of over ``arcs`` arcs is made by all
    tasks and lies in files of the one that solves it: slower, and of least
    cost as well. Of several pairings of one cost both take the same.
    """
    # own names inside, so that no name of a field can clash
    inner = [f"_f{i}" for i in range(len(fields))]
    renamed = [d.select(F.col(key).alias("_k"), *[F.col(f).alias(i) for f, i in zip(fields, inner)]) for d in (left, right)]
    found = _compared(*renamed, "_k", inner, multiset, arcs)
    true_name = F.create_map(*[F.lit(x) for pair in zip(inner, fields) for x in pair])
    return found.select(F.col("_k").alias(key), "kind", F.when(F.col("field").isNotNull(), true_name[F.col("field")]).alias("field"), "left_value", "right_value", "n")


def _compared(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], multiset: bool, arcs: int) -> DataFrame:
    counts = cancelled(left, right, key, fields, multiset)
    a, b = F.greatest(F.col("l") - F.col("r"), F.lit(0)), F.greatest(F.col("r") - F.col("l"), F.lit(0))
    per_key = (
        counts.groupBy(key)
        .agg(
            F.sum("l").alias("nl"), F.sum("r").alias("nr"), F.sum(a).alias("na"), F.sum(b).alias("nb"), F.count_if(a > 0).alias("da"), F.count_if(b > 0).alias("db"),
            F.min(F.when(a > 0, _struct(fields))).alias("left"), F.min(F.when(b > 0, _struct(fields))).alias("right"),
        )
        .where("na > 0 or nb > 0")
    )
    # most arcs of the key's network; null where it needs none
    size = F.least(F.col("da") * F.col("db"), (F.col("da") + F.col("db")) * (2 ** len(fields) - 1))
    keys = per_key.withColumn("arcs", F.when((F.col("na") > 1) & (F.col("nb") > 1), size)).withColumn("dense", F.col("arcs") == F.col("da") * F.col("db"))
    keys = stored(keys.withColumn("kid", F.monotonically_increasing_id()))
    one = F.lit(None).cast("string")
    both = "nl > 0 and nr > 0 and "
    rows = [
        keys.where(which).select(key, F.lit(kind).alias("kind"), one.alias("field"), one.alias("left_value"), one.alias("right_value"), F.expr(n).alias("n"))
        for kind, which, n in (("missing_right", "nr = 0", "nl"), ("missing_left", "nl = 0", "nr"), ("extra_left", both + "na > nb", "na - nb"), ("extra_right", both + "nb > na", "nb - na"))
    ]
    pairs = keys.where("na = 1 and nb = 1").select(key, "left", "right", F.lit(1).cast("bigint").alias("n"))
    several = keys.where("na > 0 and nb > 0 and na + nb > 2")
    if not several.isEmpty():
        over = counts.join(several.select(key, "arcs", "dense", "kid"), key).where("l <> r")
        lefts = over.where("l > r").select(key, "arcs", "dense", "kid", _struct(fields).alias("row"), (F.col("l") - F.col("r")).alias("m"))
        rights = over.where("r > l").select(key, "arcs", "dense", "kid", _struct(fields).alias("row"), (F.col("r") - F.col("l")).alias("m"))
        lefts, rights = stored(lefts), stored(rights)
        pairs = pairs.unionByName(_single(lefts, rights, key, fields))
        pairs = pairs.unionByName(_assigned(lefts, rights, key, fields, arcs))
    differs = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"left.{f}").cast("string").alias("x"), F.col(f"right.{f}").cast("string").alias("y"), (~F.col(f"left.{f}").eqNullSafe(F.col(f"right.{f}"))).alias("d")) for f in fields]),
        lambda s: s["d"],
    )
    found = pairs.select(key, "n", F.explode(differs).alias("d")).select(key, F.lit("field").alias("kind"), "d.field", F.col("d.x").alias("left_value"), F.col("d.y").alias("right_value"), "n")
    for r in rows:
        found = found.unionByName(r)
    return found


def _cost(fields: Sequence[str]) -> Column:
    return sum(((~F.col(f"left.{f}").eqNullSafe(F.col(f"right.{f}"))).cast("int") for f in fields), F.lit(0))


def _single(lefts: DataFrame, rights: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Keys with one row left on a side: paired with the nearest of the other side, of any number."""
    l = lefts.where("arcs is null").select(key, F.col("row").alias("left"))
    r = rights.where("arcs is null").select(key, F.col("row").alias("right"))
    best = l.join(r, key).groupBy(key).agg(F.min(F.struct(_cost(fields).alias("c"), "left", "right")).alias("p"))
    return best.select(key, "p.left", "p.right", F.lit(1).cast("bigint").alias("n"))


def _text(f: str, kind: T.DataType) -> Column:
    """A value of the row as text, other values as other texts; behind its length, so that texts can be strung together."""
    c = F.col(f"row.{f}")
    if isinstance(kind, T.BinaryType):
        c = F.hex(c)
    elif isinstance(kind, (T.ArrayType, T.StructType)):
        c = F.to_json(F.struct(c))
    c = c.cast("string")
    return F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit("="), c), F.lit("-"))


def _assigned(lefts: DataFrame, rights: DataFrame, key: str, fields: Sequence[str], most: int) -> DataFrame:
    """Keys with several rows left on both sides: minimum-cost assignment in one task a key."""
    kinds = lefts.schema["row"].dataType
    parts = F.array(*[_text(f, kinds[f].dataType) for f in fields]).alias("parts")
    sides = [d.where("arcs is not null").select(key, "kid", "arcs", "dense", F.lit(s).alias("side"), "row", "m", parts) for s, d in enumerate((lefts, rights))]
    # numbered in the order of a key's rows
    rows = stored(sides[0].unionByName(sides[1]).orderBy("kid", "side", "parts").withColumn("uid", F.monotonically_increasing_id()))
    paired = _in_memory(rows.where(f"arcs <= {most}"))
    large = rows.where(f"arcs > {most}")
    if not large.isEmpty():
        paired = paired.unionByName(_in_files(large, fields))
    paired = stored(paired)
    of = lambda side, uid, name: rows.where(f"side = {side}").select(F.col("uid").alias(uid), F.col("row").alias(name), *([key] if name == "left" else []))
    return paired.join(of(0, "l", "left"), "l").join(of(1, "r", "right"), "r").select(key, "left", "right", "n")


_PAIRS = "l bigint, r bigint, n bigint"


def _in_memory(rows: DataFrame) -> DataFrame:
    """``l, r, n`` of the keys whose network a task can hold."""

    def solved(sides: tuple[list, list]) -> Iterator[tuple]:
        (lu, lm, lp), (ru, rm, rp) = (zip(*s, strict=True) if s else ((), (), ()) for s in sides)
        return ((lu[i], ru[j], n) for i, j, n in cheapest_transport(lp, lm, rp, rm))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sides = None, ([], [])
        for f in frames:
            done = []
            for k, side, uid, m, parts in zip(f["kid"], f["side"], f["uid"], f["m"], f["parts"]):
                if k != at:
                    done += solved(sides)
                    at, sides = k, ([], [])
                sides[side].append((uid, m, tuple(parts)))
            yield pd.DataFrame(done, columns=["l", "r", "n"]).astype("int64")
        yield pd.DataFrame(list(solved(sides)), columns=["l", "r", "n"]).astype("int64")

    # the rows of a key come one after another, so that one key at a time is held
    return rows.select("kid", "side", "uid", "m", "parts").repartition("kid").sortWithinPartitions("kid", "uid").mapInPandas(assign, _PAIRS)


def _in_files(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``l, r, n`` of the other keys: what joins their rows is made by all tasks, and lies in files of the one that assigns them."""
    none, zero = F.lit(None).cast("string").alias("node"), F.lit(0).cast("bigint").alias("other")
    given = rows.select("kid", F.lit(0).cast("bigint").alias("phase"), none, "side", "uid", zero, F.col("m").alias("n"))
    l = rows.where("dense and side = 0").select("kid", "uid", F.col("row").alias("left"), F.pmod("uid", F.lit(PARTS)).cast("int").alias("part"))
    r = rows.where("dense and side = 1").select("kid", F.col("uid").alias("other"), F.col("row").alias("right"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    pairs = l.join(r, ["kid", "part"]).select("kid", F.lit(1).cast("bigint").alias("phase"), none, F.lit(0).alias("side"), "uid", "other", _cost(fields).cast("bigint").alias("n"))
    # each combination of a row's values but all, as the bits of s
    some = f"transform(sequence(0L, {2 ** min(len(fields), 40) - 2}L), s -> struct(s, {len(fields)} - bit_count(s) AS c, concat(s, ':', array_join(transform(parts, (x, i) -> if((shiftright(s, i) & 1) = 1, x, '')), ',')) AS node))"
    groups = rows.where("not dense").select("kid", "side", "uid", F.explode(F.expr(some)).alias("g"))
    groups = groups.select("kid", (F.col("g.s") + 2).alias("phase"), "g.node", "side", "uid", zero, F.col("g.c").cast("bigint").alias("n"))
    both = given.unionByName(pairs).unionByName(groups).repartition("kid").sortWithinPartitions("kid", "phase", "node", "side", "uid", "other")

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved() -> Iterator[pd.DataFrame]:
            found = network.solve() if network else iter(())
            while done := list(islice(found, BATCH)):
                yield pd.DataFrame(done, columns=["l", "r", "n"])

        at = network = node = None
        group = -1
        for f in frames:
            # one key and one kind of row at a time
            for (kid, phase), g in f.groupby(["kid", "phase"]):
                if kid != at:
                    yield from solved()
                    at, network, node, group = kid, StoredTransport(), None, -1
                side, uid, other, n = (g[c].to_numpy() for c in ("side", "uid", "other", "n"))
                if phase == 0:
                    network.add_rows(side, uid, n)
                elif phase == 1:
                    network.add_pairs(uid, other, n)
                else:
                    nodes = g["node"].to_numpy()
                    of = group + np.cumsum(np.concatenate([[nodes[0] != node], nodes[1:] != nodes[:-1]]))
                    network.add_members(of, side, uid, n)
                    node, group = nodes[-1], int(of[-1])
        yield from solved()

    return both.mapInPandas(assign, _PAIRS)
