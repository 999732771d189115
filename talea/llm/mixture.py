"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from talea.llm.tokens import RANKS, n_tokens
from talea.session import stored

#: A record's hash has 63 bits, searched in levels of so many.
BITS, LEVEL = 63, 9
#: Into how many parts the records of a source are split when they meet the plan.
SALTS = 32


def source_name(c: Column | str) -> Column:
    """Trimmed and in lower case; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(" \t\r\n"))), F.lit(""))


def sizes(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", ranks: str = RANKS) -> DataFrame:
    """``id, source, tokens, h``: a record's size and its place in the draw, written once for all passes."""
    place = F.shiftrightunsigned(F.xxhash64(F.col(id)), 1)
    return stored(docs.select(F.col(id).alias("id"), source_name(source).alias("source"), n_tokens(text, ranks).alias("tokens"), place.alias("h")))


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """``mix, source, weight, goal, cap, have, target, budget, shortfall``: the tokens that each source is to contribute.

    A mix is to have ``total`` tokens, or, where none is given, as many as the
    sources that it names have. ``goal`` is a source's weight over all weights
    of the mix, ``target`` its share of the total. A source with less than its
    target, each record used ``max_repeats`` times, gives all of that; what is
    lacking is handed to the others by their weights, until the total is
    reached or all are used up. ``shortfall`` is what a source stays below its
    target. A source without tokens gives none. Targets without a mix, a
    source or a positive weight are left out; repeated ones count once.
    """
    t = targets.select("mix", source_name("source").alias("source"), "weight", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"))
    t = t.where("mix is not null and source is not null and weight > 0").distinct()
    t = t.groupBy("mix", "source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").cast("bigint").alias("cap"))
    have = sized.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("have"))
    j = t.join(have, "source", "left").select("mix", "source", "weight", "cap", F.coalesce("have", F.lit(0)).cast("bigint").alias("have"))
    mix = Window.partitionBy("mix")
    wanted = F.sum("have").over(mix) if total is None else F.lit(int(total)).cast("bigint")
    j = j.select("*", (F.col("weight") / F.sum("weight").over(mix)).alias("goal"), wanted.alias("total"), (F.col("have") * F.col("cap")).alias("most"))
    # the level is the tokens given for a goal of 1; a source is used up at most / goal
    end = F.col("most") / F.col("goal")
    turn = Window.partitionBy("mix").orderBy("end", "source")
    before = F.coalesce(F.sum("most").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("goal").over(turn.rowsBetween(0, Window.unboundedFollowing))
    # what all give together when the level reaches this source's end; where that is within the total, it is used up
    j = j.withColumn("end", end).select("*", (before + F.col("end") * rest <= F.col("total")).alias("used_up"))
    sums = lambda c, up: F.coalesce(F.sum(F.when(F.col("used_up") == up, F.col(c))).over(mix), F.lit(0))
    level = F.try_divide(F.col("total") - sums("most", True), sums("goal", False))
    budget = F.when(F.col("used_up"), F.col("most")).otherwise(F.least("most", F.round(level * F.col("goal")).cast("bigint")))
    j = j.select("mix", "source", "weight", "goal", "cap", "have", F.round(F.col("total") * F.col("goal")).cast("bigint").alias("target"), budget.alias("budget"))
    return j.withColumn("shortfall", F.greatest(F.col("target") - F.col("budget"), F.lit(0).cast("bigint")))


def thresholds(sized: DataFrame, budget: DataFrame) -> DataFrame:
    """``mix, source, base, below``: each record is used ``base`` times, and once more if its hash lies below ``below``.

    Tokens are summed by source and hash bucket; the bucket in which a budget
    is reached is searched again by the next bits, the others never. One pass
    serves the budgets of all mixes; a greater budget has the greater threshold,
    so its draw contains the smaller one's.
    """
    base = F.when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have"))).otherwise(0).cast("bigint")
    state = budget.select("mix", "source", base.alias("base"), F.lit(0).cast("bigint").alias("prefix"), (F.col("budget") - base * F.col("have")).alias("left"), F.lit(2).cast("bigint").alias("n"))
    state = stored(state)
    done = []
    for level in range(1, BITS // LEVEL + 1):
        width, shift = F.lit(1 << (BITS - LEVEL * level)), BITS - LEVEL * level
        open_ = state.where("left > 0 and n > 1")
        done.append(state.where("left <= 0 or n <= 1"))
        if open_.isEmpty():
            state = None
            break
        part = F.shiftright("h", shift + LEVEL)
        here = sized.where("tokens > 0").join(open_.select("source", F.col("prefix").alias("_p")).distinct(), "source").where(part == F.shiftright(F.col("_p"), shift + LEVEL))
        buckets = here.groupBy("source", F.col("_p"), F.shiftleft(F.shiftright("h", shift), shift).alias("bucket")).agg(F.sum("tokens").alias("t"), F.count("*").alias("c"))
        run = Window.partitionBy("mix", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = open_.select("mix", "source", "base", "prefix", "left").join(buckets.withColumnRenamed("_p", "prefix"), ["source", "prefix"]).withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0)))
        # the bucket in which the budget is reached; whole buckets before it are taken
        edge = placed.where("before < left").groupBy("mix", "source", "base", "left").agg(F.max(F.struct("bucket", "t", "before", "c")).alias("e"))
        left = F.col("left") - F.col("e.before")
        one = F.col("e.c") == 1
        take = F.col("e.t") <= left
        nearest = take | (one & (F.col("e.t") <= 2 * left)) if level < BITS // LEVEL else take | (F.col("e.t") <= 2 * left)
        state = stored(
            edge.select(
                "mix", "source", "base",
                F.when(nearest, F.col("e.bucket") + width).otherwise(F.col("e.bucket")).alias("prefix"),
                F.when(nearest | one, 0).otherwise(left).cast("bigint").alias("left"), F.col("e.c").alias("n"),
            )
        )
    if state is not None:
        done.append(state)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("mix", "source", "base", F.col("prefix").alias("below"))


def mixture(
    docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", ranks: str = RANKS, total: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The draw (``mix, id, source, tokens, copies``, one row per record used) and its report.

    ``total`` is the size of each mix in tokens, see :func:`budgets`. Report,
    per mix and source of the targets: ``weight, goal, target, budget,
    shortfall, records, drawn_tokens, most_copies, share``. The share is of the
    mix's drawn tokens; the drawn tokens miss the budget by less than those of
    the record at the threshold. Records are told apart by ``id``; rows with
    one id (null too) have one hash and are drawn or left together. Null and
    empty texts have no tokens and come along with their hash. Records of no or
    an unnamed source are not drawn. An empty table of records draws nothing
    and reports zero shares.
    """
    sized = sizes(docs, id, text, source, ranks)
    budget = stored(budgets(sized, targets, total))
    # written, so that its measured size tells how to join it; under a salt, as a source may hold most records
    plan = stored(thresholds(sized, budget).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    joined = sized.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(plan, ["source", "salt"])
    copies = F.col("base") + (F.col("h") < F.col("below")).cast("bigint")
    draw = joined.select("mix", F.col("id").alias(id), "source", "tokens", copies.alias("copies")).where("copies > 0")
    got = draw.groupBy("mix", "source").agg(F.count("*").alias("records"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    whole = F.sum("drawn_tokens").over(Window.partitionBy("mix"))
    report = budget.join(got, ["mix", "source"], "left").select(
        "mix", "source", "weight", "goal", "target", "budget", "shortfall",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "drawn_tokens", "most_copies")],
    )
    report = report.withColumn("share", F.coalesce(F.try_divide(F.col("drawn_tokens").cast("double"), whole), F.lit(0.0)))
    return draw, report
