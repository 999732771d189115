"""Per-key figures where a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talea.functions.keys import account_key


def side_frequencies(df: DataFrame, left: str, right: str, at: str) -> DataFrame:
    """``side, k, v, n, latest``: how often key ``k`` on a side occurs with counterpart ``v``.

    The value-frequency form of the table: grouped by key *and* value, and
    combined before the shuffle, so that the rows of a hot key are spread over
    the tasks by their values and no task gets more than others. Empty keys
    are left out; an empty counterpart is kept as null.
    """
    sides = F.explode(
        F.array(
            F.struct(F.lit(left).alias("side"), F.col("_l").alias("k"), F.col("_r").alias("v")),
            F.struct(F.lit(right).alias("side"), F.col("_r").alias("k"), F.col("_l").alias("v")),
        )
    ).alias("s")
    pairs = df.groupBy(account_key(left).alias("_l"), account_key(right).alias("_r")).agg(F.count("*").alias("n"), F.max(at).alias("latest"))
    # grouped once by the pair, which serves both sides
    return pairs.select("n", "latest", sides).select("s.*", "n", "latest").where("k is not null")


def key_figures(freq: DataFrame) -> DataFrame:
    """Exact figures per key from weighted values: ``side, account, n, counterparties, top_counterparty, top_n, latest``.

    Each value of a key is one row here, so the distinct count is a plain
    count and the mode the value with the greatest weight (ties: the least
    value); all combine before the shuffle. A key whose counterparts are all
    empty has 0 counterparties and no mode.
    """
    named = F.col("v").isNotNull()
    # the greatest weight, then the least value: max of (weight) and min over its values, kept in one struct
    best = F.min(F.when(named, F.struct((-F.col("n")).alias("m"), F.col("v").alias("v"))))
    return (
        freq.groupBy("side", "k")
        .agg(F.sum("n").alias("n"), F.count("v").alias("counterparties"), best.alias("b"), F.max("latest").alias("latest"))
        .select("side", F.col("k").alias("account"), "n", "counterparties", F.col("b.v").alias("top_counterparty"), (-F.col("b.m")).alias("top_n"), "latest")
    )


def side_totals(df: DataFrame, *sides: str) -> DataFrame:
    """``side, total``: the number of all stored rows, once per side."""
    return df.agg(F.count("*").alias("total")).select(F.explode(F.array(*[F.lit(s) for s in sides])).alias("side"), "total")


def hot_keys(figures: DataFrame, totals: DataFrame, percent: int = 1) -> DataFrame:
    """The rows of ``figures`` that hold at least ``percent`` % of their side's total; there are at most 100 / percent a side."""
    return figures.join(totals, "side").where(F.col("n") * 100 >= F.col("total") * percent)
