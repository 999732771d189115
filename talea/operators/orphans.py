"""References to records that do not exist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talea.functions.keys import account_key, utc_month

#: Into how many parts the references to one key are split when they are joined back.
SALTS = 16


@dataclass(frozen=True)
class Reference:
    """References of one table: its rows (one per record), and the fields that refer to a parent."""

    tab: str
    rows: DataFrame
    fields: tuple[str, ...]
    id: str = "id"
    at: str = "created_at"


def references(*sources: Reference) -> DataFrame:
    """``tab, field, id, k, at`` for each reference; references without a key are left out."""
    parts = None
    for s in sources:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), account_key(f).alias("k")) for f in s.fields])).alias("r")
        part = s.rows.select(F.lit(s.tab).alias("tab"), F.col(s.id).alias("id"), F.col(s.at).alias("at"), pairs)
        part = part.select("tab", "r.field", "id", "r.k", "at").where("k is not null")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def orphan_keys(refs: DataFrame, parents: DataFrame, removed: DataFrame) -> DataFrame:
    """``k, kind, born`` of the distinct keys that at least one reference fails on.

    A left anti-join of the distinct keys against the parents finds the keys
    without a parent (``deleted`` if ``removed`` has them, else ``missing``); a
    key whose parent exists, but was born after the key's earliest reference,
    is ``late``. ``parents``: ``k, born``, one row per key; ``removed``: ``k``.
    A parent without a time of birth has always existed.
    """
    keys = refs.groupBy("k").agg(F.min("at").alias("earliest"))
    gone = keys.join(parents.select("k"), "k", "left_anti")
    marked = removed.select("k", F.lit(True).alias("was")).distinct()
    without = gone.join(marked, "k", "left").select("k", F.when(F.col("was"), "deleted").otherwise("missing").alias("kind"), F.lit(None).cast("timestamp").alias("born"))
    late = keys.join(parents.where("born is not null"), "k").where("earliest < born").select("k", F.lit("late").alias("kind"), "born")
    return without.unionByName(late)


def orphans(refs: DataFrame, parents: DataFrame, removed: DataFrame, salts: int = SALTS) -> DataFrame:
    """``tab, field, id, k, at, kind``: each reference whose key names no parent existing at its time.

    The orphan keys are joined back to the references under a salt, so that a
    missing key that very many records name is spread over many tasks. A
    reference without a time is never ``late``. Repeats are kept; reduce the
    sources to one row per record before where they count once.
    """
    keys = orphan_keys(refs, parents, removed)
    keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("id", "field"), F.lit(salts)).cast("int"))
    fails = F.col("born").isNull() | (F.col("at") < F.col("born"))
    return salted.join(keys, ["k", "salt"]).where(fails).select("tab", "field", "id", "k", "at", "kind")


def parent_births(df: DataFrame, key: str = "account_number", born: str = "created_at") -> DataFrame:
    """``k, born``: each parent key with its earliest time."""
    return df.select(account_key(key).alias("k"), F.col(born).alias("b")).where("k is not null").groupBy("k").agg(F.min("b").alias("born"))


def removed_keys(df: DataFrame, key: str = "account_number") -> DataFrame:
    """``k`` of removed parents."""
    return df.select(account_key(key).alias("k")).where("k is not null")


def orphan_report(refs: DataFrame, found: DataFrame, period: Column | None = None) -> DataFrame:
    """Per table, field and month: references, distinct keys named, and orphans by kind.

    Months without orphans are listed with zeros; references without a time come under a null month.
    """
    month = utc_month("at") if period is None else period
    all_refs = refs.groupBy("tab", "field", month.alias("month")).agg(F.count("*").alias("refs"))
    bad = found.groupBy("tab", "field", month.alias("month")).agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("late", "deleted", "missing")],
        F.countDistinct("k").alias("orphan_keys"),
    )
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("tab", "field", "month")]
    names = ["late", "deleted", "missing", "orphan_keys"]
    return all_refs.alias("a").join(bad.alias("b"), on, "left").select("a.tab", "a.field", "a.month", "a.refs", *[F.coalesce(F.col(f"b.{c}"), F.lit(0)).cast("bigint").alias(c) for c in names])
