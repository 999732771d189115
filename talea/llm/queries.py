"""The queries p1, p6, p7 and p8, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talea.functions.keys import account_key, utc_day
from talea.llm import encoding, mixture, percentiles, tiling
from talea.operators.current import current_rows
from talea.sources.tables import table

#: Percentiles reported, in parts of 10,000.
WANTED = (5000, 9000, 9500, 9900)


def _delays(spark: SparkSession, d: str) -> DataFrame:
    """``status, day, us``: from an outbox row's creation to the processing of its transaction, repeats once."""
    tx = current_rows(table(spark, d, "transactions", "id", "updated_at", "from_account", "reference_id", "status", "processed_at"), "from_account", "reference_id", "status", "processed_at")
    tx = tx.where("processed_at is not null and reference_id is not null").select(account_key("from_account").alias("k"), "reference_id", "status", "processed_at")
    box = table(spark, d, "cross_shard_outbox", "from_account", "reference_id", "created_at").where("created_at is not null")
    box = box.select(account_key("from_account").alias("k"), "reference_id", "created_at").groupBy("k", "reference_id").agg(F.min("created_at").alias("created_at"))
    us = F.unix_micros("processed_at") - F.unix_micros("created_at")
    return tx.join(box, ["k", "reference_id"]).select("status", utc_day("created_at").alias("day"), us.alias("us"))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the settlement delay per status and day."""
    return percentiles.percentiles(_delays(spark, d), ["status", "day"], "us", WANTED)


def p1_spans(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per status and month, combined from the summaries of single days, with the greatest rank they can have."""
    days = percentiles.summary(_delays(spark, d), ["status", "day"], "us")
    months = days.withColumn("month", F.trunc("day", "month"))
    return percentiles.combined(months, ["status", "month"], WANTED)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return tiling.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 12 consecutive words of a test item, or all words of a shorter one."""
    return _leaks(spark, d).where(F.col("longest") >= F.least(F.lit(tiling.LEAST), F.col("item_words"))).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """How much of which item is in which document: whole (at least 0.9 of its words), or in part."""
    whole = F.when(F.col("coverage") >= 0.9, "whole").otherwise("part").alias("extent")
    return _leaks(spark, d).select("doc_id", "item_id", "tiles", "covered", "item_words", "longest", "in_order", whole)


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mixture(table(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The records drawn for each mix, and how often each is used."""
    return _mixture(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached per mix and source."""
    return _mixture(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text that was read in a wrong encoding."""
    return encoding.damaged(table(spark, d, "documents", "doc_id", "text")).select(F.col("id").alias("doc_id"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """These documents with their text as far as it can be restored."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return encoding.restored(docs, encoding.damaged(docs))


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_spans": p1_spans,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}

_KEY = "nullif(upper(trim({}, ' ' || chr(9))), '')"
_DAY = "(DATE '1970-01-01' + CAST(epoch_us({}) // 86400000000 AS INTEGER))"
_DELAYS = f"""
tx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM transactions) WHERE rn = 1),
box AS (SELECT {_KEY.format("from_account")} AS k, reference_id, min(created_at) AS created_at FROM cross_shard_outbox GROUP BY 1, 2),
delays AS (
  SELECT tx.status, {_DAY.format("box.created_at")} AS day, epoch_us(tx.processed_at) - epoch_us(box.created_at) AS us
  FROM tx JOIN box ON {_KEY.format("tx.from_account")} = box.k AND tx.reference_id = box.reference_id WHERE tx.processed_at IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY status, day ORDER BY us) AS rank, count(*) OVER (PARTITION BY status, day) AS n FROM delays)"""

SQL = {
    "p1_percentiles": f"""WITH {_DELAYS}, wanted AS (SELECT unnest([5000, 9000, 9500, 9900]) AS bp)
SELECT status, day, n, CAST(bp AS INTEGER) AS bp, us AS value FROM ranked, wanted WHERE rank = greatest(1, (bp * n + 9999) // 10000)""",
    "p1_spans": f"""WITH {_DELAYS}, steps AS (SELECT unnest(generate_series(0, 10000, 100)) AS bp), wanted AS (SELECT unnest([5000, 9000, 9500, 9900]) AS bp),
points AS (SELECT DISTINCT status, day, n, rank, us AS value FROM ranked, steps WHERE rank = greatest(1, (bp * n + 9999) // 10000)),
sized AS (SELECT DISTINCT status, day, n FROM ranked), months AS (SELECT status, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(n) AS BIGINT) AS n FROM sized GROUP BY 1, 2),
candidates AS (SELECT DISTINCT status, CAST(date_trunc('month', day) AS DATE) AS month, value FROM points),
per_day AS (SELECT c.status, c.month, c.value, s.day, any_value(s.n) AS n, max(p.rank) FILTER (WHERE p.value <= c.value) AS have, min(p.rank) FILTER (WHERE p.value >= c.value) AS at_least
  FROM candidates c JOIN sized s ON s.status = c.status AND date_trunc('month', s.day) = c.month JOIN points p ON p.status = s.status AND p.day = s.day GROUP BY 1, 2, 3, 4),
placed AS (SELECT status, month, value, sum(coalesce(have, 0)) AS low, sum(coalesce(at_least - 1, n)) AS less FROM per_day GROUP BY 1, 2, 3),
reached AS (SELECT placed.*, m.n, bp, CAST(greatest(1, (bp * m.n + 9999) // 10000) AS BIGINT) AS rank FROM placed JOIN months m USING (status, month), wanted),
best AS (SELECT *, row_number() OVER (PARTITION BY status, month, bp ORDER BY value) AS rn FROM reached WHERE low >= rank)
SELECT status, month, n, CAST(bp AS INTEGER) AS bp, rank, value, CAST(greatest(rank, less + 1) AS BIGINT) AS rank_high FROM best WHERE rn = 1""",
    "p6_found": r"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM eval_items WHERE text IS NOT NULL),
s AS (SELECT item_id, w, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
item_runs AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS run FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM s)),
sizes AS (SELECT DISTINCT n FROM s),
doc_runs AS (SELECT DISTINCT doc_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (n, run)""",
}
