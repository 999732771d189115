"""Reads of the ledger: point lookups, keyset pages, freshest states, triage and hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talea.operators.current import current_rows
from talea.operators.running import percentiles

# Statuses in the order in which they win a tie, and page sizes.
PRIORITY = ("reversed", "failed", "completed", "processing", "pending")
LIST_DEFAULT, LIST_MOST, ADMIN_DEFAULT, ADMIN_MOST = 20, 100, 100, 1000
MAX_ATTEMPTS = 10
VIEW = ("id", "from_account", "to_account", "amount", "currency", "status", "reference_id", "description", "failure_reason", "created_at", "processed_at")


def clamped(n: int | None, default: int, most: int) -> int:
    """A page's size between 1 and ``most``."""
    return max(1, min(most, default if n is None else n))


def balance(accounts: DataFrame, key: Column | None = None) -> DataFrame:
    """``account_number, balance, status`` of active accounts (all, or those where ``key`` holds), money as text."""
    found = accounts.where(F.col("status") == "active")
    return (found.where(key) if key is not None else found).select("account_number", F.col("balance").cast("string").alias("balance"), "status")


def by_ids(tx: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """The transactions with the given ids."""
    return view(tx.join(ids.select(F.col(id).alias("id")).distinct(), "id", "left_semi"))


def view(tx: DataFrame) -> DataFrame:
    return tx.select(*[F.col(c).cast("string").alias(c) if c == "amount" else F.col(c) for c in VIEW])


def before(at: str | None = None, id: str | None = None, time: str = "created_at", key: str = "id") -> Column:
    """The condition of a keyset page, written so that it reaches the Parquet scan. An unreadable time is no cursor."""
    if at is None:
        return F.lit(True)
    cursor = F.try_to_timestamp(F.lit(at))
    if id is None:
        inside = F.col(time) < cursor
    else:
        inside = (F.col(time) <= cursor) & ((F.col(time) < cursor) | ((F.col(time) == cursor) & (F.col(key) < id)))
    return cursor.isNull() | inside


def bucket(at: Column, seconds: int = 5) -> Column:
    """The second since 1970, rounded down to a multiple of ``seconds``, before 1970 too: the key of a cached page."""
    us = F.unix_micros(at)
    return ((us - F.pmod(us, F.lit(seconds * 1_000_000))) / 1_000_000).cast("bigint")


def newest_ids(raw: DataFrame, n: int, at: str | None = None, id: str | None = None) -> DataFrame:
    """``id`` of the newest records before a cursor, from all their stored versions, which share their ``created_at``.

    Two columns are read, the cursor reaches the Parquet scan, and only ids and times are shuffled.
    """
    some = raw.where(before(at, id)).where(F.col("id").isNotNull()).groupBy("id").agg(F.max("created_at").alias("created_at"))
    return some.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc_nulls_last()).limit(n).select("id")


def newest_page(raw: DataFrame, limit: int | None = None, at: str | None = None, id: str | None = None) -> DataFrame:
    """The page of the newest transactions before a cursor, from all stored versions: the ids of the page first, then their current rows."""
    n = min(LIST_MOST, LIST_DEFAULT if limit is None else max(limit, 0))
    # at most LIST_MOST ids
    return current_rows(raw.join(F.broadcast(newest_ids(raw, n, at, id)), "id", "left_semi"))


def list_transactions(tx: DataFrame, limit: int | None = None, at: str | None = None, id: str | None = None) -> DataFrame:
    """The page of the newest transactions before a cursor: a heap per partition, merged; nothing is sorted as a whole."""
    n = min(LIST_MOST, LIST_DEFAULT if limit is None else max(limit, 0))
    return view(tx.where(before(at, id)).orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc_nulls_last()).limit(n))


def priority(status: Column) -> Column:
    out = F.lit(0)
    for i, s in enumerate(PRIORITY):
        out = F.when(status == s, len(PRIORITY) - i).otherwise(out)
    return out


def freshest_status(tx: DataFrame) -> DataFrame:
    """Per reference the state last processed (unprocessed last; ties by the more final status, then the greater id).

    One aggregation that combines before the shuffle, in place of a window sort.
    """
    best = F.max(F.struct(F.col("processed_at").alias("p"), priority(F.col("status")).alias("w"), F.col("id").alias("i"), F.col("status").alias("s"))).alias("b")
    return tx.where("reference_id is not null").groupBy("reference_id").agg(best).select("reference_id", F.col("b.i").alias("id"), F.col("b.s").alias("status"), F.col("b.p").alias("processed_at"))


def resolved_status(wanted: DataFrame, tx: DataFrame, reserved: DataFrame) -> DataFrame:
    """Of each wanted reference: its transaction's status, else ``pending`` if it is reserved, else ``not_found``."""
    seen = reserved.select("reference_id", F.lit(True).alias("r")).where("reference_id is not null").distinct()
    found = freshest_status(tx).select("reference_id", "status")
    joined = wanted.select("reference_id").distinct().join(found, "reference_id", "left").join(seen, "reference_id", "left")
    return joined.select("reference_id", F.coalesce("status", F.when(F.col("r"), "pending"), F.lit("not_found")).alias("status"))


def existing(wanted: DataFrame, keys: DataFrame, shards: int = 2) -> DataFrame:
    """The wanted references for which some shard has an idempotency key."""
    made = wanted.select("reference_id").distinct().select("reference_id", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
    probe = made.select("reference_id", F.concat(F.lit("txn:"), F.col("s").cast("string"), F.lit(":"), F.col("reference_id")).alias("idempotency_key"))
    return probe.join(keys.select("idempotency_key"), "idempotency_key", "left_semi").select("reference_id").distinct()


def first_per(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps no more than n per group and partition before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def admin_outbox(outbox: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """Each shard's latest rows of a named kind, ``failed`` or ``refund-stuck``; another kind is an error."""
    kinds = {"failed": failed_outbox, "refund-stuck": stuck_refunds}
    if kind not in kinds:
        raise ValueError(f"unknown filter {kind!r}")
    return first_per(kinds[kind](outbox), "to_shard", [F.desc("updated_at"), F.desc("id")], clamped(limit, ADMIN_DEFAULT, ADMIN_MOST))


def failed_outbox(outbox: DataFrame) -> DataFrame:
    return outbox.where("status = 'failed'")


def stuck_refunds(outbox: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Refunds that gave up. As retries stop one short of the limit, ``attempts=9`` finds those that are really stuck."""
    return outbox.where((F.col("status") == "pending") & F.col("refund_required") & (F.col("attempts") >= attempts))


def stuck_transactions(tx: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    return tx.where((F.col("status") == "processing") & (F.col("created_at") < as_of - F.make_interval(secs=F.lit(seconds))))


def triage(outbox: DataFrame) -> DataFrame:
    return outbox.where("status = 'failed' or (status = 'pending' and attempts >= 10 and refund_required)")


def claimable(rows: DataFrame, as_of: Column, limit: int, lease: str = "lease_until", most: int = MAX_ATTEMPTS) -> DataFrame:
    """The oldest pending rows with no running lease, up to ``limit``, as a claim takes them."""
    free = F.col(lease).isNull() | (F.col(lease) < as_of)
    return rows.where((F.col("status") == "pending") & (F.col("attempts") < most) & free).orderBy("created_at", "id").limit(limit)


def leased(claimed: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    return claimed.withColumn("lease_until", as_of + F.make_interval(secs=F.lit(seconds))).withColumn("updated_at", as_of)


def hot_senders(tx: DataFrame, since: Column, until: Column, n: int = 5, key: str = "from_account") -> DataFrame:
    """The ``n`` busiest senders of a span of time."""
    counted = tx.where((F.col("created_at") > since) & (F.col("created_at") <= until)).groupBy(key).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), key).limit(n)


def latencies(outbox: DataFrame, since: Column | None = None) -> DataFrame:
    """Median, 95th percentile and maximum of the milliseconds from creation to completion, with the number of rows."""
    done = outbox.where("status = 'completed' and completed_at is not null")
    if since is not None:
        done = done.where(F.col("completed_at") > since)
    ms = ((F.unix_micros("completed_at") - F.unix_micros("created_at")) / 1000).alias("ms")
    p = percentiles(done.select(ms), [], "ms", {"p50": 0.5, "p95": 0.95})
    # one row, of zero and nulls where nothing is completed
    return p.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.bround(F.max(c)).alias(o) for c, o in (("p50", "p50"), ("p95", "p95"), ("most", "max"))])
