"""Queries over the ledger's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talea.functions import wire
from talea.functions.keys import account_key
from talea.operators import ledger, reads
from talea.operators.current import current_rows
from talea.sources.tables import table

#: "Now" of all queries that need one, in microseconds: 2024-06-01 00:00 UTC.
NOW_US = 1_717_200_000_000_000
SHARDS = 3


def now(minus_s: int = 0) -> Column:
    return F.timestamp_micros(F.lit(NOW_US - minus_s * 1_000_000))


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Current transactions with account keys."""
    return keyed(current_rows(table(spark, d, "transactions"), keep_version=True))


def keyed(tx: DataFrame) -> DataFrame:
    return tx.withColumns({c: account_key(c) for c in ("from_account", "to_account")})


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """Current accounts with account keys."""
    return current_rows(table(spark, d, "users"), keep_version=True).withColumn("account_number", account_key("account_number"))


def outbox(spark: SparkSession, d: str) -> DataFrame:
    """The outbox with account keys, repeats once."""
    box = table(spark, d, "cross_shard_outbox").distinct()
    return box.withColumns({c: account_key(c) for c in ("from_account", "to_account")})


def idempotency_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys that the outbox's transfers reserved: published once they are completed."""
    box = outbox(spark, d).where("reference_id is not null")
    key = wire.idempotency_key(wire.fnv_shard("from_account", SHARDS), F.col("reference_id"))
    return box.groupBy(key.alias("idempotency_key")).agg(
        F.min("created_at").alias("created_at"), F.max("completed_at").alias("published_at"), F.bool_and(F.col("status") == "completed").alias("published")
    ).withColumn("expires_at", F.col("created_at") + F.make_interval(hours=F.lit(24)))


def batch(spark: SparkSession, d: str) -> DataFrame:
    """The stored transactions of May as a batch to apply, in the order of their arrival, repeats and earlier versions too."""
    tx = table(spark, d, "transactions").where((F.col("created_at") >= now(86400 * 31)) & F.col("reference_id").isNotNull())
    return tx.select("id", account_key("from_account").alias("from_account"), account_key("to_account").alias("to_account"), "amount", "currency", "reference_id", "updated_at")


def balance_active(spark: SparkSession, d: str) -> DataFrame:
    return reads.balance(accounts(spark, d))


def tx_by_id(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "transactions")
    # the one id is looked up before versions are compared
    one = F.broadcast(raw.agg(F.min("id").alias("id")))
    return reads.view(keyed(current_rows(raw.join(one, "id", "left_semi")))).drop("created_at", "processed_at")


def list_latest(spark: SparkSession, d: str) -> DataFrame:
    return reads.view(keyed(reads.newest_page(table(spark, d, "transactions")))).drop("created_at", "processed_at")


def list_before(spark: SparkSession, d: str) -> DataFrame:
    return reads.view(keyed(reads.newest_page(table(spark, d, "transactions"), 500, "2024-03-01T00:00:00Z"))).drop("created_at", "processed_at")


def list_keyset(spark: SparkSession, d: str) -> DataFrame:
    return reads.view(keyed(reads.newest_page(table(spark, d, "transactions"), 50, "2024-03-01T00:00:00Z", "80000000-0000-0000-0000-000000000000"))).drop("created_at", "processed_at")


def status_by_reference(spark: SparkSession, d: str) -> DataFrame:
    return reads.freshest_status(transactions(spark, d)).select("reference_id", "id", "status")


def status_resolution(spark: SparkSession, d: str) -> DataFrame:
    copy = table(spark, d, "transactions_copy").select(F.trim("reference_id").alias("reference_id")).where("reference_id <> ''")
    return reads.resolved_status(copy, transactions(spark, d), table(spark, d, "cross_shard_outbox", "reference_id"))


def existence_probe(spark: SparkSession, d: str) -> DataFrame:
    return reads.existing(transactions(spark, d).where("reference_id is not null"), idempotency_keys(spark, d), SHARDS)


_BOX = ("id", "from_account", "to_account", "to_shard", "amount", "status", "attempts")


def admin_failed(spark: SparkSession, d: str) -> DataFrame:
    """The last 100 failures of each shard."""
    return reads.admin_outbox(outbox(spark, d), "failed").select(*_BOX)


def admin_refund_stuck(spark: SparkSession, d: str) -> DataFrame:
    return reads.stuck_refunds(outbox(spark, d), 9).select(*_BOX)


def admin_stuck(spark: SparkSession, d: str) -> DataFrame:
    found = reads.stuck_transactions(transactions(spark, d), now(), 3600).withColumn("shard", wire.fnv_shard("from_account", SHARDS))
    return reads.first_per(found, "shard", [F.asc("created_at"), F.asc("id")], reads.ADMIN_DEFAULT).select("shard", "id", "from_account", "amount")


def triage(spark: SparkSession, d: str) -> DataFrame:
    return reads.triage(outbox(spark, d)).select(*_BOX, "last_error")


def claim_credits(spark: SparkSession, d: str) -> DataFrame:
    return reads.leased(reads.claimable(outbox(spark, d), now(), 100), now(), 60).select(*_BOX)


def hot_senders(spark: SparkSession, d: str) -> DataFrame:
    # all versions of a row share its time, so the span is cut from the scan
    week = table(spark, d, "transactions").where((F.col("created_at") > now(86400 * 7)) & (F.col("created_at") <= now()))
    tx = current_rows(week, "from_account", "created_at").withColumn("from_account", account_key("from_account"))
    return reads.hot_senders(tx, now(86400 * 7), now())


def outbox_depth(spark: SparkSession, d: str) -> DataFrame:
    return outbox(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if("refund_required").alias("refunds"), F.count_if(F.col("attempts") > 0).alias("retried"))


def saga_latency(spark: SparkSession, d: str) -> DataFrame:
    return reads.latencies(outbox(spark, d))


def shard_distribution(spark: SparkSession, d: str) -> DataFrame:
    acc = accounts(spark, d)
    return acc.groupBy(wire.fnv_shard("account_number", SHARDS).alias("shard")).agg(F.count("*").alias("n"), F.sum("balance").alias("balance"))


def request_hash(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    tx = transactions(spark, d).where("reference_id is not null and from_account is not null and to_account is not null")
    shard = wire.fnv_shard("from_account", SHARDS)
    return tx.select("id", shard.alias("shard"), wire.idempotency_key(shard, c("reference_id")).alias("idempotency_key"), wire.request_hash(c("from_account"), c("to_account"), c("amount").cast("string"), c("currency"), c("reference_id"), c("description")).alias("request_hash"))


def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    copy = table(spark, d, "transactions_copy")
    error = wire.request_error(c("from_account"), c("to_account"), c("amount"), c("currency"), c("reference_id"), F.lit(None).cast("string"))
    return copy.select("id", error.alias("error")).where("error is not null").groupBy("error").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def account_errors(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    users = table(spark, d, "users").distinct()
    error = wire.new_account_error(c("account_number"), c("full_name"), c("email"), c("balance").cast("string"))
    return users.select("id", error.alias("error")).where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def table_checks(spark: SparkSession, d: str) -> DataFrame:
    return ledger.violations(transactions(spark, d), accounts(spark, d), outbox(spark, d))


def claim_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Of the batch, the rows that may be inserted beside what was known at its begin."""
    known = table(spark, d, "transactions").where((F.col("created_at") < now(86400 * 31)) & F.col("reference_id").isNotNull()).select("reference_id", account_key("from_account").alias("from_account"))
    new = batch(spark, d).withColumn("order", F.concat(F.unix_micros("updated_at").cast("string"), F.lit(":"), F.col("id")))
    return ledger.claimed(new, known, order="order").where("from_account is not null").select("id", "reference_id", "from_account")


def reserve_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Each stored row as a request in the order of arrival: reserved, replayed, or in conflict with the first."""
    tx = table(spark, d, "transactions").where("reference_id is not null")
    rows = tx.select(F.concat_ws("|", account_key("from_account"), F.col("reference_id")).alias("key"), F.unix_micros("updated_at").alias("us"), F.sha2(F.concat_ws("|", "id", F.col("amount").cast("string"), "status"), 256).alias("hash"))
    return ledger.reservations(rows).groupBy("outcome").agg(F.count("*").alias("n"))


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """All stored transactions as transfers to apply, in the order of their arrival, repeats and earlier versions too; repeats share their ``idx``."""
    tx = table(spark, d, "transactions").withColumns({c: account_key(c) for c in ("from_account", "to_account")})
    # arrival to the microsecond (16 digits) is the order; equal times go by id
    us = F.lpad(F.coalesce(F.unix_micros("updated_at"), F.lit(0)).cast("string"), 20, "0")
    shards = [wire.fnv_shard(f"{c}_account", SHARDS).alias(s) for c, s in (("to", "receiver_shard"), ("from", "sender_shard"))]
    return tx.select(F.concat_ws(":", us, "id").alias("idx"), "id", "from_account", "to_account", "amount", "reference_id", *shards)


def ledger_apply(spark: SparkSession, d: str) -> DataFrame:
    """The outcomes of applying all stored transfers in order on the accounts' balances; ``poison`` for those that break a constraint."""
    rows = arrivals(spark, d)
    fit = F.coalesce(F.col("from_account").isNotNull() & F.col("to_account").isNotNull() & (F.col("amount") > 0), F.lit(False))
    none = rows.select("reference_id", "from_account").limit(0)
    out = ledger.apply_batch(rows.where(fit), none, accounts(spark, d)).select("sender_shard", "outcome")
    out = out.unionByName(rows.where(~fit).select("sender_shard", F.lit("poison").alias("outcome")))
    return out.groupBy("sender_shard", "outcome").agg(F.count("*").alias("n"))


def credit_outcomes(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.credit_outcomes(outbox(spark, d), table(spark, d, "cross_shard_outbox_applied"), accounts(spark, d), SHARDS)
    return out.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def credit_apply(spark: SparkSession, d: str) -> DataFrame:
    """What recipients gain from the rows not applied yet."""
    return ledger.credits(ledger.credit_outcomes(outbox(spark, d), table(spark, d, "cross_shard_outbox_applied"), accounts(spark, d), SHARDS))


def refund_apply(spark: SparkSession, d: str) -> DataFrame:
    box = outbox(spark, d).withColumn("status", F.when(F.col("refund_required"), "pending").otherwise(F.col("status")))
    return ledger.refunds(box, transactions(spark, d))


def retry_transition(spark: SparkSession, d: str) -> DataFrame:
    return ledger.retried(outbox(spark, d), now(), "timeout").select("id", "attempts", "status", "last_error", F.unix_micros("lease_until").alias("lease_us"))


def retention(spark: SparkSession, d: str) -> DataFrame:
    box = ledger.kept_outbox(outbox(spark, d), now(86400 * 30)).groupBy(F.lit("outbox").alias("tab")).agg(F.count("*").alias("kept"))
    applied = ledger.kept_applied(table(spark, d, "cross_shard_outbox_applied"), now(86400 * 30)).groupBy(F.lit("applied").alias("tab")).agg(F.count("*").alias("kept"))
    keys = ledger.kept_keys(idempotency_keys(spark, d), now(86400 * 30)).groupBy(F.lit("keys").alias("tab")).agg(F.count("*").alias("kept"))
    return box.unionByName(applied).unionByName(keys)


def mark_published(spark: SparkSession, d: str) -> DataFrame:
    keys = idempotency_keys(spark, d)
    out = ledger.published(keys, keys.where("not published").orderBy("created_at", "idempotency_key").limit(25), now())
    return out.groupBy("published").agg(F.count("*").alias("n"))


def flush_reservations(spark: SparkSession, d: str) -> DataFrame:
    tx = transactions(spark, d).where("reference_id is not null and from_account is not null")
    entries = tx.select(wire.idempotency_key(wire.fnv_shard("from_account", SHARDS), F.col("reference_id")).alias("idempotency_key"))
    return ledger.flushed(entries, idempotency_keys(spark, d)).groupBy("fresh", "publish").agg(F.count("*").alias("n"))


def queue_routing(spark: SparkSession, d: str) -> DataFrame:
    """The copy's rows as queue messages: written as JSON, read again, and routed."""
    c = F.col
    copy = table(spark, d, "transactions_copy")
    body = wire.payload(from_account=c("from_account"), to_account=c("to_account"), amount=c("amount"), currency=c("currency"), reference_id=F.nullif(c("reference_id"), F.lit("")), description=F.lit(None).cast("string"), request_id=c("id"))
    out = ledger.routed(copy.select("id", body.alias("body")))
    reason = F.coalesce("reject_reason", F.lit("apply"))
    return out.groupBy(reason.alias("route")).agg(F.count("*").alias("n"))


def invalidation_keys(spark: SparkSession, d: str) -> DataFrame:
    return ledger.invalidated(transactions(spark, d).where((F.col("created_at") >= now(86400 * 7))))


def invalidation_keys_all(spark: SparkSession, d: str) -> DataFrame:
    """The keys of all transactions; ``invalidation_keys`` has those of the last week."""
    return ledger.invalidated(transactions(spark, d))


def seed_accounts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.seed_accounts(spark, 100_000)


def create_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Removed accounts created anew, each twice, beside one that exists."""
    gone = table(spark, d, "account_tombstone").select(account_key("account_number").alias("account_number")).distinct()
    new = gone.select("account_number", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx"))
    new = new.unionByName(accounts(spark, d).agg(F.min("account_number").alias("account_number")).withColumn("idx", F.lit(3)))
    return ledger.inserted_accounts(new, accounts(spark, d))


QUERIES = {f.__name__: f for f in (
    balance_active, tx_by_id, list_latest, list_before, list_keyset, status_by_reference, status_resolution, existence_probe, admin_failed, admin_refund_stuck,
    admin_stuck, triage, claim_credits, hot_senders, outbox_depth, saga_latency, shard_distribution, request_hash, validation_errors, account_errors, table_checks,
    claim_dedupe, reserve_outcomes, ledger_apply, credit_outcomes, credit_apply, refund_apply, retry_transition, retention, mark_published, flush_reservations,
    queue_routing, invalidation_keys, invalidation_keys_all, seed_accounts, create_accounts,
)}

_K = lambda c: f"nullif(upper(trim({c}, ' ' || chr(9))), '')"
FNV = lambda c, n=SHARDS: (
    f"CASE WHEN {c} IS NOT NULL THEN CAST(list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(generate_series(1, octet_length(encode({c}))), "
    f"lambda i: ('0x' || substr(hex(encode({c})), CAST(2 * i - 1 AS BIGINT), 2))::UHUGEINT), [255::UHUGEINT]), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % {n} AS INTEGER) END"
)
TX = f"""tx AS (SELECT * REPLACE ({_K("from_account")} AS from_account, {_K("to_account")} AS to_account)
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM transactions WHERE id IS NOT NULL) WHERE rn = 1)"""
ACC = f"""acc AS (SELECT * REPLACE ({_K("account_number")} AS account_number) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST,
  account_number DESC NULLS LAST, full_name DESC NULLS LAST, email DESC NULLS LAST, balance DESC NULLS LAST, status DESC NULLS LAST, created_at DESC NULLS LAST) AS rn FROM users WHERE id IS NOT NULL) WHERE rn = 1)"""
BOX = f"""box AS (SELECT DISTINCT * REPLACE ({_K("from_account")} AS from_account, {_K("to_account")} AS to_account) FROM cross_shard_outbox)"""
IDEMP = f"""idem AS (SELECT 'txn:' || ({FNV("from_account")}) || ':' || reference_id AS idempotency_key, min(epoch_us(created_at)) AS created_us, max(epoch_us(completed_at)) AS published_us,
  bool_and(status = 'completed') AS published FROM box WHERE reference_id IS NOT NULL GROUP BY 1)"""
VIEW = "id, from_account, to_account, CAST(amount AS VARCHAR) AS amount, currency, status, reference_id, description, failure_reason"
_PAGE = "ORDER BY created_at DESC NULLS LAST, id DESC NULLS LAST LIMIT"
_MARCH = 1_709_251_200_000_000
_SAMPLE = "id, from_account, to_account, to_shard, amount, status, attempts"
_MAY = NOW_US - 31 * 86_400_000_000
_BATCH = f"""batch AS (SELECT id, {_K("from_account")} AS from_account, {_K("to_account")} AS to_account, amount, reference_id, updated_at FROM transactions
  WHERE epoch_us(created_at) >= {_MAY} AND reference_id IS NOT NULL)"""
_CREDIT = f"""out AS (SELECT b.id, b.to_account, b.amount, CASE WHEN NOT coalesce(b.to_shard BETWEEN 0 AND 2, false) THEN 'invalid_shard' WHEN a.outbox_id IS NOT NULL THEN 'already_applied'
  WHEN l.account_number IS NOT NULL THEN 'applied' ELSE 'recipient_missing' END AS outcome FROM (SELECT DISTINCT ON (id) * FROM box) b
  LEFT JOIN (SELECT DISTINCT outbox_id FROM cross_shard_outbox_applied) a ON b.id = a.outbox_id
  LEFT JOIN (SELECT DISTINCT account_number FROM acc WHERE status = 'active') l ON b.to_account = l.account_number)"""


def _account_sql(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL OR {c} = '' THEN '{c} must not be empty' WHEN octet_length(encode({c})) > 50 THEN '{c} must be at most 50 characters'
    WHEN NOT regexp_full_match({c}, '(?s)[A-Za-z0-9](.*[A-Za-z0-9])?') THEN '{c} must start and end with an alphanumeric character'
    WHEN NOT regexp_full_match({c}, '[A-Za-z0-9._-]*') THEN '{c} contains invalid characters' END"""


SQL = {
    "balance_active": f"WITH {ACC} SELECT account_number, CAST(balance AS VARCHAR) AS balance, status FROM acc WHERE status = 'active'",
    "tx_by_id": f"WITH {TX} SELECT {VIEW} FROM tx WHERE id = (SELECT min(id) FROM transactions)",
    "list_latest": f"WITH {TX} SELECT {VIEW} FROM (SELECT * FROM tx {_PAGE} 20)",
    "list_before": f"WITH {TX} SELECT {VIEW} FROM (SELECT * FROM tx WHERE epoch_us(created_at) < {_MARCH} {_PAGE} 100)",
    "list_keyset": f"WITH {TX} SELECT {VIEW} FROM (SELECT * FROM tx WHERE (epoch_us(created_at), id) < ({_MARCH}, '80000000-0000-0000-0000-000000000000') {_PAGE} 50)",
    "status_by_reference": f"""WITH {TX} SELECT reference_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY reference_id ORDER BY processed_at DESC NULLS LAST,
  CASE status WHEN 'reversed' THEN 5 WHEN 'failed' THEN 4 WHEN 'completed' THEN 3 WHEN 'processing' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END DESC, id DESC) AS k FROM tx WHERE reference_id IS NOT NULL) WHERE k = 1""",
    "status_resolution": f"""WITH {TX}, s AS (SELECT reference_id, status FROM (SELECT *, row_number() OVER (PARTITION BY reference_id ORDER BY processed_at DESC NULLS LAST,
  CASE status WHEN 'reversed' THEN 5 WHEN 'failed' THEN 4 WHEN 'completed' THEN 3 WHEN 'processing' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END DESC, id DESC) AS k FROM tx WHERE reference_id IS NOT NULL) WHERE k = 1),
w AS (SELECT DISTINCT trim(reference_id) AS reference_id FROM transactions_copy WHERE trim(reference_id) <> ''), r AS (SELECT DISTINCT reference_id FROM cross_shard_outbox WHERE reference_id IS NOT NULL)
SELECT w.reference_id, coalesce(s.status, CASE WHEN r.reference_id IS NOT NULL THEN 'pending' END, 'not_found') AS status FROM w LEFT JOIN s USING (reference_id) LEFT JOIN r USING (reference_id)""",
    "existence_probe": f"""WITH {TX}, {BOX}, {IDEMP}, p AS (SELECT DISTINCT reference_id, 'txn:' || unnest([0, 1, 2]) || ':' || reference_id AS k FROM tx WHERE reference_id IS NOT NULL)
SELECT DISTINCT reference_id FROM p WHERE k IN (SELECT idempotency_key FROM idem)""",
    "admin_failed": f"WITH {BOX} SELECT {_SAMPLE} FROM (SELECT *, row_number() OVER (PARTITION BY to_shard ORDER BY updated_at DESC, id DESC) AS k FROM box WHERE status = 'failed') WHERE k <= 100",
    "admin_refund_stuck": f"WITH {BOX} SELECT {_SAMPLE} FROM box WHERE status = 'pending' AND refund_required AND attempts >= 9",
    "admin_stuck": f"""WITH {TX}, s AS (SELECT {FNV("from_account")} AS shard, * FROM tx WHERE status = 'processing' AND epoch_us(created_at) < {NOW_US - 3_600_000_000})
SELECT shard, id, from_account, amount FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY created_at, id) AS k FROM s) WHERE k <= 100""",
    "triage": f"WITH {BOX} SELECT {_SAMPLE}, last_error FROM box WHERE status = 'failed' OR (status = 'pending' AND attempts >= 10 AND refund_required)",
    "claim_credits": f"WITH {BOX} SELECT {_SAMPLE} FROM (SELECT * FROM box WHERE status = 'pending' AND attempts < 10 AND (lease_until IS NULL OR epoch_us(lease_until) < {NOW_US}) ORDER BY created_at, id LIMIT 100)",
    "hot_senders": f"WITH {TX} SELECT from_account, count(*) AS n FROM tx WHERE epoch_us(created_at) > {NOW_US - 7 * 86_400_000_000} AND epoch_us(created_at) <= {NOW_US} GROUP BY 1 ORDER BY n DESC, from_account LIMIT 5",
    "outbox_depth": f"WITH {BOX} SELECT status, count(*) AS n, count(*) FILTER (WHERE refund_required) AS refunds, count(*) FILTER (WHERE attempts > 0) AS retried FROM box GROUP BY 1",
    "saga_latency": f"""WITH {BOX}, x AS (SELECT (epoch_us(completed_at) - epoch_us(created_at)) / 1000 AS ms FROM box WHERE status = 'completed' AND completed_at IS NOT NULL)
SELECT count(*) AS n, round_even(percentile_cont(0.5) WITHIN GROUP (ORDER BY ms), 0) AS p50, round_even(percentile_cont(0.95) WITHIN GROUP (ORDER BY ms), 0) AS p95, round_even(max(ms), 0) AS max FROM x""",
    "shard_distribution": f"WITH {ACC} SELECT {FNV('account_number')} AS shard, count(*) AS n, sum(balance) AS balance FROM acc GROUP BY 1",
    "request_hash": f"""WITH {TX}, s AS (SELECT *, {FNV("from_account")} AS shard FROM tx WHERE reference_id IS NOT NULL AND from_account IS NOT NULL AND to_account IS NOT NULL)
SELECT id, shard, 'txn:' || shard || ':' || reference_id AS idempotency_key,
  sha256(encode(from_account) || '\\xFF'::BLOB || encode(to_account) || '\\xFF'::BLOB || encode(CAST(amount AS VARCHAR)) || '\\xFF'::BLOB || encode(currency) || '\\xFF'::BLOB || encode(reference_id) || '\\xFF'::BLOB || encode(coalesce(description, '')) || '\\xFF'::BLOB) AS request_hash FROM s""",
    "validation_errors": f"""WITH e AS (SELECT id, coalesce({_account_sql("from_account")}, {_account_sql("to_account")},
  CASE WHEN lower(from_account) = lower(to_account) THEN 'from_account and to_account must be different' END,
  CASE WHEN amount IS NULL OR NOT regexp_full_match(amount, '[+-]?[0-9]+(\\.[0-9]*)?') THEN 'amount must be a decimal' WHEN TRY_CAST(amount AS DECIMAL(38,10)) <= 0 THEN 'amount must be positive'
    WHEN length(regexp_extract(amount, '\\.([0-9]*)$', 1)) > 2 THEN 'amount must have at most 2 decimal places'
    WHEN TRY_CAST(amount AS DECIMAL(38,10)) IS NULL OR TRY_CAST(amount AS DECIMAL(38,10)) > 9999999999999999.99 THEN 'amount exceeds maximum DECIMAL(18, 2) value' END,
  CASE WHEN currency IS NULL OR octet_length(encode(currency)) <> 3 THEN 'currency must be exactly 3 characters' WHEN NOT regexp_full_match(currency, '[A-Z]{{3}}') THEN 'currency must be uppercase ASCII (e.g. IDR, USD)' END,
  CASE WHEN reference_id IS NULL OR reference_id = '' THEN 'reference_id must not be empty' WHEN octet_length(encode(reference_id)) > 100 THEN 'reference_id must be at most 100 characters'
    WHEN NOT regexp_full_match(reference_id, '[A-Za-z0-9._-]*') THEN 'reference_id must be ASCII alphanumeric, ''-'', ''_'' or ''.''' END) AS error FROM transactions_copy)
SELECT error, count(*) AS n, min(id) AS first_id FROM e WHERE error IS NOT NULL GROUP BY 1""",
    "account_errors": r"""WITH e AS (SELECT CASE WHEN account_number IS NULL OR trim(account_number) = '' THEN 'account_number must not be empty' WHEN octet_length(encode(account_number)) > 50 THEN 'account_number must be at most 50 characters'
  WHEN NOT regexp_full_match(account_number, '[\p{L}\p{N}._-]+') THEN 'account_number contains invalid characters' WHEN full_name IS NULL OR trim(full_name) = '' THEN 'full_name must not be empty'
  WHEN length(full_name) > 150 THEN 'full_name must be at most 150 characters' WHEN length(email) > 150 THEN 'email must be at most 150 characters'
  WHEN email IS NOT NULL AND NOT regexp_full_match(email, '[^@]+@[^@]+') THEN 'email is invalid' WHEN balance IS NULL THEN 'initial_balance must be a decimal'
  WHEN balance < 0 THEN 'initial_balance must not be negative' END AS error FROM (SELECT DISTINCT * FROM users)) SELECT error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY 1""",
    "table_checks": f"""WITH {TX}, {ACC}, {BOX} SELECT 'tx_amount' AS rule, count(*) FILTER (WHERE NOT coalesce(amount > 0, false)) AS n FROM tx
UNION ALL SELECT 'tx_status', count(*) FILTER (WHERE NOT coalesce(status IN ('pending', 'processing', 'completed', 'failed', 'reversed'), false)) FROM tx
UNION ALL SELECT 'account_balance', count(*) FILTER (WHERE NOT coalesce(balance >= 0, false)) FROM acc
UNION ALL SELECT 'account_status', count(*) FILTER (WHERE NOT coalesce(status IN ('active', 'inactive', 'blocked'), false)) FROM acc
UNION ALL SELECT 'outbox_status', count(*) FILTER (WHERE NOT coalesce(status IN ('pending', 'completed', 'failed'), false)) FROM box""",
    "claim_dedupe": f"""WITH {_BATCH}, known AS (SELECT DISTINCT reference_id, {_K("from_account")} AS from_account FROM transactions WHERE epoch_us(created_at) < {_MAY} AND reference_id IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY reference_id, from_account ORDER BY CAST(epoch_us(updated_at) AS VARCHAR) || ':' || id) AS k FROM batch WHERE from_account IS NOT NULL)
SELECT id, reference_id, from_account FROM f WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM known WHERE known.reference_id = f.reference_id AND known.from_account = f.from_account)""",
    # each step takes the next transfer of every shard; balances, in cents, lie in a list in the order of the accounts
    "ledger_apply": f"""WITH RECURSIVE {ACC}, a AS (SELECT account_number, CAST(balance * 100 AS BIGINT) AS cents, row_number() OVER (ORDER BY account_number) AS x FROM acc WHERE status = 'active' AND account_number IS NOT NULL),
r AS (SELECT lpad(CAST(coalesce(epoch_us(updated_at), 0) AS VARCHAR), 20, '0') || ':' || id AS idx, {_K("from_account")} AS f, {_K("to_account")} AS t, amount, reference_id AS ref FROM transactions),
w AS (SELECT *, {FNV("f")} AS shard, {FNV("t")} AS other, coalesce(f IS NOT NULL AND t IS NOT NULL AND amount > 0, false) AS fit FROM r),
n AS (SELECT *, ref IS NULL OR row_number() OVER (PARTITION BY ref, f ORDER BY idx, t, amount) = 1 AS ok FROM w WHERE fit),
o AS (SELECT n.shard, n.shard = n.other AS own, CAST(amount * 100 AS BIGINT) AS c, ok, x.x AS fx, y.x AS tx, row_number() OVER (PARTITION BY n.shard ORDER BY idx, t, amount, ok DESC) AS i FROM n LEFT JOIN a x ON x.account_number = n.f LEFT JOIN a y ON y.account_number = n.t),
s(shard, i, cents, outcome) AS (SELECT shard, 0::BIGINT, (SELECT list(cents ORDER BY x) FROM a), NULL::VARCHAR FROM (SELECT DISTINCT shard FROM o) UNION ALL
  SELECT shard, i, CASE WHEN outcome IN ('completed', 'processing') THEN list_transform(cents, lambda b, j: b - CASE WHEN j = fx THEN c ELSE 0 END + CASE WHEN j = tx AND outcome = 'completed' THEN c ELSE 0 END) ELSE cents END, outcome
  FROM (SELECT o.*, s.cents, CASE WHEN NOT o.ok THEN 'skipped' WHEN o.fx IS NULL OR s.cents[o.fx] < o.c THEN 'failed' WHEN NOT o.own THEN 'processing' WHEN o.tx IS NULL THEN 'failed' ELSE 'completed' END AS outcome
    FROM s JOIN o ON o.shard = s.shard AND o.i = s.i + 1))
SELECT shard AS sender_shard, outcome, count(*) AS n FROM s WHERE i > 0 GROUP BY 1, 2 UNION ALL SELECT shard, 'poison', count(*) FROM w WHERE NOT fit GROUP BY 1""",
    # each step takes the next request of every key; the first one's content is what a key stands for
    "reserve_outcomes": f"""WITH RECURSIVE o AS (SELECT k, us, h, row_number() OVER (PARTITION BY k ORDER BY us, h) AS i FROM (SELECT concat_ws('|', {_K("from_account")}, reference_id) AS k, epoch_us(updated_at) AS us,
  sha256(concat_ws('|', id, CAST(amount AS VARCHAR), status)) AS h FROM transactions WHERE reference_id IS NOT NULL)),
s(k, i, h, till, outcome) AS (SELECT k, i, h, us + 86400000000, 'reserved' FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, s.h, CASE WHEN o.h = s.h AND o.us >= s.till THEN o.us + 86400000000 ELSE s.till END,
  CASE WHEN o.h <> s.h THEN 'conflict' WHEN o.us >= s.till THEN 'reserved' ELSE 'replay' END FROM s JOIN o ON o.k = s.k AND o.i = s.i + 1)
SELECT outcome, count(*) AS n FROM s GROUP BY 1""",
    "credit_outcomes": f"WITH {BOX}, {ACC}, {_CREDIT} SELECT outcome, count(*) AS n, sum(amount) AS amount FROM out GROUP BY 1",
    "credit_apply": f"WITH {BOX}, {ACC}, {_CREDIT} SELECT to_account, sum(amount) AS credited, count(*) AS n FROM out WHERE outcome = 'applied' GROUP BY 1",
    "refund_apply": f"""WITH {BOX}, {TX} SELECT from_account, sum(amount) AS refunded, count(*) AS n FROM box WHERE refund_required
  AND EXISTS (SELECT 1 FROM tx WHERE tx.status <> 'reversed' AND tx.reference_id = box.reference_id AND tx.from_account = box.from_account) GROUP BY 1""",
    "retry_transition": f"""WITH {BOX} SELECT id, CASE WHEN refund_required AND attempts >= 9 THEN attempts ELSE attempts + 1 END AS attempts, CASE WHEN NOT refund_required AND attempts >= 9 THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN NOT refund_required AND attempts >= 9 THEN 'max attempts at credit: timeout' ELSE 'timeout' END AS last_error, CASE WHEN refund_required AND attempts >= 9 THEN {NOW_US + 300_000_000} END AS lease_us
FROM box WHERE status = 'pending'""",
    "retention": f"""WITH {BOX}, {IDEMP}, t AS (SELECT {NOW_US - 30 * 86_400_000_000} AS us)
SELECT 'outbox' AS tab, count(*) AS kept FROM box, t WHERE NOT coalesce(status = 'completed' AND epoch_us(completed_at) < t.us - 300000000, false)
UNION ALL SELECT 'applied', count(*) FROM cross_shard_outbox_applied, t WHERE NOT coalesce(epoch_us(applied_at) < t.us - 3600000000, false)
UNION ALL SELECT 'keys', count(*) FROM idem, t WHERE NOT coalesce(created_us + 86400000000 < t.us - 3600000000 OR (published AND published_us < t.us - 300000000), false)""",
    "mark_published": f"""WITH {BOX}, {IDEMP}, d AS (SELECT idempotency_key FROM idem WHERE NOT published ORDER BY created_us, idempotency_key LIMIT 25)
SELECT published OR idempotency_key IN (SELECT idempotency_key FROM d) AS published, count(*) AS n FROM idem GROUP BY 1""",
    "flush_reservations": f"""WITH {TX}, {BOX}, {IDEMP}, e AS (SELECT DISTINCT 'txn:' || ({FNV("from_account")}) || ':' || reference_id AS k FROM tx WHERE reference_id IS NOT NULL AND from_account IS NOT NULL)
SELECT i.idempotency_key IS NULL AS fresh, NOT coalesce(i.published, false) AS publish, count(*) AS n FROM e LEFT JOIN idem i ON e.k = i.idempotency_key GROUP BY 1, 2""",
    "queue_routing": """WITH r AS (SELECT CASE WHEN from_account IS NULL OR to_account IS NULL OR amount IS NULL THEN 'malformed' WHEN nullif(reference_id, '') IS NULL THEN 'missing_reference'
  WHEN contains(amount, ',') OR TRY_CAST(amount AS DECIMAL(38,10)) IS NULL THEN 'bad_amount' WHEN TRY_CAST(amount AS DECIMAL(38,10)) <= 0 THEN 'check_violation'
  WHEN TRY_CAST(amount AS DECIMAL(38,10)) > 9999999999999999.99 THEN 'out_of_range' WHEN length(from_account) > 50 OR length(to_account) > 50 OR length(reference_id) > 100 THEN 'too_long' ELSE 'apply' END AS route FROM transactions_copy)
SELECT route, count(*) AS n FROM r GROUP BY 1""",
    "invalidation_keys": f"""WITH {TX}, t AS (SELECT * FROM tx WHERE epoch_us(created_at) >= {NOW_US - 7 * 86_400_000_000})
SELECT DISTINCT cache_key FROM (SELECT unnest(['v1:txn:' || id, 'v1:tx_status:' || reference_id, 'v1:acc:' || from_account, 'v1:acc:' || to_account, 'v1:balance:' || from_account, 'v1:balance:' || to_account]) AS cache_key FROM t) WHERE cache_key IS NOT NULL""",
    "invalidation_keys_all": f"""WITH {TX}
SELECT DISTINCT cache_key FROM (SELECT unnest(['v1:txn:' || id, 'v1:tx_status:' || reference_id, 'v1:acc:' || from_account, 'v1:acc:' || to_account, 'v1:balance:' || from_account, 'v1:balance:' || to_account]) AS cache_key FROM tx) WHERE cache_key IS NOT NULL""",
    "seed_accounts": """SELECT 'ACC_' || lpad(CAST(i AS VARCHAR), 7, '0') AS account_number, 'Test User ' || i AS full_name, 'user_' || i || '@loadtest.local' AS email,
  CAST('999999999.00' AS DECIMAL(18,2)) AS balance, 'active' AS status FROM generate_series(1, 100000) AS s(i)""",
    "create_accounts": f"""WITH {ACC}, g AS (SELECT DISTINCT {_K("account_number")} AS account_number FROM account_tombstone),
n AS (SELECT account_number, unnest([1, 2]) AS idx FROM g UNION ALL SELECT min(account_number), 3 FROM acc)
SELECT n.idx, n.account_number, CASE WHEN n.account_number IN (SELECT account_number FROM acc) OR row_number() OVER (PARTITION BY n.account_number ORDER BY n.idx) > 1 THEN 'exists' ELSE 'created' END AS outcome FROM n""",
}
