"""Queries over the ledger's state machine: intake, credits, refunds, publishing, reconciliation and catalogs; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talea.functions import wire
from talea.functions.keys import account_key
from talea.operators import diagnostics, ledger, reads, streams
from talea.plans import ledger as base
from talea.plans.ledger import ACC, BOX, FNV, IDEMP, NOW_US, SHARDS, TX, now
from talea.plans.telemetry import REQ
from talea.sources.events import locks, replication, requests
from talea.sources.tables import table

REASON = "max attempts at credit: timeout"


def _credits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The outbox, and what becomes of its rows when they are credited."""
    box = base.outbox(spark, d)
    return box, ledger.credit_outcomes(box, table(spark, d, "cross_shard_outbox_applied"), base.accounts(spark, d), SHARDS)


def _changed(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows that a transition touched: it set their time."""
    return rows.where(F.col("updated_at") == now()).select(*columns)


def sender_completed(spark: SparkSession, d: str) -> DataFrame:
    """The senders' transactions that credits applied for the first time complete."""
    box, out = _credits(spark, d)
    applied = box.join(out.where("outcome = 'applied'").select("id"), "id", "left_semi")
    return _changed(ledger.sender_completed(base.transactions(spark, d), applied, now()), "id", "status", "from_account", "amount")


def _given_up(box: DataFrame) -> DataFrame:
    tried = ledger.retried(box, now(), "timeout").where("status = 'failed'").select("id")
    return box.join(tried, "id", "left_semi")


def sender_failed(spark: SparkSession, d: str) -> DataFrame:
    """The senders' transactions that fail as their credit is given up: each pending one is tried for the tenth time."""
    box = base.outbox(spark, d).withColumn("attempts", F.greatest("attempts", F.lit(9)))
    return _changed(ledger.sender_failed(base.transactions(spark, d), _given_up(box), now(), REASON), "id", "status", "failure_reason")


def _due(spark: SparkSession, d: str) -> DataFrame:
    """Refunds due: the rows marked for one, taken as pending."""
    return base.outbox(spark, d).where("refund_required").withColumn("status", F.lit("pending"))


def refund_reversed(spark: SparkSession, d: str) -> DataFrame:
    return _changed(ledger.refund_reversed(base.transactions(spark, d), _due(spark, d), now()), "id", "status", "from_account")


def refund_balances(spark: SparkSession, d: str) -> DataFrame:
    """The senders' accounts after their refunds."""
    sums = ledger.refunds(_due(spark, d), base.transactions(spark, d))
    return _changed(ledger.credited_balances(base.accounts(spark, d), sums, "from_account", "refunded", now()), "account_number", "balance")


def credit_balances(spark: SparkSession, d: str) -> DataFrame:
    """The recipients' accounts after their credits."""
    sums = ledger.credits(_credits(spark, d)[1])
    return _changed(ledger.credited_balances(base.accounts(spark, d), sums, "to_account", "credited", now()), "account_number", "balance")


def receiver_audit(spark: SparkSession, d: str) -> DataFrame:
    """The receivers' transactions of credits applied for the first time."""
    box, out = _credits(spark, d)
    none = box.select("reference_id", "from_account").limit(0)
    return ledger.receiver_audit(box, out, none, now()).select("id", "from_account", "to_account", "amount", "status", "reference_id")


def outbox_after_credit(spark: SparkSession, d: str) -> DataFrame:
    """The outbox rows that the credits complete, or mark for a refund."""
    box, out = _credits(spark, d)
    done = ledger.outbox_completed(box, out.where("outcome in ('applied', 'already_applied')"), now())
    return _changed(ledger.refund_flagged(done, out.where("outcome = 'recipient_missing'"), now()), "id", "status", "refund_required")


def reconcile_redrive(spark: SparkSession, d: str) -> DataFrame:
    """Failed credits set back to be tried again by hand."""
    box = base.outbox(spark, d)
    return _changed(ledger.redriven(box, reads.failed_outbox(box), now()), "id", "status", "attempts")


def reconcile_credit(spark: SparkSession, d: str) -> DataFrame:
    """The recipients' accounts after failed credits are booked by hand."""
    failed = reads.failed_outbox(base.outbox(spark, d)).groupBy("to_account").agg(F.sum("amount").alias("credited"))
    return _changed(ledger.credited_balances(base.accounts(spark, d), failed, "to_account", "credited", now()), "account_number", "balance")


def _keys(spark: SparkSession, d: str) -> DataFrame:
    """The idempotency keys with payloads and claims: every fifth microsecond of creation has no payload, every second one a claim up to 20 minutes old."""
    keys = base.idempotency_keys(spark, d)
    us = F.unix_micros("created_at")
    claim = F.when(us % 2 == 0, F.timestamp_micros(F.lit(NOW_US) - (us % 1200) * 1_000_000))
    return keys.select("idempotency_key", "created_at", "published", F.when(us % 5 != 0, F.col("idempotency_key")).alias("outbox_payload"), claim.alias("claimed_at"))


def publish_claim(spark: SparkSession, d: str) -> DataFrame:
    return ledger.publish_claim(_keys(spark, d), now()).select("idempotency_key", "outbox_payload")


def publish_release(spark: SparkSession, d: str) -> DataFrame:
    """Which keys are held after those with an even place in the day could not be published."""
    keys = _keys(spark, d)
    failed = keys.where(F.unix_micros("created_at") % 4 < 2)
    return ledger.released(keys, failed).groupBy("published", F.col("claimed_at").isNotNull().alias("held")).agg(F.count("*").alias("n"))


_REQUEST = ("from_account", "to_account", "amount", "currency", "reference_id", "description")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Each stored version of a transaction as a request, in the order of arrival."""
    tx = table(spark, d, "transactions").distinct()
    idx = F.concat_ws(":", F.lpad(F.coalesce(F.unix_micros("updated_at"), F.lit(0)).cast("string"), 20, "0"), "id", "status")
    text = [F.col(c).cast("string").alias(c) for c in _REQUEST]
    return tx.select(idx.alias("idx"), *[account_key(c).alias(c) if c.endswith("account") else t for c, t in zip(_REQUEST, text)])


def intake(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of all requests: the copy's rows are known, senders must be active."""
    c = F.col
    copy = table(spark, d, "transactions_copy").select(account_key("from_account").alias("from_account"), account_key("to_account").alias("to_account"), "amount", "currency", F.nullif(F.trim("reference_id"), F.lit("")).alias("reference_id"))
    key = wire.idempotency_key(wire.fnv_shard("from_account", SHARDS), c("reference_id"))
    known = copy.select(key.alias("idempotency_key"), wire.request_hash(c("from_account"), c("to_account"), c("amount"), c("currency"), c("reference_id"), F.lit(None).cast("string")).alias("request_hash"))
    out = ledger.intake(_requests(spark, d), known.where("idempotency_key is not null"), base.accounts(spark, d), SHARDS)
    return out.groupBy("outcome").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.count("payload").alias("payloads"))


def account_requests(spark: SparkSession, d: str) -> DataFrame:
    """Removed accounts asked for anew: some without a number, some with an address that is taken or a fault."""
    gone = table(spark, d, "account_tombstone").select(account_key("account_number").alias("k")).where("k is not null").distinct()
    taken = table(spark, d, "users").agg(F.min("email").alias("taken"))
    n = F.conv(F.substring(F.md5("k"), 1, 4), 16, 10).cast("int") % 8
    asked = gone.crossJoin(F.broadcast(taken)).withColumn("n", n)  # one row beside each
    first = asked.select(
        F.col("k").alias("idx"), F.when(F.col("n") == 0, None).otherwise(F.col("k")).alias("account_number"), F.when(F.col("n") == 1, " ").otherwise(F.concat(F.lit("Name "), "k")).alias("full_name"),
        F.when(F.col("n") == 2, F.col("taken")).when(F.col("n") == 3, "no address").when(F.col("n") > 4, F.concat(F.col("k"), F.lit("@x.test"))).alias("email"), (F.col("n") - 4).cast("decimal(18,2)").alias("balance"),
    )
    again = first.withColumn("idx", F.concat("idx", F.lit("~"))).withColumn("balance", F.lit(1).cast("decimal(18,2)"))
    return ledger.new_accounts(first.unionByName(again), base.accounts(spark, d))


def cursor_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Transactions by the 5 seconds that a cached page's cursor is rounded down to."""
    return base.transactions(spark, d).groupBy(reads.bucket(F.col("created_at")).alias("bucket")).agg(F.count("*").alias("n"))


def status_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of an account's statuses: gathered, appended to, filled, and their length, which is null for an empty one."""
    tx = base.transactions(spark, d).where("from_account is not null")
    # at most one element per status there is
    a = tx.groupBy("from_account").agg(F.array_sort(F.collect_set("status")).alias("a"))
    a = a.withColumn("b", F.filter(F.array_append("a", F.lit("end")), lambda s: s > "f"))
    length = lambda c: F.nullif(F.size(c), F.lit(0))
    open_ = F.filter("a", lambda s: s.isin("pending", "processing"))
    return a.select("from_account", F.concat_ws(",", "a").alias("statuses"), F.concat_ws(",", "b").alias("late"), F.concat_ws("", F.array_repeat(F.lit("x"), F.size("a"))).alias("filled"), length(open_).alias("open"))


def ack_dispositions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the copy's rows as queue messages: poison, or by the status of their transaction; unknown ones are put back."""
    copy = table(spark, d, "transactions_copy")
    c = F.col
    body = wire.payload(from_account=c("from_account"), to_account=c("to_account"), amount=c("amount"), currency=c("currency"), reference_id=F.nullif(c("reference_id"), F.lit("")), description=F.lit(None).cast("string"), request_id=c("id"))
    routed = ledger.routed(copy.select(F.lower(F.trim("id")).alias("id"), body.alias("body")))
    joined = routed.join(base.transactions(spark, d).select(F.lower(F.trim("id")).alias("id"), "status"), "id", "left")
    outcome = F.when(c("reject_reason").isNotNull(), "poison").otherwise(F.coalesce("status", F.lit("error")))
    return joined.groupBy(ledger.disposition(outcome).alias("disposition")).agg(F.count("*").alias("n"))


def degradation_gate(spark: SparkSession, d: str) -> DataFrame:
    """What each mode refuses, by method and path."""
    r = requests(spark, d).select("method", "path", F.explode(F.array(*[F.lit(m) for m in ("normal", "read_only", "maintenance")])).alias("mode"))
    return r.groupBy("mode", "method", "path").agg(F.count_if(streams.gated(F.col("method"), F.col("mode"))).alias("refused"), F.count("*").alias("n"))


def event_counters(spark: SparkSession, d: str) -> DataFrame:
    """Of all transactions as events: notices kept, malformed and other events dropped, and notices that the ring let go."""
    tx = base.transactions(spark, d)
    body = F.to_json(F.struct("id", "from_account", "to_account", F.col("amount").cast("string").alias("amount"), "currency", "reference_id"))
    events = tx.select("id", F.when(F.col("status") == "completed", "transactions.committed").otherwise("transactions.other").alias("name"), F.col("created_at").alias("occurred_at"), body.alias("payload"))
    return streams.notice_counters(events)


def queue_depth(spark: SparkSession, d: str) -> DataFrame:
    """Reservations waiting and in flight: keys not published, without and with a claim that still holds."""
    keys = _keys(spark, d).where("not published and outbox_payload is not null")
    held = F.coalesce(F.col("claimed_at") >= now(600), F.lit(False))
    return keys.agg(F.count_if(~held).alias("pending"), F.count_if(held).alias("in_flight"), F.count("*").alias("depth"))


def lock_modes(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.lock_modes(locks(spark, d))


def replication_lag(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.replication_lag(replication(spark, d))


QUERIES = {f.__name__: f for f in (
    sender_completed, sender_failed, refund_reversed, refund_balances, credit_balances, receiver_audit, outbox_after_credit, reconcile_redrive, reconcile_credit, publish_claim, publish_release,
    intake, account_requests, cursor_buckets, status_arrays, ack_dispositions, degradation_gate, event_counters, queue_depth, lock_modes, replication_lag,
)}

_OUT = base._CREDIT
_K = base._K
_UUID = lambda c: f"concat_ws('-', substr({c}, 1, 8), substr({c}, 9, 4), substr({c}, 13, 4), substr({c}, 17, 4), substr({c}, 21, 12))"
_KEYS = f"""keys AS (SELECT idempotency_key, created_us, published, CASE WHEN created_us % 5 <> 0 THEN idempotency_key END AS outbox_payload, CASE WHEN created_us % 2 = 0 THEN {NOW_US} - (created_us % 1200) * 1000000 END AS claimed_us FROM idem)"""
_HASH = lambda f, t, a, c, r, d: f"sha256(encode({f}) || '\\xFF'::BLOB || encode({t}) || '\\xFF'::BLOB || encode({a}) || '\\xFF'::BLOB || encode({c}) || '\\xFF'::BLOB || encode({r}) || '\\xFF'::BLOB || encode(coalesce({d}, '')) || '\\xFF'::BLOB)"
_AFTER = lambda who, sums: f"SELECT account_number, CAST(balance + d AS DECIMAL(18,2)) AS balance FROM acc JOIN (SELECT {who} AS k, sum(amount) AS d FROM {sums} GROUP BY 1) ON account_number = k"

SQL = {
    "sender_completed": f"""WITH {BOX}, {ACC}, {TX}, {_OUT} SELECT id, 'completed' AS status, from_account, amount FROM tx WHERE status = 'processing'
  AND EXISTS (SELECT 1 FROM box b JOIN out o ON o.id = b.id AND o.outcome = 'applied' WHERE b.reference_id = tx.reference_id AND b.from_account = tx.from_account)""",
    "sender_failed": f"""WITH {BOX}, {TX} SELECT id, 'failed' AS status, '{REASON}' AS failure_reason FROM tx WHERE status = 'processing'
  AND EXISTS (SELECT 1 FROM box b WHERE b.status = 'pending' AND NOT b.refund_required AND b.reference_id = tx.reference_id AND b.from_account = tx.from_account)""",
    "refund_reversed": f"""WITH {BOX}, {TX} SELECT id, 'reversed' AS status, from_account FROM tx WHERE status <> 'reversed'
  AND EXISTS (SELECT 1 FROM box b WHERE b.refund_required AND b.reference_id = tx.reference_id AND b.from_account = tx.from_account)""",
    "refund_balances": f"""WITH {BOX}, {ACC}, {TX}, due AS (SELECT * FROM box b WHERE refund_required AND EXISTS (SELECT 1 FROM tx WHERE tx.status <> 'reversed' AND tx.reference_id = b.reference_id AND tx.from_account = b.from_account))
{_AFTER("from_account", "due")}""",
    "credit_balances": f"WITH {BOX}, {ACC}, {_OUT} {_AFTER('to_account', chr(40) + 'SELECT * FROM out WHERE outcome = ' + chr(39) + 'applied' + chr(39) + chr(41))}",
    "receiver_audit": f"""WITH {BOX}, {ACC}, {_OUT}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY from_account DESC NULLS LAST, to_account DESC NULLS LAST, amount DESC, currency DESC, reference_id DESC NULLS LAST) AS x FROM box) WHERE x = 1),
r AS (SELECT b.id, b.from_account, b.to_account, b.amount, CASE o.outcome WHEN 'applied' THEN 'completed' ELSE 'failed' END AS status, b.reference_id,
  CASE WHEN b.reference_id IS NULL OR b.from_account IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY b.reference_id, b.from_account ORDER BY b.id) END AS k FROM once b JOIN out o USING (id) WHERE o.outcome IN ('applied', 'recipient_missing'))
SELECT {_UUID("md5('receiver|' || id)")} AS id, from_account, to_account, amount, status, reference_id FROM r WHERE k = 1""",
    "outbox_after_credit": f"""WITH {BOX}, {ACC}, {_OUT} SELECT b.id, CASE WHEN o.outcome IN ('applied', 'already_applied') AND b.status = 'pending' THEN 'completed' ELSE b.status END AS status, b.refund_required OR o.outcome = 'recipient_missing' AS refund_required
FROM box b JOIN out o USING (id) WHERE (o.outcome IN ('applied', 'already_applied') AND b.status = 'pending') OR o.outcome = 'recipient_missing'""",
    "reconcile_redrive": f"WITH {BOX} SELECT id, 'pending' AS status, 0 AS attempts FROM box WHERE status = 'failed'",
    "reconcile_credit": f"WITH {BOX}, {ACC} {_AFTER('to_account', chr(40) + 'SELECT * FROM box WHERE status = ' + chr(39) + 'failed' + chr(39) + chr(41))}",
    "publish_claim": f"""WITH {BOX}, {IDEMP}, {_KEYS} SELECT idempotency_key, outbox_payload FROM keys WHERE NOT published AND outbox_payload IS NOT NULL AND (claimed_us IS NULL OR claimed_us < {NOW_US - 600_000_000})
ORDER BY created_us, idempotency_key LIMIT 25""",
    "publish_release": f"""WITH {BOX}, {IDEMP}, {_KEYS} SELECT published, claimed_us IS NOT NULL AND NOT (NOT published AND created_us % 4 < 2) AS held, count(*) AS n FROM keys GROUP BY 1, 2""",
    "intake": f"""WITH {ACC}, q AS (SELECT DISTINCT * FROM transactions),
r AS (SELECT lpad(CAST(coalesce(epoch_us(updated_at), 0) AS VARCHAR), 20, '0') || ':' || id || ':' || status AS idx, {_K("from_account")} AS from_account, {_K("to_account")} AS to_account, CAST(amount AS VARCHAR) AS amount, currency, reference_id, description FROM q),
e AS (SELECT *, coalesce({base._account_sql("from_account")}, {base._account_sql("to_account")}, CASE WHEN lower(from_account) = lower(to_account) THEN 'from_account and to_account must be different' END,
  CASE WHEN CAST(amount AS DECIMAL(38,10)) <= 0 THEN 'amount must be positive' END, CASE WHEN NOT regexp_full_match(currency, '[A-Z]{{3}}') THEN 'currency must be exactly 3 characters' END,
  CASE WHEN reference_id IS NULL OR reference_id = '' THEN 'reference_id must not be empty' END,
  CASE WHEN octet_length(encode(description)) > 500 THEN 'description must be at most 500 characters' WHEN regexp_matches(description, '[\\x00-\\x08\\x0A-\\x1F\\x7F]') THEN 'description must not contain control characters' END,
  CASE WHEN from_account NOT IN (SELECT account_number FROM acc WHERE status = 'active' AND account_number IS NOT NULL) THEN 'sender account not found' END) AS error FROM r),
g AS (SELECT *, 'txn:' || ({FNV("from_account")}) || ':' || reference_id AS k, {_HASH("from_account", "to_account", "amount", "currency", "reference_id", "description")} AS h FROM e WHERE error IS NULL),
c AS (SELECT {_K("from_account")} AS from_account, {_K("to_account")} AS to_account, amount, currency, nullif(trim(reference_id), '') AS reference_id FROM transactions_copy),
known AS (SELECT 'txn:' || ({FNV("from_account")}) || ':' || reference_id AS k, min({_HASH("from_account", "to_account", "amount", "currency", "reference_id", "NULL")}) AS held FROM c WHERE from_account IS NOT NULL AND reference_id IS NOT NULL GROUP BY 1),
o AS (SELECT g.*, held, first_value(h) OVER w AS fh, first_value(idx) OVER w AS fi FROM g LEFT JOIN known USING (k) WINDOW w AS (PARTITION BY k ORDER BY idx, h)),
z AS (SELECT idx, CASE WHEN coalesce(held, fh) <> h THEN 'conflict' WHEN held IS NOT NULL OR fi <> idx THEN 'replay' ELSE 'accepted' END AS outcome FROM o UNION ALL SELECT idx, error FROM e WHERE error IS NOT NULL)
SELECT outcome, count(*) AS n, min(idx) AS "first", count(*) FILTER (WHERE outcome = 'accepted') AS payloads FROM z GROUP BY 1""",
    "account_requests": f"""WITH {ACC}, g AS (SELECT DISTINCT {_K("account_number")} AS k FROM account_tombstone WHERE {_K("account_number")} IS NOT NULL), x AS (SELECT k, CAST('0x' || substr(md5(k), 1, 4) AS INTEGER) % 8 AS n FROM g),
f AS (SELECT k AS idx, CASE WHEN n = 0 THEN NULL ELSE k END AS number, CASE WHEN n = 1 THEN ' ' ELSE 'Name ' || k END AS full_name,
  CASE WHEN n = 2 THEN (SELECT min(email) FROM users) WHEN n = 3 THEN 'no address' WHEN n > 4 THEN k || '@x.test' END AS email, n - 4 AS balance FROM x),
r AS (SELECT * FROM f UNION ALL SELECT idx || '~', number, full_name, email, 1 FROM f),
t AS (SELECT *, number IS NULL AS auto, unnest(CASE WHEN number IS NULL THEN list_transform([0, 1, 2, 3, 4], lambda i: 'ACC_' || upper(substr(md5(idx || '|' || i), 1, 7))) ELSE [number] END) AS asked, generate_subscripts(CASE WHEN number IS NULL THEN [0, 1, 2, 3, 4] ELSE [0] END, 1) AS nth FROM r),
p AS (SELECT *, asked IN (SELECT account_number FROM acc WHERE account_number IS NOT NULL) AS taken FROM t), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY taken, nth) AS x FROM p) WHERE x = 1),
e AS (SELECT *, CASE WHEN NOT regexp_full_match(asked, '[\\p{{L}}\\p{{N}}._-]+') THEN 'account_number contains invalid characters' WHEN trim(full_name) = '' THEN 'full_name must not be empty'
  WHEN email IS NOT NULL AND NOT regexp_full_match(email, '[^@]+@[^@]+') THEN 'email is invalid' WHEN balance < 0 THEN 'initial_balance must not be negative' END AS error FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY idx) AS y FROM e WHERE error IS NULL AND NOT taken),
b AS (SELECT *, email IN (SELECT email FROM acc WHERE email IS NOT NULL) AS used FROM a WHERE y = 1), m AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY idx) AS z FROM b WHERE NOT coalesce(used, false))
SELECT idx, asked AS account_number, error AS outcome FROM e WHERE error IS NOT NULL UNION ALL SELECT idx, asked, 'number_taken' FROM e WHERE error IS NULL AND taken UNION ALL SELECT idx, asked, 'number_taken' FROM a WHERE y > 1
UNION ALL SELECT idx, asked, 'email_taken' FROM b WHERE used UNION ALL SELECT idx, asked, CASE WHEN email IS NULL OR z = 1 THEN 'created' ELSE 'email_taken' END FROM m""",
    "cursor_buckets": f"WITH {TX} SELECT CAST(floor(epoch_us(created_at) / 5000000.0) * 5 AS BIGINT) AS bucket, count(*) AS n FROM tx GROUP BY 1",
    "status_arrays": f"""WITH {TX}, a AS (SELECT from_account, list_sort(list_distinct(array_agg(status))) AS a FROM tx WHERE from_account IS NOT NULL GROUP BY 1)
SELECT from_account, array_to_string(a, ',') AS statuses, array_to_string(list_filter(list_append(a, 'end'), lambda s: s > 'f'), ',') AS late, repeat('x', len(a)) AS filled, CAST(nullif(len(list_filter(a, lambda s: s IN ('pending', 'processing'))), 0) AS INTEGER) AS open FROM a""",
    "ack_dispositions": f"""WITH {TX}, r AS (SELECT lower(trim(id)) AS id, from_account IS NULL OR to_account IS NULL OR amount IS NULL OR nullif(reference_id, '') IS NULL OR contains(amount, ',') OR TRY_CAST(amount AS DECIMAL(38,10)) IS NULL OR TRY_CAST(amount AS DECIMAL(38,10)) <= 0
  OR TRY_CAST(amount AS DECIMAL(38,10)) > 9999999999999999.99 OR length(from_account) > 50 OR length(to_account) > 50 OR length(reference_id) > 100 AS bad FROM transactions_copy),
o AS (SELECT CASE WHEN bad THEN 'poison' ELSE coalesce(tx.status, 'error') END AS outcome FROM r LEFT JOIN tx ON lower(trim(tx.id)) = r.id)
SELECT CASE WHEN outcome IN ('completed', 'failed', 'processing', 'skipped') THEN 'ack' WHEN outcome = 'poison' THEN 'dlq' ELSE 'requeue' END AS disposition, count(*) AS n FROM o GROUP BY 1""",
    "degradation_gate": f"""WITH {REQ}, m AS (SELECT *, unnest(['normal', 'read_only', 'maintenance']) AS mode FROM req)
SELECT mode, method, path, count(*) FILTER (WHERE mode <> 'normal' AND method NOT IN ('GET', 'HEAD', 'OPTIONS')) AS refused, count(*) AS n FROM m GROUP BY 1, 2, 3""",
    "event_counters": f"""WITH {TX} SELECT count(*) FILTER (WHERE status <> 'completed') AS other, count(*) FILTER (WHERE status = 'completed' AND (to_account IS NULL OR from_account IS NULL OR currency IS NULL OR amount IS NULL)) AS malformed,
  count(*) FILTER (WHERE status = 'completed' AND to_account IS NOT NULL AND from_account IS NOT NULL AND currency IS NOT NULL AND amount IS NOT NULL) AS kept,
  greatest(count(*) FILTER (WHERE status = 'completed' AND to_account IS NOT NULL AND from_account IS NOT NULL AND currency IS NOT NULL AND amount IS NOT NULL) - 512, 0) AS evicted FROM tx""",
    "queue_depth": f"""WITH {BOX}, {IDEMP}, {_KEYS}, k AS (SELECT coalesce(claimed_us >= {NOW_US - 600_000_000}, false) AS held FROM keys WHERE NOT published AND outbox_payload IS NOT NULL)
SELECT count(*) FILTER (WHERE NOT held) AS pending, count(*) FILTER (WHERE held) AS in_flight, count(*) AS depth FROM k""",
    "lock_modes": f"""WITH {REQ} SELECT CASE k % 3 WHEN 0 THEN 'ExclusiveLock' WHEN 1 THEN 'RowExclusiveLock' ELSE 'AccessShareLock' END AS mode, count(*) FILTER (WHERE k % 5 <> 0) AS granted, count(*) FILTER (WHERE k % 5 = 0) AS waiting, count(DISTINCT path) AS relations FROM req GROUP BY 1""",
    "replication_lag": f"""WITH {REQ}, p AS (SELECT 'replica-' || client % 3 AS replica, id, us, id * 100 AS sent, id * 100 - k AS replayed, CASE WHEN k > 95 THEN 'catchup' ELSE 'streaming' END AS state FROM req),
l AS (SELECT *, row_number() OVER (PARTITION BY replica ORDER BY us DESC, id DESC) AS x FROM p)
SELECT replica, max(state) FILTER (WHERE x = 1) AS state, max(sent - replayed) FILTER (WHERE x = 1) AS lag_bytes, max(sent - replayed) AS most_bytes, count(*) FILTER (WHERE state <> 'streaming') AS broken, min(us) FILTER (WHERE x = 1) AS last_us FROM l GROUP BY 1""",
}
