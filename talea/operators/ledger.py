"""State changes of the ledger as pure functions from tables to new tables and outcomes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talea.functions import wire
from talea.operators.ordered import Step, ordered_fold

# Seconds of retention, leases and backoff, and how often a credit is tried.
PUBLISH_LIMIT, PUBLISH_LEASE_S = 25, 600
OUTBOX_KEPT_S, APPLIED_KEPT_S, REFUND_BACKOFF_S, MAX_ATTEMPTS = 300, 3600, 300, 10
GRACE_LEAST, GRACE_MOST, GRACE = 60, 86_400, 300


def _ago(as_of: Column, seconds: int) -> Column:
    return as_of - F.make_interval(secs=F.lit(seconds))


def seed_accounts(spark, n: int) -> DataFrame:  # noqa: ANN001
    """``n`` numbered accounts with a high balance, generated in parallel."""
    # Names, addresses and balance of seeded accounts.
    i = F.col("id")
    return spark.range(1, n + 1).select(
        F.concat(F.lit("ACC_"), F.lpad(i.cast("string"), 7, "0")).alias("account_number"),
        F.concat(F.lit("Test User "), i.cast("string")).alias("full_name"),
        F.concat(F.lit("user_"), i.cast("string"), F.lit("@loadtest.local")).alias("email"),
        F.lit("999999999.00").cast("decimal(18,2)").alias("balance"),
        F.lit("active").alias("status"),
    )


def claimed(batch: DataFrame, history: DataFrame, on: tuple[str, str] = ("reference_id", "from_account"), order: str = "idx") -> DataFrame:
    """The rows of a batch that may be inserted: the first of each (reference, sender) that history does not hold.

    A null reference or sender never conflicts, as in a unique constraint.
    """
    a, b = on
    whole = batch.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    first = whole.withColumn("_n", F.row_number().over(Window.partitionBy(a, b).orderBy(order))).where("_n = 1").drop("_n")
    fresh = first.join(history.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), [a, b], "left_anti")
    return fresh.select(*batch.columns).unionByName(batch.where(F.col(a).isNull() | F.col(b).isNull()))


def inserted_accounts(new: DataFrame, accounts: DataFrame, order: str = "idx") -> DataFrame:
    """``account_number, outcome`` of new accounts in turn: ``created`` or ``exists`` (number taken before or in the batch)."""
    nth = F.row_number().over(Window.partitionBy("account_number").orderBy(order))
    known = accounts.select("account_number", F.lit(True).alias("_k")).distinct()
    return new.withColumn("_n", nth).join(known, "account_number", "left").select(
        order, "account_number", F.when(F.col("_k") | (F.col("_n") > 1), "exists").otherwise("created").alias("outcome")
    )


def new_accounts(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """``idx, account_number, outcome`` of requests for accounts: an error, ``number_taken``, ``email_taken`` or ``created``.

    A request without a number gets one that depends on its place: ``ACC_`` and
    seven hexadecimal digits, the first of five tries that no account has. Of
    valid requests the first of a number takes it; of those, the first of an
    e-mail address takes that.
    """
    tries = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("ACC_"), F.upper(F.substring(F.md5(F.concat_ws("|", F.col("idx").cast("string"), i.cast("string"))), 1, 7))))
    asked = requests.select("idx", "full_name", "email", "balance", F.posexplode(F.when(F.col("account_number").isNull(), tries).otherwise(F.array("account_number"))).alias("nth", "number"), F.col("account_number").isNull().alias("auto"))
    numbers = accounts.select(F.col("account_number").alias("number"), F.lit(True).alias("_taken")).where("number is not null").distinct()
    free = asked.join(numbers, "number", "left")
    pick = F.min(F.struct(F.col("_taken").isNotNull().alias("taken"), "nth", "number")).alias("p")
    chosen = free.groupBy("idx", "full_name", "email", "balance").agg(pick).select("idx", "full_name", "email", "balance", F.col("p.number").alias("account_number"), F.col("p.taken").alias("taken"))
    error = wire.new_account_error(F.col("account_number"), F.col("full_name"), F.col("email"), F.col("balance").cast("string"))
    judged = chosen.withColumn("error", error)
    ok = judged.where("error is null and not taken")
    first = ok.withColumn("_n", F.row_number().over(Window.partitionBy("account_number").orderBy("idx")))
    mails = accounts.select("email", F.lit(True).alias("_m")).where("email is not null").distinct()
    won = first.where("_n = 1").join(mails, "email", "left")
    # a missing address conflicts with none: each request is a group of its own
    nth = F.row_number().over(Window.partitionBy("email", F.when(F.col("email").isNull(), F.col("idx"))).orderBy("idx"))
    mailed = won.where("_m is null").withColumn("_k", nth)
    out = lambda df, o: df.select("idx", "account_number", o.alias("outcome"))
    return (
        out(judged.where("error is not null"), F.col("error")).unionByName(out(judged.where("error is null and taken"), F.lit("number_taken"))).unionByName(out(first.where("_n > 1"), F.lit("number_taken")))
        .unionByName(out(won.where("_m is not null"), F.lit("email_taken"))).unionByName(out(mailed, F.when(F.col("_k") == 1, "created").otherwise("email_taken")))
    )


def intake(requests: DataFrame, known: DataFrame, accounts: DataFrame | None, shards: int) -> DataFrame:
    """``idx, outcome, idempotency_key, payload`` of requests for transfers, in the order of ``idx``.

    Each is validated, hashed and reserved under its key: ``accepted``,
    ``replay`` (the key has the same content), ``conflict`` (it has other
    content), or an error. ``known``: ``idempotency_key, request_hash`` of
    earlier requests. With ``accounts`` the sender must be an active one. Only
    accepted requests get a payload for the queue.
    """
    c = F.col
    fields = ("from_account", "to_account", "amount", "currency", "reference_id", "description")
    error = wire.request_error(*[c(x) for x in fields])
    shard = wire.fnv_shard("from_account", shards)
    rows = requests.select("idx", *fields, error.alias("error"), wire.idempotency_key(shard, c("reference_id")).alias("idempotency_key"), wire.request_hash(*[c(x) for x in fields]).alias("request_hash"))
    if accounts is not None:
        live = accounts.where("status = 'active'").select(c("account_number").alias("from_account"), F.lit(True).alias("_live")).distinct()
        rows = rows.join(live, "from_account", "left").withColumn("error", F.coalesce("error", F.when(c("_live").isNull(), "sender account not found"))).drop("_live")
    bad, good = rows.where("error is not null"), rows.where("error is null")
    # the content that a key stands for: that known before, else that of its first request
    first = good.groupBy("idempotency_key").agg(F.min(F.struct("idx", "request_hash")).alias("f"))
    held = known.groupBy("idempotency_key").agg(F.min("request_hash").alias("_held"))
    judged = good.join(first, "idempotency_key").join(held, "idempotency_key", "left")
    outcome = (
        F.when(F.coalesce("_held", "f.request_hash") != c("request_hash"), "conflict")
        .when(c("_held").isNotNull() | (c("f.idx") != c("idx")), "replay").otherwise("accepted")
    )
    payload = wire.payload(**{x: c(x) for x in fields}, request_id=c("idx").cast("string"))
    done = judged.withColumn("outcome", outcome).select("idx", "outcome", "idempotency_key", F.when(c("outcome") == "accepted", payload).alias("payload"))
    return done.unionByName(bad.select("idx", c("error").alias("outcome"), F.lit(None).cast("string").alias("idempotency_key"), F.lit(None).cast("string").alias("payload")))


def apply_batch(batch: DataFrame, history: DataFrame, accounts: DataFrame) -> DataFrame:
    """``sender_shard, idx, outcome, assigned_id`` of a batch of transfers, applied in order on each sender's shard.

    A debit needs an active sender with enough balance; a recipient on the same
    shard is credited at once (missing or inactive: the debit is taken back and
    the transfer fails), one on another shard later (``processing``). The order
    matters across senders, as a credit can pay for a later debit, so the unit
    of work is a sender's shard: each folds its rows in order, with the balances
    of the accounts that the batch names. Shards do not touch each other.
    """
    # the claim of `claimed`, as a mark beside each row; rows that never conflict are spread by their place
    whole = F.col("reference_id").isNotNull() & F.col("from_account").isNotNull()
    by = Window.partitionBy("reference_id", "from_account", F.when(~whole, F.col("idx"))).orderBy("idx", "to_account", "amount")
    known = history.where(whole).select("reference_id", "from_account", F.lit(True).alias("_k")).distinct()
    ok = ~whole | ((F.col("_n") == 1) & F.col("_k").isNull())
    rows = batch.withColumn("_n", F.row_number().over(by)).join(known, ["reference_id", "from_account"], "left").select(
        "sender_shard", F.lit(1).alias("kind"), "idx", "id", "from_account", "to_account", F.col("amount").cast("string").alias("amount"), "receiver_shard", ok.alias("ok")
    )
    named = batch.select("sender_shard", F.explode(F.array("from_account", "to_account")).alias("account_number")).distinct()
    held = accounts.join(named, "account_number").select(
        "sender_shard", F.lit(0).alias("kind"), F.lit(None).cast(batch.schema["idx"].dataType).alias("idx"), F.lit(None).cast("string").alias("id"), F.col("account_number").alias("from_account"),
        F.lit(None).cast("string").alias("to_account"), F.col("balance").cast("string").alias("amount"), F.lit(None).cast("int").alias("receiver_shard"), (F.col("status") == "active").alias("ok"),
    )

    def step(state: dict, r: tuple) -> tuple[dict, tuple]:
        if r.kind == 0:
            state[r.from_account] = [Decimal(r.amount), bool(r.ok)]
            return state, (None, None)
        if not r.ok:
            return state, ("skipped", None)
        amount, sender = Decimal(r.amount), state.get(r.from_account)
        if sender is None or not sender[1] or sender[0] < amount:
            return state, ("failed", r.id)
        if r.receiver_shard != r.sender_shard:
            sender[0] -= amount
            return state, ("processing", r.id)
        to = state.get(r.to_account)
        if to is None or not to[1]:
            return state, ("failed", r.id)
        sender[0] -= amount
        to[0] += amount
        return state, ("completed", r.id)

    done = ordered_fold(held.unionByName(rows), ["sender_shard"], ["kind", "idx"], step, dict, "outcome string, assigned_id string")
    return done.where("kind = 1").select("sender_shard", "idx", "outcome", "assigned_id")


def balances_after(accounts: DataFrame, batch: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The accounts with the balances that the outcomes of a batch leave."""
    b = batch.join(outcomes, ["sender_shard", "idx"]).where(F.col("outcome").isin("completed", "processing"))
    debit = b.select(F.col("from_account").alias("account_number"), (-F.col("amount")).alias("d"))
    credit = b.where("outcome = 'completed'").select(F.col("to_account").alias("account_number"), F.col("amount").alias("d"))
    moved = debit.unionByName(credit).groupBy("account_number").agg(F.sum("d").alias("d"))
    return accounts.join(moved, "account_number", "left").withColumn("balance", (F.col("balance") + F.coalesce("d", F.lit(0))).cast("decimal(18,2)")).drop("d")


def outbox_rows(batch: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """The pending outbox rows of the transfers that go on to another shard."""
    b = batch.join(outcomes.where("outcome = 'processing'").select("sender_shard", "idx"), ["sender_shard", "idx"])
    return b.select(F.col("outbox_id").alias("id"), "from_account", "to_account", F.col("receiver_shard").alias("to_shard"), "amount", "currency", "reference_id", "description", F.lit("pending").alias("status"), as_of.alias("created_at"))


def credit_outcomes(claims: DataFrame, applied: DataFrame, accounts: DataFrame, shards: int | None = None) -> DataFrame:
    """``id, to_account, amount, outcome`` of claimed outbox rows.

    ``already_applied`` if the receiver has the row (or it comes twice),
    ``applied`` if the recipient is active, ``recipient_missing`` otherwise, and
    ``invalid_shard`` for a shard number out of range.
    """
    values = F.struct(*[c for c in claims.columns if c != "id"])
    once = claims.groupBy("id").agg(F.max(values).alias("_r")).select("id", "_r.*")
    had = applied.select(F.col("outbox_id").alias("id"), F.lit(True).alias("_a")).distinct()
    live = accounts.where("status = 'active'").select(F.col("account_number").alias("to_account"), F.lit(True).alias("_l")).distinct()
    bad = F.lit(False) if shards is None else ~F.coalesce(F.col("to_shard").between(0, shards - 1), F.lit(False))
    outcome = F.when(bad, "invalid_shard").when(F.col("_a"), "already_applied").when(F.col("_l"), "applied").otherwise("recipient_missing")
    return once.join(had, "id", "left").join(live, "to_account", "left").select("id", "to_account", "amount", outcome.alias("outcome"))


def credits(outcomes: DataFrame) -> DataFrame:
    """``to_account, credited, n``: what each recipient gains. Additions commute, so one sum replaces the updates."""
    return outcomes.where("outcome = 'applied'").groupBy("to_account").agg(F.sum("amount").alias("credited"), F.count("*").alias("n"))


def stable_id(*parts: Column) -> Column:
    """An id in the form of a UUID that depends on nothing but ``parts``."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def receiver_audit(claims: DataFrame, outcomes: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """The receiver's transactions of credits applied for the first time: completed, or failed where the recipient is missing.

    ``history`` is the receiver's transactions; a (reference, sender) that it holds is left as it is.
    """
    fresh = outcomes.where("outcome in ('applied', 'recipient_missing')").select("id", F.when(F.col("outcome") == "applied", "completed").otherwise("failed").alias("status"))
    once = claims.groupBy("id").agg(F.max(F.struct("from_account", "to_account", "amount", "currency", "reference_id", "description")).alias("_r")).select("id", "_r.*")
    rows = claimed(once.join(fresh, "id"), history, order="id")
    return rows.select(stable_id(F.lit("receiver"), F.col("id")).alias("id"), "from_account", "to_account", "amount", "currency", "status", "reference_id", "description", as_of.alias("processed_at"), as_of.alias("updated_at"))


def _marked(rows: DataFrame, which: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_hit``: whether ``which`` names them. Null keys name nothing."""
    return rows.join(which.select(*keys, F.lit(True).alias("_hit")).distinct(), keys, "left")


def _moved(rows: DataFrame, guard: Column, **values: Column) -> DataFrame:
    """The marked rows that ``guard`` allows, with new values; the others as they are."""
    hit = F.coalesce(F.col("_hit") & guard, F.lit(False))
    return rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns if c != "_hit"])


SENDER = ["reference_id", "from_account"]


def sender_completed(tx: DataFrame, applied: DataFrame, as_of: Column) -> DataFrame:
    """The transactions with the senders' rows of applied credits completed; those not in processing stay."""
    return _moved(_marked(tx, applied, SENDER), F.col("status") == "processing", status=F.lit("completed"), processed_at=as_of, updated_at=as_of)


def sender_failed(tx: DataFrame, failed: DataFrame, as_of: Column, reason: str) -> DataFrame:
    """The transactions with the senders' rows of credits given up failed; those not in processing stay."""
    return _moved(_marked(tx, failed, SENDER), F.col("status") == "processing", status=F.lit("failed"), failure_reason=F.lit(reason), processed_at=as_of, updated_at=as_of)


def refund_reversed(tx: DataFrame, refunded: DataFrame, as_of: Column) -> DataFrame:
    """The transactions with the senders' rows of refunds reversed, whatever their status was."""
    return _moved(_marked(tx, refunded, SENDER), F.col("status") != "reversed", status=F.lit("reversed"), processed_at=as_of, updated_at=as_of)


def outbox_completed(outbox: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    """The outbox with pending rows of ``done`` completed."""
    return _moved(_marked(outbox, done, ["id"]), F.col("status") == "pending", status=F.lit("completed"), completed_at=as_of, updated_at=as_of)


def refund_flagged(outbox: DataFrame, missing: DataFrame, as_of: Column) -> DataFrame:
    """The outbox with the rows of ``missing`` marked for a refund, free to be claimed at once."""
    return _moved(_marked(outbox, missing, ["id"]), F.lit(True), refund_required=F.lit(True), lease_until=F.lit(None).cast("timestamp"), updated_at=as_of)


def redriven(outbox: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """The outbox with failed rows of ``ids`` pending again, as if never tried."""
    none = F.lit(None).cast("timestamp")
    return _moved(_marked(outbox, ids, ["id"]), F.col("status") == "failed", status=F.lit("pending"), attempts=F.lit(0), last_error=F.lit(None).cast("string"), lease_until=none, updated_at=as_of)


def credited_balances(accounts: DataFrame, sums: DataFrame, key: str, amount: str, as_of: Column) -> DataFrame:
    """The accounts with ``amount`` of ``sums`` added to their balances; others stay."""
    by = sums.select(F.col(key).alias("account_number"), F.col(amount).alias("_d"))
    new = accounts.join(by, "account_number", "left")
    balance = (F.col("balance") + F.coalesce("_d", F.lit(0))).cast("decimal(18,2)").alias("balance")
    changed = F.when(F.col("_d").isNotNull(), as_of).otherwise(F.col("updated_at")).alias("updated_at")
    return new.select(*[{"balance": balance, "updated_at": changed}.get(c, F.col(c)) for c in accounts.columns])


def publish_claim(keys: DataFrame, as_of: Column, limit: int = PUBLISH_LIMIT, lease_s: int = PUBLISH_LEASE_S) -> DataFrame:
    """The oldest unpublished keys with a payload that nobody holds, up to ``limit``, as claimed now."""
    free = F.col("claimed_at").isNull() | (F.col("claimed_at") < _ago(as_of, lease_s))
    found = keys.where(~F.coalesce("published", F.lit(False)) & F.col("outbox_payload").isNotNull() & free).orderBy("created_at", "idempotency_key").limit(limit)
    return found.withColumn("claimed_at", as_of)


def released(keys: DataFrame, failed: DataFrame) -> DataFrame:
    """The keys with the claims of those that could not be published given back; published ones stay."""
    return _moved(_marked(keys, failed, ["idempotency_key"]), ~F.coalesce("published", F.lit(False)), claimed_at=F.lit(None).cast("timestamp"))


def refunds(outbox: DataFrame, tx: DataFrame) -> DataFrame:
    """``from_account, refunded, n``: refunds due, once per transaction that is not reversed yet."""
    due = outbox.where("refund_required and status = 'pending'").select("reference_id", "from_account", "amount")
    open_ = tx.where("status <> 'reversed'").select("reference_id", "from_account")
    return due.join(open_, ["reference_id", "from_account"], "left_semi").groupBy("from_account").agg(F.sum("amount").alias("refunded"), F.count("*").alias("n"))


def retried(outbox: DataFrame, as_of: Column, error: str) -> DataFrame:
    """Pending rows after one more failed try: credits end as failed at the limit, refunds only wait."""
    last = F.col("attempts") + 1 >= MAX_ATTEMPTS
    refund = F.col("refund_required")
    return outbox.where("status = 'pending'").select(
        "id",
        F.when(refund & last, F.col("attempts")).otherwise(F.col("attempts") + 1).alias("attempts"),
        F.when(~refund & last, "failed").otherwise("pending").alias("status"),
        F.when(~refund & last, F.lit(f"max attempts at credit: {error}")).otherwise(F.lit(error)).alias("last_error"),
        F.when(refund & last, as_of + F.make_interval(secs=F.lit(REFUND_BACKOFF_S))).alias("lease_until"),
        as_of.alias("updated_at"),
    )


def kept_outbox(outbox: DataFrame, as_of: Column, seconds: int = OUTBOX_KEPT_S) -> DataFrame:
    """The outbox without rows completed longer ago than it is kept; rows without a time stay."""
    old = (F.col("status") == "completed") & (F.col("completed_at") < _ago(as_of, seconds))
    return outbox.where(~F.coalesce(old, F.lit(False)))


def kept_applied(applied: DataFrame, as_of: Column, seconds: int = OUTBOX_KEPT_S) -> DataFrame:
    return applied.where(~F.coalesce(F.col("applied_at") < _ago(as_of, max(seconds, APPLIED_KEPT_S)), F.lit(False)))


def kept_keys(keys: DataFrame, as_of: Column, grace: int = GRACE) -> DataFrame:
    """The idempotency keys without those expired for an hour, or published longer ago than the (clamped) grace."""
    grace = max(GRACE_LEAST, min(GRACE_MOST, grace))
    dead = (F.col("expires_at") < _ago(as_of, 3600)) | (F.col("published") & (F.col("published_at") < _ago(as_of, grace)))
    return keys.where(~F.coalesce(dead, F.lit(False)))


def published(keys: DataFrame, done: DataFrame, as_of: Column) -> DataFrame:
    """The keys with those of ``done`` marked as published."""
    d = done.select("idempotency_key", F.lit(True).alias("_d")).distinct()
    marked = keys.join(d, "idempotency_key", "left")
    return marked.withColumn("published_at", F.when(F.col("_d"), as_of).otherwise(F.col("published_at"))).withColumn("published", F.coalesce(F.col("_d"), F.col("published"))).drop("_d")


def reservations(requests: DataFrame, hours: int = 24) -> DataFrame:
    """``outcome`` for each request in turn: ``reserved``, ``replay`` (same content), ``conflict`` (other content).

    ``requests``: ``key, us, hash`` and other columns. The first request of a
    key reserves it for ``hours``; the same content after that time reserves it
    anew, other content conflicts at any time.
    """
    return ordered_fold(requests, ["key"], ["us"], reserve_step(hours), dict, "outcome string")


def reserve_step(hours: int = 24) -> Step:
    """One request for a key: see :func:`reservations`."""
    life = hours * 3_600_000_000

    def step(state: dict, r: tuple) -> tuple[dict, tuple]:
        us = int(r.us)
        if not state:
            state |= {"hash": r.hash, "until": us + life}
            return state, ("reserved",)
        if state["hash"] != r.hash:
            return state, ("conflict",)
        if us >= state["until"]:
            state["until"] = us + life
            return state, ("reserved",)
        return state, ("replay",)

    return step


def flushed(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """``idempotency_key, fresh, publish`` of reservations flushed in bulk: new keys, and known ones not yet published, go out."""
    once = entries.select("idempotency_key").distinct()
    known = keys.select("idempotency_key", F.coalesce("published", F.lit(False)).alias("_p"))
    return once.join(known, "idempotency_key", "left").select("idempotency_key", F.col("_p").isNull().alias("fresh"), (~F.coalesce("_p", F.lit(False))).alias("publish"))


def routed(messages: DataFrame, text: str = "body") -> DataFrame:
    """Queue messages with ``reject_reason``: null for those to apply, else why they go to the dead letters."""
    p = wire.decoded(F.col(text))
    amount = p["amount"].try_cast("decimal(38,10)")
    reason = (
        F.when(p["from_account"].isNull() | p["to_account"].isNull() | p["amount"].isNull(), "malformed")
        .when(p["reference_id"].isNull(), "missing_reference")
        .when(amount.isNull(), "bad_amount")
        .when(amount <= 0, "check_violation")
        .when(amount > F.lit(wire.MAX_AMOUNT).cast("decimal(38,10)"), "out_of_range")
        .when((F.length(p["from_account"]) > 50) | (F.length(p["to_account"]) > 50) | (F.length(p["reference_id"]) > 100), "too_long")
    )
    return messages.select("*", reason.alias("reject_reason"))


def disposition(outcome: Column) -> Column:
    """What becomes of a message: acknowledged, put back, or to the dead letters."""
    return F.when(outcome.isin("completed", "failed", "processing", "skipped"), "ack").when(outcome == "poison", "dlq").otherwise("requeue")


def invalidated(tx: DataFrame) -> DataFrame:
    """``cache_key``: the cached views that committed transactions make stale."""
    keys = F.array(
        F.concat(F.lit("v1:txn:"), F.col("id")), F.concat(F.lit("v1:tx_status:"), F.col("reference_id")),
        *[F.concat(F.lit(f"v1:{p}:"), F.col(a)) for p in ("acc", "balance") for a in ("from_account", "to_account")],
    )
    return tx.select(F.explode(keys).alias("cache_key")).where("cache_key is not null").distinct()


def violations(tx: DataFrame, accounts: DataFrame, outbox: DataFrame) -> DataFrame:
    """``rule, n``: rows that break the tables' constraints."""
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    rules = [
        tx.agg(bad(F.col("amount") > 0).alias("tx_amount"), bad(F.col("status").isin("pending", "processing", "completed", "failed", "reversed")).alias("tx_status")),
        accounts.agg(bad(F.col("balance") >= 0).alias("account_balance"), bad(F.col("status").isin("active", "inactive", "blocked")).alias("account_status")),
        outbox.agg(bad(F.col("status").isin("pending", "completed", "failed")).alias("outbox_status")),
    ]
    parts = [r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in r.columns])).alias("x")).select("x.*") for r in rules]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
