"""The ledger's state changes on the known cases."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from talea.operators import ledger, reads
from talea.plans import ledger as plans
from talea.schema import ACCOUNTS, APPLIED, BATCH, OUTBOX, TRANSACTIONS

NOW = dt.datetime(2024, 6, 1)


def rows(spark, schema, *values):
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(v.get(n) for n in names) for v in values], schema)


def accounts(spark, **balances):
    return rows(spark, ACCOUNTS, *[{"account_number": k, "balance": Decimal(v), "status": "active"} for k, v in balances.items()])


def transfer(idx, frm, to, amount, ref, recv=0, send=0):
    return {"idx": idx, "id": f"t{idx}", "outbox_id": f"o{idx}", "from_account": frm, "to_account": to, "amount": Decimal(amount), "currency": "IDR", "reference_id": ref, "receiver_shard": recv, "sender_shard": send}


def applied(spark, batch, acc, history=None):
    b = rows(spark, BATCH, *batch)
    h = history if history is not None else spark.createDataFrame([], "reference_id string, from_account string")
    out = ledger.apply_batch(b, h, acc)
    after = {r.account_number: r.balance for r in ledger.balances_after(acc, b, out).collect()}
    return {r.idx: (r.outcome, r.assigned_id) for r in out.collect()}, after, b, out


def test_four_outcomes(spark):
    acc = accounts(spark, S1="100.00", S2="50.00", R="0.00")
    batch = [transfer(1, "S1", "R", "10.00", "ref-1"), transfer(2, "S2", "R", "100.00", "ref-2"), transfer(3, "S1", "R", "5.00", "ref-3", 1), transfer(4, "S1", "R", "25.00", "ref-1")]
    got, after, b, out = applied(spark, batch, acc)
    assert got == {1: ("completed", "t1"), 2: ("failed", "t2"), 3: ("processing", "t3"), 4: ("skipped", None)}
    assert after == {"S1": Decimal("85.00"), "S2": Decimal("50.00"), "R": Decimal("10.00")}
    box = ledger.outbox_rows(b, out, F.lit(NOW)).collect()
    assert [(r.id, r.reference_id, r.status) for r in box] == [("o3", "ref-3", "pending")]


def test_missing_recipient_and_running_balance(spark):
    acc = accounts(spark, S1="100.00", R="0.00")
    got, after, *_ = applied(spark, [transfer(1, "S1", "GONE", "20.00", "a")], acc)
    assert got == {1: ("failed", "t1")} and after["S1"] == Decimal("100.00")
    got, after, *_ = applied(spark, [transfer(1, "S1", "R", "60.00", "a"), transfer(2, "S1", "R", "50.00", "b"), transfer(3, "R", "S1", "60.00", "c")], acc)
    assert [got[i][0] for i in (1, 2, 3)] == ["completed", "failed", "completed"] and after == {"S1": Decimal("100.00"), "R": Decimal("0.00")}


def test_reapplied_batch_is_skipped_and_money_is_kept(spark):
    rnd = random.Random(3)
    names = [f"A{i}" for i in range(6)]
    acc = accounts(spark, **{n: "50.00" for n in names})
    batch = [transfer(i, *rnd.sample(names, 2), str(rnd.randrange(1, 40)), f"r{rnd.randrange(25)}", rnd.choice([0, 0, 1])) for i in range(40)]
    got, after, b, out = applied(spark, batch, acc)
    sent = sum(Decimal(batch[i]["amount"]) for i, (o, _) in got.items() if o == "processing")
    assert sum(after.values()) + sent == 300 and min(after.values()) >= 0
    again, *_ = applied(spark, batch, acc, b.select("reference_id", "from_account"))
    assert {o for o, _ in again.values()} == {"skipped"}
    assert applied(spark, [], acc)[0] == {}


def test_all_stored_transfers_are_applied(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    tx = lambda i, ref, at, frm="S", to="S", amount="10.00": {"id": i, "reference_id": ref, "from_account": frm, "to_account": to, "amount": Decimal(amount), "created_at": day(at), "updated_at": day(at)}
    # a row of January with a later version and a repeat, two without a reference that are alike, one that is not covered, one without a recipient
    values = [tx("a", "r1", 1), tx("a", "r1", 2), tx("a", "r1", 2), tx("b", None, 3), tx("b", None, 3), tx("c", "r2", 140, amount="500.00"), tx("d", "r3", 4, to=None)]
    rows(spark, TRANSACTIONS, *values).write.parquet(f"{tmp_path}/transactions.parquet")
    rows(spark, ACCOUNTS, {"id": "1", "account_number": "S", "balance": Decimal("100.00"), "status": "active", "updated_at": NOW}).write.parquet(f"{tmp_path}/users.parquet")
    assert {r.outcome: r.n for r in plans.ledger_apply(spark, str(tmp_path)).collect()} == {"completed": 3, "skipped": 2, "failed": 1, "poison": 1}


def test_ledger_apply_leaves_out_no_row(spark, data):
    out = {}
    for r in plans.ledger_apply(spark, data).collect():
        out[r.outcome] = out.get(r.outcome, 0) + r.n
    assert sum(out.values()) == spark.read.parquet(f"{data}/transactions.parquet").count() and out["skipped"] > 0


def test_every_transaction_has_its_invalidation_key(spark, data):
    keys = {r.cache_key for r in plans.QUERIES["invalidation_keys_all"](spark, data).collect()}
    ids = {r.id for r in spark.read.parquet(f"{data}/transactions.parquet").select("id").distinct().collect()}
    assert {k.removeprefix("v1:txn:") for k in keys if k.startswith("v1:txn:")} == ids


def test_credits_once(spark):
    acc = accounts(spark, RECIP="0.00")
    box = rows(spark, OUTBOX, {"id": "o1", "to_account": "RECIP", "amount": Decimal(500), "to_shard": 0}, {"id": "o2", "to_account": "NO", "amount": Decimal(1), "to_shard": 0}, {"id": "o3", "to_account": "RECIP", "amount": Decimal(1), "to_shard": 7}, {"id": "o4", "to_account": "RECIP", "amount": Decimal(1), "to_shard": 0})
    had = rows(spark, APPLIED, {"outbox_id": "o4", "sender_shard": 1})
    out = ledger.credit_outcomes(box.unionByName(box), had, acc, 3)
    assert {r.id: r.outcome for r in out.collect()} == {"o1": "applied", "o2": "recipient_missing", "o3": "invalid_shard", "o4": "already_applied"}
    assert [(r.to_account, r.credited, r.n) for r in ledger.credits(out).collect()] == [("RECIP", Decimal(500), 1)]


def test_retries_and_retention(spark):
    box = rows(spark, OUTBOX, *[{"id": f"{a}{r}", "attempts": a, "refund_required": r, "status": "pending"} for a in (0, 9) for r in (False, True)])
    got = {r.id: r for r in ledger.retried(box, F.lit(NOW), "down").collect()}
    assert (got["9False"].status, got["9False"].last_error) == ("failed", "max attempts at credit: down")
    assert (got["9True"].status, got["9True"].attempts) == ("pending", 9) and got["9True"].lease_until - NOW > dt.timedelta(seconds=250)
    assert (got["0True"].attempts, got["0True"].lease_until) == (1, None)
    done = rows(spark, OUTBOX, {"id": "old", "status": "completed", "completed_at": NOW - dt.timedelta(seconds=301)}, {"id": "new", "status": "completed", "completed_at": NOW - dt.timedelta(seconds=300)}, {"id": "none", "status": "completed"})
    assert sorted(r.id for r in ledger.kept_outbox(done, F.lit(NOW)).collect()) == ["new", "none"]


def test_reservations(spark):
    h = 3_600_000_000
    req = [("k", 0, "a"), ("k", 1, "a"), ("k", 2, "b"), ("k", 24 * h, "a"), ("k", 24 * h + 1, "a"), ("k", 47 * h, "a"), ("k", 48 * h, "a"), ("j", 5, "b")]
    out = ledger.reservations(spark.createDataFrame(req, "key string, us bigint, hash string")).collect()
    assert [r.outcome for r in sorted(out, key=lambda r: (r.key, r.us))] == ["reserved", "reserved", "replay", "conflict", "reserved", "replay", "replay", "reserved"]


def test_keyset_pages_cover_everything_once(spark):
    values = [{"id": f"{i:03d}", "created_at": NOW - dt.timedelta(seconds=i // 7), "amount": Decimal(1)} for i in range(60)]
    tx = rows(spark, TRANSACTIONS, *values)
    want = [v["id"] for v in sorted(values, key=lambda v: (v["created_at"], v["id"]), reverse=True)]
    got, at, last = [], None, None
    while page := reads.list_transactions(tx, 13, at, last).collect():
        got += [r.id for r in page]
        at, last = page[-1].created_at.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), page[-1].id
    assert got == want
    assert reads.list_transactions(tx, 5, "no time").count() == 5 and reads.clamped(5000, 100, 1000) == 1000 and reads.clamped(None, 100, 1000) == 100


def test_keyset_reaches_the_scan_as_a_heap(spark, data):
    plan = reads.list_transactions(spark.read.parquet(f"{data}/transactions.parquet"), 20, "2024-03-01T00:00:00Z", "8")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_status_resolution(spark):
    tx = rows(spark, TRANSACTIONS, {"id": "1", "reference_id": "a", "status": "completed", "processed_at": NOW}, {"id": "2", "reference_id": "a", "status": "reversed", "processed_at": NOW}, {"id": "3", "reference_id": "a", "status": "failed"})
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "reference_id string")
    out = reads.resolved_status(want, tx, want.where("reference_id = 'b'")).collect()
    assert {r.reference_id: r.status for r in out} == {"a": "reversed", "b": "pending", "c": "not_found"}


BOX = [{"id": "o1", "reference_id": "r1", "from_account": "S", "to_account": "R", "to_shard": 0, "amount": Decimal(5), "currency": "IDR", "status": "pending", "refund_required": False, "attempts": 0}]
TXS = [{"id": f"t{i}", "reference_id": ref, "from_account": frm, "status": s} for i, (ref, frm, s) in enumerate([("r1", "S", "processing"), ("r2", "S", "failed"), ("r3", "S", "processing"), (None, "S", "processing"), ("r1", "X", "processing")])]


def test_senders_are_completed_failed_or_reversed(spark):
    """Only rows in processing are completed or failed; a refund reverses whatever is not reversed; null keys match nothing."""
    tx, as_of = rows(spark, TRANSACTIONS, *TXS), F.lit(NOW)
    named = spark.createDataFrame([("r1", "S"), ("r2", "S"), ("r1", "S"), (None, "S")], "reference_id string, from_account string")
    state = lambda df: {r.id: (r.status, r.updated_at == NOW) for r in df.collect()}
    start = {r["id"]: (r["status"], False) for r in TXS}
    assert state(ledger.sender_completed(tx, named, as_of)) == start | {"t0": ("completed", True)}
    failed = ledger.sender_failed(tx, named, as_of, "max attempts at credit: x")
    assert state(failed) == start | {"t0": ("failed", True)} and failed.where("id = 't0'").first().failure_reason == "max attempts at credit: x"
    turned = ledger.refund_reversed(tx, named, as_of)
    assert state(turned) == start | {"t0": ("reversed", True), "t1": ("reversed", True)}
    again = ledger.refund_reversed(turned, named, F.lit(NOW + dt.timedelta(1)))
    assert state(again) == state(turned)


def test_receiver_audit_and_outbox(spark):
    acc, box = accounts(spark, R="1.00"), rows(spark, OUTBOX, *BOX, BOX[0] | {"id": "o2", "reference_id": "r2", "to_account": "GONE"}, BOX[0])
    none = spark.createDataFrame([], "reference_id string, from_account string")
    out = ledger.credit_outcomes(box, rows(spark, APPLIED), acc, 2)
    audit = ledger.receiver_audit(box, out, none, F.lit(NOW)).collect()
    assert sorted((r.reference_id, r.status) for r in audit) == [("r1", "completed"), ("r2", "failed")] and len({r.id for r in audit}) == 2
    held = spark.createDataFrame([("r1", "S")], "reference_id string, from_account string")
    assert [r.reference_id for r in ledger.receiver_audit(box, out, held, F.lit(NOW)).collect()] == ["r2"]
    once = rows(spark, APPLIED, {"outbox_id": "o1"}, {"outbox_id": "o2"})
    assert ledger.receiver_audit(box, ledger.credit_outcomes(box, once, acc, 2), none, F.lit(NOW)).count() == 0
    one = box.dropDuplicates(["id"])
    done = ledger.outbox_completed(one, out.where("outcome = 'applied'"), F.lit(NOW))
    flagged = {r.id: (r.status, r.refund_required, r.lease_until) for r in ledger.refund_flagged(done, out.where("outcome = 'recipient_missing'"), F.lit(NOW)).collect()}
    assert flagged == {"o1": ("completed", False, None), "o2": ("pending", True, None)}


def test_redriven_rows_are_as_if_never_tried(spark):
    box = rows(spark, OUTBOX, BOX[0] | {"status": "failed", "attempts": 10, "last_error": "x", "lease_until": NOW}, BOX[0] | {"id": "o2"})
    got = {r.id: (r.status, r.attempts, r.last_error, r.lease_until) for r in ledger.redriven(box, box, F.lit(NOW)).collect()}
    assert got == {"o1": ("pending", 0, None, None), "o2": ("pending", 0, None, None)}


def test_publish_claims_expire_and_are_given_back(spark):
    ago = lambda s: NOW - dt.timedelta(seconds=s)
    keys = spark.createDataFrame(
        [("free", "p", None, False, ago(9)), ("held", "p", ago(599), False, ago(9)), ("expired", "p", ago(601), False, ago(8)), ("none", None, None, False, ago(9)), ("done", "p", None, True, ago(9))],
        "idempotency_key string, outbox_payload string, claimed_at timestamp, published boolean, created_at timestamp",
    )
    claim = ledger.publish_claim(keys, F.lit(NOW)).collect()
    assert [(r.idempotency_key, r.claimed_at) for r in sorted(claim, key=lambda r: r.created_at)] == [("free", NOW), ("expired", NOW)]
    assert ledger.publish_claim(keys, F.lit(NOW), 1).first().idempotency_key == "free"
    back = {r.idempotency_key: r.claimed_at for r in ledger.released(keys.withColumn("claimed_at", F.lit(NOW)), keys.where("idempotency_key in ('held', 'done')")).collect()}
    assert back["held"] is None and back["done"] == NOW and back["free"] == NOW


def test_intake_replays_and_conflicts(spark):
    """The same content is a replay, other content under a key a conflict, and the first content stays; faults come before."""
    ask = lambda i, a, ref="ref-1", frm="ACC_1", desc=None: (i, frm, "ACC_2", a, "IDR", ref, desc)
    reqs = spark.createDataFrame([ask(1, "12.34"), ask(2, "99.99"), ask(3, "12.34"), ask(4, "0"), ask(5, "1.00", "ref-2"), ask(6, "1.00", None), ask(7, "1.00", "ref-3", "ACC_9"), ask(8, "1.00", "ref-4", desc="a\x01b")], "idx int, from_account string, to_account string, amount string, currency string, reference_id string, description string")
    none = spark.createDataFrame([], "idempotency_key string, request_hash string")
    acc = accounts(spark, ACC_1="1.00")
    got = {r.idx: r for r in ledger.intake(reqs, none, acc, 1).collect()}
    want = {1: "accepted", 2: "conflict", 3: "replay", 4: "amount must be positive", 5: "accepted", 6: "reference_id must not be empty", 7: "sender account not found", 8: "description must not contain control characters"}
    assert {i: r.outcome for i, r in got.items()} == want and {i for i, r in got.items() if r.payload} == {1, 5}
    assert {r.idx: r.outcome for r in ledger.intake(reqs, none, None, 1).collect()}[7] == "accepted"
    known = reqs.where("idx = 2").select(F.lit("txn:0:ref-1").alias("idempotency_key"), plans.wire.request_hash(*[F.col(c) for c in reqs.columns[1:]]).alias("request_hash"))
    again = {r.idx: r.outcome for r in ledger.intake(reqs, known, acc, 1).collect()}
    assert (again[1], again[2], again[3]) == ("conflict", "replay", "conflict")


def test_new_accounts(spark):
    reqs = spark.createDataFrame(
        [(1, "A1", "N", "a@x", "1"), (2, "A1", "N", "b@x", "1"), (3, "A2", "N", "a@x", "1"), (4, "OLD", "N", None, "1"), (5, None, "N", None, "1"), (6, "A3", " ", None, "1"), (7, "A4", "N", "old@x", "1"), (8, "A5", "N", None, "1"), (9, "A6", "N", None, "-1")],
        "idx int, account_number string, full_name string, email string, balance string",
    )
    acc = rows(spark, ACCOUNTS, {"account_number": "OLD", "email": "old@x", "status": "active"}, {"account_number": None, "email": None})
    got = {r.idx: (r.account_number, r.outcome) for r in ledger.new_accounts(reqs, acc).collect()}
    assert {i: o for i, (_, o) in got.items()} == {1: "created", 2: "number_taken", 3: "email_taken", 4: "number_taken", 5: "created", 6: "full_name must not be empty", 7: "email_taken", 8: "created", 9: "initial_balance must not be negative"}
    assert got[5][0].startswith("ACC_") and len(got[5][0]) == 11
    taken = rows(spark, ACCOUNTS, {"account_number": got[5][0]})
    other = {r.idx: r.account_number for r in ledger.new_accounts(reqs, taken).collect()}[5]
    assert other != got[5][0] and other.startswith("ACC_")


def test_admin_filters_and_clamps(spark):
    box = rows(spark, OUTBOX, *[BOX[0] | {"id": f"f{i}", "status": "failed"} for i in range(3)], BOX[0] | {"id": "s", "refund_required": True, "attempts": 10})
    assert reads.admin_outbox(box, "failed", 0).count() == 1 and reads.admin_outbox(box, "failed").count() == 3
    assert [r.id for r in reads.admin_outbox(box, "refund-stuck").collect()] == ["s"]
    try:
        reads.admin_outbox(box, "other")
    except ValueError:
        return
    raise AssertionError


def test_cursor_buckets_round_down_before_1970_too(spark):
    df = spark.sql("select timestamp_micros(x) as t from values (-1L), (0L), (4999999L), (5000000L) as v(x)")
    assert [r.b for r in df.select(reads.bucket(F.col("t")).alias("b")).collect()] == [-5, 0, 0, 5]
