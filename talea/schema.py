"""Explicit schemas of the ledger's tables and records."""

from __future__ import annotations

ACCOUNTS = (
    "id string, account_number string, full_name string, email string, balance decimal(18,2), status string, "
    "created_at timestamp, updated_at timestamp"
)
TRANSACTIONS = (
    "id string, from_account string, to_account string, amount decimal(18,2), currency string, status string, "
    "reference_id string, description string, failure_reason string, created_at timestamp, updated_at timestamp, processed_at timestamp"
)
OUTBOX = (
    "id string, from_account string, to_account string, to_shard int, amount decimal(18,2), currency string, reference_id string, "
    "description string, status string, refund_required boolean, attempts int, last_error string, lease_until timestamp, "
    "created_at timestamp, updated_at timestamp, completed_at timestamp"
)
APPLIED = "sender_shard int, outbox_id string, applied_at timestamp"
IDEMPOTENCY = (
    "id string, idempotency_key string, request_hash string, status string, response_payload string, outbox_payload string, "
    "published boolean, published_at timestamp, claimed_at timestamp, expires_at timestamp, created_at timestamp, updated_at timestamp"
)
BATCH = (
    "idx int, id string, outbox_id string, from_account string, to_account string, amount decimal(18,2), currency string, "
    "reference_id string, description string, receiver_shard int, sender_shard int"
)
#: The queue's payload: the amount travels as text.
PAYLOAD = (
    "from_account string, to_account string, amount string, currency string, reference_id string, description string, "
    "request_id string, shard int, idempotency_key string, request_hash string, traceparent string"
)
EVENT = "id string, name string, occurred_at timestamp, payload string"
COMMITTED = "id string, from_account string, to_account string, amount string, currency string, reference_id string, shard int"
METRIC_SAMPLES = "ts bigint, metric string, labels map<string,string>, value double"
