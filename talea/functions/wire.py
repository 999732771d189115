"""Hashes, keys, payloads and checks of requests, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talea.schema import PAYLOAD

# FNV-1a of 64 bits, as two halves of 32, and the byte that ends a hashed string.
FNV_HI, FNV_LO, FNV_PRIME_LOW, END = 0xCBF29CE4, 0x84222325, 0x1B3, 0xFF
# Limits of a request's fields.
MAX_ACCOUNT, MAX_REFERENCE, MAX_DESCRIPTION, CURRENCY, MAX_SCALE = 50, 100, 500, 3, 2
MAX_AMOUNT = "9999999999999999.99"


def fnv_shard(c: Column | str, shards: int = 2) -> Column:
    """FNV-1a (64 bits, over the UTF-8 bytes and a closing 0xFF) modulo ``shards``; null for null.

    The product with the prime 2^40 + 435 is taken in halves of 32 bits, which
    never overflow a bigint.
    """
    c = F.col(c) if isinstance(c, str) else c
    raw = F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))
    n = (F.length(raw) / 2).cast("int")
    byte = lambda i: F.conv(F.substring(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")
    bytes_ = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), byte)).otherwise(F.array().cast("array<bigint>"))
    half = 1 << 32

    def step(a: Column, b: Column) -> Column:
        lo = a["lo"].bitwiseXOR(b)
        low = lo * FNV_PRIME_LOW
        high = a["hi"] * FNV_PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(lo, 8)
        return F.struct(high.bitwiseAND(half - 1).alias("hi"), low.bitwiseAND(half - 1).alias("lo"))

    start = F.struct(F.lit(FNV_HI).cast("bigint").alias("hi"), F.lit(FNV_LO).cast("bigint").alias("lo"))
    rest = lambda a: ((a["hi"] % shards) * (half % shards) + a["lo"] % shards) % shards
    return F.when(c.isNotNull(), F.aggregate(F.concat(bytes_, F.array(F.lit(END).cast("bigint"))), start, step, rest).cast("int"))


def request_hash(frm: Column, to: Column, amount: Column, currency: Column, reference: Column, description: Column) -> Column:
    """SHA-256 over the six fields, each closed by 0xFF; a null description counts as empty, amounts as written."""
    end = F.unhex(F.lit("FF"))
    parts = [F.encode(c, "UTF-8") for c in (frm, to, amount, currency, reference, F.coalesce(description, F.lit("")))]
    return F.sha2(F.concat(*[x for p in parts for x in (p, end)]), 256)


def idempotency_key(shard: Column, reference: Column) -> Column:
    return F.concat(F.lit("txn:"), shard.cast("string"), F.lit(":"), reference)


def payload(**fields: Column) -> Column:
    """The queue's JSON; a null description is written, a null trace is not."""
    body = F.struct(*[v.alias(k) for k, v in fields.items() if k != "traceparent"])
    text = F.to_json(body, {"ignoreNullFields": "false"})
    if "traceparent" not in fields:
        return text
    trace = F.to_json(F.struct(fields["traceparent"].alias("traceparent")))
    return F.when(fields["traceparent"].isNull(), text).otherwise(F.concat(F.expr("''"), F.substring(text, F.lit(1), F.length(text) - 1), F.lit(","), F.substring(trace, F.lit(2), F.length(trace))))


def decoded(text: Column) -> Column:
    """The payload's fields; all null where the text is no JSON object."""
    return F.from_json(text, PAYLOAD)


# The texts of all errors below are part of the interface.
_ENDS, _CHARS = r"\A[A-Za-z0-9](?s:.*[A-Za-z0-9])?\z", r"\A[A-Za-z0-9._-]*\z"


def account_error(c: Column, field: str) -> Column:
    """The first rule that an account breaks, or null."""
    return (
        F.when(c.isNull() | (c == ""), f"{field} must not be empty")
        .when(F.octet_length(c) > MAX_ACCOUNT, f"{field} must be at most {MAX_ACCOUNT} characters")
        .when(~c.rlike(_ENDS), f"{field} must start and end with an alphanumeric character")
        .when(~c.rlike(_CHARS), f"{field} contains invalid characters")
    )


def amount_error(text: Column) -> Column:
    """The first rule that an amount, as written, breaks. Text that is no plain decimal is no amount."""
    shape = r"\A[+-]?\d+(\.\d*)?\z"
    number = F.when(text.rlike(shape), text.try_cast("decimal(38,10)"))
    scale = F.length(F.regexp_extract(text, r"\.(\d*)\z", 1))
    return (
        F.when(text.isNull() | ~text.rlike(shape), "amount must be a decimal")
        .when(number <= 0, "amount must be positive")
        .when(scale > MAX_SCALE, f"amount must have at most {MAX_SCALE} decimal places")
        .when(number.isNull() | (number > F.lit(MAX_AMOUNT).cast("decimal(38,10)")), "amount exceeds maximum DECIMAL(18, 2) value")
    )


def reference_error(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == ""), "reference_id must not be empty")
        .when(F.octet_length(c) > MAX_REFERENCE, f"reference_id must be at most {MAX_REFERENCE} characters")
        .when(~c.rlike(_CHARS), "reference_id must be ASCII alphanumeric, '-', '_' or '.'")
    )


def currency_error(c: Column) -> Column:
    return F.when(c.isNull() | (F.octet_length(c) != CURRENCY), f"currency must be exactly {CURRENCY} characters").when(
        ~c.rlike(r"\A[A-Z]{3}\z"), "currency must be uppercase ASCII (e.g. IDR, USD)"
    )


def description_error(c: Column) -> Column:
    return F.when(F.octet_length(c) > MAX_DESCRIPTION, f"description must be at most {MAX_DESCRIPTION} characters").when(
        c.rlike(r"[\p{Cc}&&[^\t]]"), "description must not contain control characters"
    )


def request_error(frm: Column, to: Column, amount: Column, currency: Column, reference: Column, description: Column) -> Column:
    """The first rule that a request breaks, in the order of the checks; null for a valid one."""
    same = F.when(F.lower(frm) == F.lower(to), "from_account and to_account must be different")
    return F.coalesce(
        account_error(frm, "from_account"), account_error(to, "to_account"), same, amount_error(amount), currency_error(currency), reference_error(reference), description_error(description)
    )


def new_account_error(number: Column, name: Column, email: Column, balance: Column) -> Column:
    """The first rule that a new account breaks: Unicode letters and digits are allowed in its number."""
    amount = balance.try_cast("decimal(38,10)")
    return (
        F.when(number.isNull() | (F.trim(number) == ""), "account_number must not be empty")
        .when(F.octet_length(number) > MAX_ACCOUNT, f"account_number must be at most {MAX_ACCOUNT} characters")
        .when(~number.rlike(r"\A[\p{IsAlphabetic}\p{N}._-]+\z"), "account_number contains invalid characters")
        .when(name.isNull() | (F.trim(name) == ""), "full_name must not be empty")
        .when(F.length(name) > 150, "full_name must be at most 150 characters")
        .when(email.isNotNull() & (F.length(email) > 150), "email must be at most 150 characters")
        .when(email.isNotNull() & ~email.rlike(r"\A[^@]+@[^@]+\z"), "email is invalid")
        .when(amount.isNull(), "initial_balance must be a decimal")
        .when(amount < 0, "initial_balance must not be negative")
        .when(F.length(F.regexp_extract(balance, r"\.(\d*)\z", 1)) > MAX_SCALE, f"initial_balance must have at most {MAX_SCALE} decimal places")
    )
