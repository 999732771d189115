"""Hashes, keys and checks against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from talea.functions import keys, wire


def fnv(text, n):
    h = 0xCBF29CE484222325
    for b in text.encode() + b"\xff":
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h % n


def test_shards(spark):
    rnd = random.Random(0)
    texts = ["", "ACC_0000001", "é😀", "\x00"] + ["".join(chr(rnd.choice([rnd.randrange(1, 127), rnd.randrange(0x400, 0x500)])) for _ in range(rnd.randrange(30))) for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", wire.fnv_shard("t", 2).alias("a"), wire.fnv_shard("t", 3).alias("b"))
    for r in df.collect():
        assert (r.a, r.b) == ((None, None) if r.t is None else (fnv(r.t, 2), fnv(r.t, 3))), r.t


def test_request_hash(spark):
    fields = ("A", "B", "10.0", "IDR", "r", None)
    c = [F.lit(x).cast("string") for x in fields]
    got = spark.range(1).select(wire.request_hash(*c)).first()[0]
    assert got == hashlib.sha256(b"".join((x or "").encode() + b"\xff" for x in fields)).hexdigest()
    assert got != spark.range(1).select(wire.request_hash(c[0], c[1], F.lit("10.00"), *c[3:])).first()[0]


def test_request_errors(spark):
    good = ("ACC_1", "ACC_2", "1.00", "IDR", "r", None)
    cases = [
        (good, None), (("", *good[1:]), "from_account must not be empty"), (("x" * 51, *good[1:]), "from_account must be at most 50 characters"), (("A\n", *good[1:]), "from_account must start and end with an alphanumeric character"),
        (("A b", *good[1:]), "from_account contains invalid characters"), (("acc_2", *good[1:]), "from_account and to_account must be different"), ((*good[:2], "0", *good[3:]), "amount must be positive"),
        ((*good[:2], "1.001", *good[3:]), "amount must have at most 2 decimal places"), ((*good[:2], "10000000000000000", *good[3:]), "amount exceeds maximum DECIMAL(18, 2) value"), ((*good[:2], "9" * 60, *good[3:]), "amount exceeds maximum DECIMAL(18, 2) value"),
        ((*good[:2], "abc", *good[3:]), "amount must be a decimal"), ((*good[:3], "idr", *good[4:]), "currency must be uppercase ASCII (e.g. IDR, USD)"), ((*good[:4], "ü", None), "reference_id must be ASCII alphanumeric, '-', '_' or '.'"),
        ((*good[:5], "a\x07"), "description must not contain control characters"), ((*good[:5], "a\tb"), None), ((*good[:5], "é" * 251), "description must be at most 500 characters"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "a string, b string, c string, d string, e string, f string")
    got = [r[0] for r in df.select(wire.request_error(*[F.col(x) for x in "abcdef"])).collect()]
    assert got == [e for _, e in cases]


def test_payload_round_trip(spark):
    body = wire.payload(from_account=F.lit("A"), to_account=F.lit("B"), amount=F.lit("1.50"), currency=F.lit("IDR"), reference_id=F.lit("r"), description=F.lit(None).cast("string"), traceparent=F.col("t"))
    out = spark.createDataFrame([("00-1",), (None,)], "t string").select(body.alias("b"), wire.decoded(body)["amount"].alias("a")).collect()
    assert out[1].b == '{"from_account":"A","to_account":"B","amount":"1.50","currency":"IDR","reference_id":"r","description":null}' and out[0].b.endswith(',"traceparent":"00-1"}') and out[0].a == "1.50"


def test_keys_days_and_numbers(spark):
    df = spark.createDataFrame([(" \tacc_1 ", "1,234.50", 0), ("  ", "+4.0000E+2", -1), (None, "x", None), ("A\xa0", "000000001.50", 86_400_000_000)], "a string, n string, us bigint")
    got = df.select(keys.account_key("a"), keys.number("n", 2).cast("string"), keys.utc_day(F.timestamp_micros("us")).cast("string")).collect()
    assert [tuple(r) for r in got] == [("ACC_1", "1234.50", "1970-01-01"), (None, "400.00", "1969-12-31"), (None, None, None), ("A\xa0", "1.50", "1970-01-02")]
