"""The recorded events as requests and as database activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talea.sources.tables import table


def micros(c: str) -> Column:
    """Microseconds since 1970 of a time without zone, read as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """``id, us, client, method, path, status, duration_s``: an event's type says what was called, its value how long it took."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), micros("ts").alias("us"), F.col("user_id").alias("client"),
        F.when(kind.isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), kind).alias("path"),
        F.when(kind == "error", "503").when(kind == "purchase", "202").when((kind == "signup") & (F.col("value") > 50), "429").otherwise("200").alias("status"),
        (F.col("value") / 100).alias("duration_s"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def activity(spark: SparkSession, d: str) -> DataFrame:
    """The requests as backends of a database at work."""
    r, k = requests(spark, d), F.col("k")
    text = (
        F.when(F.col("path") == "/view", "SELECT id,\n  status FROM transactions WHERE reference_id = $1")
        .when(F.col("path") == "/click", "select balance FROM users WHERE account_number = $1")
        .when(F.col("path") == "/purchase", "SELECT * FROM transactions  WHERE created_at < $1 ORDER BY created_at DESC")
        .otherwise("UPDATE cross_shard_outbox SET attempts = attempts + 1")
    )
    waits = F.when(k % 5 == 0, "Lock").when(k % 5 == 1, "IO").when(k % 5 == 2, "LWLock")
    return r.select(
        F.col("id").alias("pid"),
        F.when(k % 11 == 0, "walsender").otherwise("client backend").alias("backend_type"),
        F.when(k % 4 == 0, "idle").when(k % 4 == 1, "idle in transaction").otherwise("active").alias("state"),
        waits.alias("wait_event_type"),
        F.when(k % 10 == 0, "transactionid").when(k % 5 == 0, "tuple").when(k % 5 == 1, "DataFileRead").when(k % 5 == 2, "BufferMapping").alias("wait_event"),
        text.alias("query"), F.col("us").alias("query_start"),
        F.when(k % 5 == 0, F.array(F.col("id") - 1, F.col("id") - 2)).alias("blocked_by"),
    )


def locks(spark: SparkSession, d: str) -> DataFrame:
    """``pid, mode, granted, relation``: the requests as locks held or waited for."""
    r, k = requests(spark, d), F.col("k")
    mode = F.when(k % 3 == 0, "ExclusiveLock").when(k % 3 == 1, "RowExclusiveLock").otherwise("AccessShareLock")
    return r.select(F.col("id").alias("pid"), mode.alias("mode"), (k % 5 != 0).alias("granted"), F.col("path").alias("relation"))


def replication(spark: SparkSession, d: str) -> DataFrame:
    """``replica, id, us, sent_lsn, replay_lsn, state``: the requests as reports of replicas and their receivers."""
    r = requests(spark, d)
    state = F.when(F.col("k") > 95, "catchup").otherwise("streaming")
    return r.select(F.concat(F.lit("replica-"), (F.col("client") % 3).cast("string")).alias("replica"), "id", "us", (F.col("id") * 100).alias("sent_lsn"), (F.col("id") * 100 - F.col("k")).alias("replay_lsn"), state.alias("state"))
