"""The recorded events as scraped metric samples: ``metric, labels, t, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talea.operators.telemetry import BUCKETS, accumulated, tick
from talea.sources.events import requests

# The names of the counters, and the label that tells a counter's series apart.
COUNTERS = (
    ("transactions_created_total", "shard"), ("transactions_processed_total", "shard"), ("idempotency_hits_total", None), ("idempotency_redis_replay_total", None),
    ("rate_limited_total", None), ("backpressure_shed_total", None), ("rabbitmq_reconnections_total", None), ("cross_shard_step_failures_total", "step"),
    ("cross_shard_outbox_terminal_failures_total", "step"), ("cross_shard_refund_stuck_total", None), ("dlq_messages_total", None), ("publish_outbox_shipped_total", "shard"),
    ("publish_outbox_publish_failures_total", "shard"), ("publish_outbox_iteration_errors_total", "shard"), ("amqp_publish_nack_total", None), ("amqp_publish_return_total", None),
    ("amqp_consumer_cancel_total", None), ("amqp_channel_close_total", "side"), ("db_replica_failover_total", None), ("db_replica_recovered_total", None),
    ("redis_master_failover_total", None), ("notifications_events_lagged_total", None), ("events_publish_errors_total", None), ("db_retry_attempt_total", None),
    ("db_retry_success_total", None), ("db_retry_exhausted_total", None), ("notifications_appended_total", None), ("events_published_total", None),
    ("db_read_fallback_to_primary_total", "shard"), ("rate_limiter_redis_sync_failures_total", "kind"), ("cache_hits_total", None), ("cache_misses_total", None),
)
# Counters and gauges of containers, and gauges of the service.
CONTAINER_COUNTERS = ("container_cpu_usage_seconds_total", "container_network_receive_bytes_total", "container_network_transmit_bytes_total")
MEMORY = "container_memory_working_set_bytes"
REQUEST_BUCKETS = "http_request_duration_seconds_bucket"
#: How a container's name is read from its path, and which containers are kept.
RELABEL, KEEP = r"^/(.*)$", r"(app|pg|cache)-.*"


def _label() -> Column:
    """The value of the label that a counter has."""
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("id") % len(v)).cast("int") + 1)
    return (
        F.when(F.col("key") == "shard", (F.col("client") % 3).cast("string")).when(F.col("key") == "step", pick("credit", "debit", "refund"))
        .when(F.col("key") == "side", pick("consumer", "publisher")).when(F.col("key") == "kind", pick("global", "local"))
    )


def relabelled(path: Column) -> Column:
    """A container's name; null for those not kept."""
    name = F.regexp_extract(path, RELABEL, 1)
    return F.when(name.rlike(rf"\A(?:{KEEP})\z"), name)


def metric_samples(spark: SparkSession, d: str, step: int, life: int) -> DataFrame:
    """Counters, histogram buckets and gauges as scrapes every ``step`` s see them; counters restart every ``life`` s.

    Each event counts for one counter, for its container and for its bucket,
    and moves the gauges. Everything is summed per series and scrape first.
    """
    r = requests(spark, d).withColumn("t", tick("us", step))
    path = F.concat(F.when(F.col("client") % 7 == 6, "/other-").when(F.col("client") % 3 == 0, "/app-").when(F.col("client") % 3 == 1, "/pg-").otherwise("/cache-"), (F.col("client") % 4).cast("string"))
    nth = (F.col("k") % len(COUNTERS)).cast("int") + 1
    one = r.select("t", "id", "client", F.element_at(F.array(*[F.lit(m) for m, _ in COUNTERS]), nth).alias("metric"), F.element_at(F.array(*[F.lit(x) for _, x in COUNTERS]), nth).alias("key"))
    labels = F.when(F.col("key").isNotNull(), F.concat(F.lit('{"'), "key", F.lit('":"'), _label(), F.lit('"}'))).otherwise("{}")
    counts = one.groupBy("metric", labels.alias("series"), "t").agg(F.count("*").alias("c"))
    boxes = r.select("t", "k", relabelled(path).alias("name")).where("name is not null").groupBy(F.concat(F.lit('{"name":"'), "name", F.lit('"}')).alias("series"), "t")
    boxes = boxes.agg(*[F.sum(F.col("k") * (10**i)).alias(m) for i, m in enumerate(CONTAINER_COUNTERS)], (F.max("k") * 1000).cast("double").alias(MEMORY))
    unpivoted = lambda df, *names: F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("c")) for m in names])).alias("x")
    used = boxes.select("series", "t", unpivoted(boxes, *CONTAINER_COUNTERS)).select("x.metric", "series", "t", "x.c")
    by = ["method", "path", "t"]
    wide = r.groupBy(*by).agg(*[F.count_if(F.col("duration_s") <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)], F.count("duration_s").alias("b_inf"))
    bounds = [*[(str(b), f"b{i}") for i, b in enumerate(BUCKETS)], ("+Inf", "b_inf")]
    long = wide.select(*by, F.explode(F.array(*[F.struct(F.lit(le).alias("le"), F.col(c).alias("c")) for le, c in bounds])).alias("x"))
    series = F.concat(*[x for n, c in (("method", F.col("method")), ("path", F.col("path")), ("le", F.col("x.le"))) for x in (F.lit('{"' if n == "method" else '","'), F.lit(n), F.lit('":"'), c)], F.lit('"}'))
    buckets = long.select(F.lit(REQUEST_BUCKETS).alias("metric"), series.alias("series"), "t", F.col("x.c").alias("c"))
    counters = accumulated(counts.unionByName(used).unionByName(buckets), ["metric", "series"], step, life)
    held = boxes.select(F.lit(MEMORY).alias("metric"), "series", "t", F.col(MEMORY).alias("value"))
    shard = r.groupBy((F.col("client") % 3).cast("string").alias("shard"), (F.col("client") % 2).cast("string").alias("instance"), "t").agg(
        (F.max("k") < 97).cast("double").alias("up"), F.max(F.col("k") % 3).cast("double").alias("circuit_breaker_state"), F.sum("k").cast("double").alias("transactions_intake_pending"),
        F.count("*").cast("double").alias("backpressure_in_flight"), (F.min("k") < 2).cast("double").alias("degradation_mode"), F.avg("k").alias("transactions_batch_size"),
    )
    names = shard.columns[3:]
    tagged = F.concat(F.lit('{"shard":"'), "shard", F.lit('","instance":"'), "instance", F.lit('"}')).alias("series")
    gauges = shard.select(tagged, "t", unpivoted(shard, *names)).select("x.metric", "series", "t", F.col("x.c").alias("value"))
    every = counters.unionByName(held).unionByName(gauges)
    return every.select("metric", F.from_json("series", "map<string,string>").alias("labels"), "series", "t", "value")
