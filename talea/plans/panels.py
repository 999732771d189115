"""The dashboards' panels and the alerts over scraped metric samples, and their SQL.

``panel`` names what a panel shows; ``label`` is the series' label, if it has
one. Rates are over WINDOW s, in place of the dashboards' own interval.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talea.operators import telemetry, vectors
from talea.plans.telemetry import LIFE, REQ, STEP
from talea.session import stored
from talea.sources import metrics

WINDOW = 1800
#: Panels that show a rate, summed, or by the label named.
RATES = {
    "created": ("transactions_created_total", None), "processed": ("transactions_processed_total", None), "rate_limited": ("rate_limited_total", None), "shed": ("backpressure_shed_total", None),
    "step_failures": ("cross_shard_step_failures_total", "step"), "terminal_failures": ("cross_shard_outbox_terminal_failures_total", "step"), "refund_stuck": ("cross_shard_refund_stuck_total", None),
    "dead_letters": ("dlq_messages_total", None), "shipped": ("publish_outbox_shipped_total", "shard"), "publish_failures": ("publish_outbox_publish_failures_total", "shard"),
    "iteration_errors": ("publish_outbox_iteration_errors_total", "shard"), "nack": ("amqp_publish_nack_total", None), "returned": ("amqp_publish_return_total", None),
    "consumer_cancel": ("amqp_consumer_cancel_total", None), "channel_close": ("amqp_channel_close_total", "side"), "events_lagged": ("notifications_events_lagged_total", None),
    "publish_errors": ("events_publish_errors_total", None), "retry_attempts": ("db_retry_attempt_total", None), "retry_recovered": ("db_retry_success_total", None),
    "retry_exhausted": ("db_retry_exhausted_total", None), "notifications": ("notifications_appended_total", None), "events_published": ("events_published_total", None),
    "received": ("container_network_receive_bytes_total", "name"), "sent": ("container_network_transmit_bytes_total", "name"), "cpu": ("container_cpu_usage_seconds_total", "name"),
}
#: Panels that show a counter's last value, summed over its series.
TOTALS = {
    "created": "transactions_created_total", "processed": "transactions_processed_total", "reconnections": "rabbitmq_reconnections_total", "step_failures": "cross_shard_step_failures_total",
    "replica_failovers": "db_replica_failover_total", "replicas_recovered": "db_replica_recovered_total", "master_failovers": "redis_master_failover_total",
}
#: Panels over gauges: metric, how values are combined, by which label, and which values count.
GAUGES = {
    "replicas": ("up", "count", None, "value = 1"), "breaker": ("circuit_breaker_state", "max", None, "true"), "batch_size": ("transactions_batch_size", "avg", "shard", "true"),
    "in_flight": ("backpressure_in_flight", "sum", None, "true"), "memory": (metrics.MEMORY, "max", "name", "true"), "memory_total": (metrics.MEMORY, "sum", None, "true"),
    "containers": (metrics.MEMORY, "count", None, "true"),
}
#: Alerts: counter, by which label, seconds of the rate, what it must exceed, for how long, and the label's value where it is fixed.
ALERTS = {
    "replica_fallback": ("db_read_fallback_to_primary_total", "shard", 1200, 0.0, 1200, None), "credit_terminal_failure": ("cross_shard_outbox_terminal_failures_total", "step", 1800, 0.0, 1200, "credit"),
    "refund_stuck": ("cross_shard_refund_stuck_total", None, 3600, 0.0003, 1800, None), "limiter_sync": ("rate_limiter_redis_sync_failures_total", "kind", 1800, 0.0005, 1200, None),
}


def samples(spark: SparkSession, d: str) -> DataFrame:
    """All samples, written once: several vectors are taken from them."""
    return stored(metrics.metric_samples(spark, d, STEP, LIFE))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _panel(name: str, vector: DataFrame, label: str | None = None) -> DataFrame:
    return vector.select(F.lit(name).alias("panel"), (F.col(label) if label else F.lit("")).alias("label"), "t", F.round("value", 9).alias("value"))


def _how(name: str) -> Column:
    return {"sum": F.sum("value"), "max": F.max("value"), "avg": F.avg("value"), "count": F.count("value").cast("double")}[name]


def metric_samples(spark: SparkSession, d: str) -> DataFrame:
    """Of each metric and series: samples, the greatest and the last value."""
    s = metrics.metric_samples(spark, d, STEP, LIFE)
    return s.groupBy("metric", "series").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("most"), F.round(F.max_by("value", "t"), 6).alias("last"))


def panel_rates(spark: SparkSession, d: str) -> DataFrame:
    """The panels of rates: one pass over all counters, then each panel's own label."""
    s = metrics.metric_samples(spark, d, STEP, LIFE)
    names = F.create_map(*[F.lit(x) for panel, (metric, _) in RATES.items() for x in (metric, panel)])
    keys = F.create_map(*[F.lit(x) for panel, (_, key) in RATES.items() for x in (panel, key or "")])
    r = telemetry.rate(s.where(F.col("metric").isin([m for m, _ in RATES.values()])), ["metric", "series"], WINDOW)
    r = r.withColumn("panel", names[F.col("metric")])
    label = F.coalesce(F.from_json("series", "map<string,string>")[keys[F.col("panel")]], F.lit(""))
    return r.withColumn("label", F.when(keys[F.col("panel")] == "", "").otherwise(label)).groupBy("panel", "label", "t").agg(F.round(F.sum("rate"), 9).alias("value"))


def panel_totals(spark: SparkSession, d: str) -> DataFrame:
    """The panels of last values, and the replays: two counters' sums added where both are seen."""
    s = samples(spark, d)
    total = lambda metric: vectors.aggregated(vectors.instant(s, metric), F.sum("value"))
    replays = vectors.matched(total("idempotency_hits_total"), total("idempotency_redis_replay_total"), F.col("a") + F.col("b"))
    return _union([*[_panel(p, total(m)) for p, m in TOTALS.items()], _panel("replays", replays)])


def panel_gauges(spark: SparkSession, d: str) -> DataFrame:
    """The panels of gauges: counts of matches, greatest and mean values, sums, and the sum of the shards' greatest."""
    s = samples(spark, d)
    parts = []
    for panel, (metric, how, key, which) in GAUGES.items():
        v = vectors.instant(s, metric, *([key] if key else [])).where(which)
        parts.append(_panel(panel, vectors.aggregated(v, _how(how), *([key] if key else [])), key))
    pending = vectors.aggregated(vectors.instant(s, "transactions_intake_pending", "shard"), F.max("value"), "shard")
    databases = vectors.aggregated(vectors.instant(s, metrics.MEMORY, "name", name="pg-.*"), F.max("value"), "name")
    return _union([*parts, _panel("pending", vectors.aggregated(pending, F.sum("value"))), _panel("memory_databases", databases, "name")])


def panel_containers(spark: SparkSession, d: str) -> DataFrame:
    """Processor time and memory of containers: of the application, in all, and the five greatest at each scrape."""
    s = samples(spark, d)
    cpu = vectors.rate(s, metrics.CONTAINER_COUNTERS[0], WINDOW, "name")
    percent = vectors.aggregated(cpu, F.round(F.sum("value") * 100, 9), "name")
    memory = vectors.instant(s, metrics.MEMORY, "name").drop("series")
    app = vectors.aggregated(vectors.rate(s, metrics.CONTAINER_COUNTERS[0], WINDOW, "name", name="app-.*"), F.sum("value") * 100, "name")
    whole = [vectors.aggregated(vectors.rate(s, m, WINDOW), F.sum("value") * (100 if i == 0 else 1)) for i, m in enumerate(metrics.CONTAINER_COUNTERS)]
    parts = [_panel("cpu_app", app, "name"), _panel("cpu_top", vectors.top(percent, 5, ["name"]), "name"), _panel("memory_top", vectors.top(memory, 5, ["name"]), "name")]
    return _union([*parts, *[_panel(n, v) for n, v in zip(("cpu_total", "received_total", "sent_total"), whole)]])


def request_rates(spark: SparkSession, d: str) -> DataFrame:
    """Shares and rates of requests by outcome and by method and path, and the cache's hits: null where nothing was asked."""
    s = samples(spark, d)
    r = telemetry.rate(telemetry.scraped(metrics.requests(spark, d), ["method", "path", "status"], "us", STEP, LIFE), ["method", "path", "status"], WINDOW)
    by = lambda p: F.sum(F.when(telemetry.matching("status", p), F.col("rate")).otherwise(0.0))
    wide = r.groupBy("t").agg(F.sum("rate").alias("total"), *[by(p).alias(n) for n, p in (("ok", "200"), ("accepted", "202"), ("e4", "4.."), ("e5", "5.."))])
    least = F.greatest("total", F.lit(0.001))
    shares = wide.select("*", (F.col("e5") / least * 100).alias("e5_percent"), (F.col("e4") / least * 100).alias("e4_percent"))
    names = [c for c in shares.columns if c != "t"]
    flat = shares.select("t", F.explode(F.array(*[F.struct(F.lit(c).alias("panel"), F.col(c).alias("value")) for c in names])).alias("x")).select("x.panel", "t", "x.value")
    parts = [flat.select("panel", F.lit("").alias("label"), "t", F.round("value", 9).alias("value"))]
    parts.append(r.groupBy(F.concat_ws(" ", "method", "path").alias("label"), "t").agg(F.round(F.sum("rate"), 9).alias("value")).select(F.lit("by_path").alias("panel"), "label", "t", "value"))
    one = lambda m: vectors.aggregated(vectors.rate(s, m, WINDOW), F.sum("value"))
    limited = vectors.matched(one("rate_limited_total"), wide.select("t", F.col("total").alias("value")), F.col("a") / F.greatest("b", F.lit(0.001)) * 100)
    hits = vectors.matched(one("cache_hits_total"), one("cache_misses_total"), F.try_divide("a", F.col("a") + F.col("b")))
    return _union([*parts, _panel("limited_percent", limited), _panel("hit_ratio", hits)])


def rate_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Latency percentiles over the rates of the buckets: of all requests, and the 90th by method and path."""
    s = samples(spark, d)
    parts = [_panel(f"p{q * 100:g}", vectors.quantile_of_rates(s, metrics.REQUEST_BUCKETS, q, WINDOW)) for q in (0.5, 0.9, 0.95, 0.99)]
    paths = vectors.quantile_of_rates(s, metrics.REQUEST_BUCKETS, 0.9, WINDOW, "method", "path").withColumn("route", F.concat_ws(" ", "method", "path"))
    return _union([*parts, _panel("p90_by_path", paths, "route")])


def rule_alerts(spark: SparkSession, d: str) -> DataFrame:
    """``alert, label, since, until, firing_from``: the alerts over counters, and the one over the degradation gauge."""
    s = samples(spark, d)
    parts = []
    for name, (metric, key, seconds, over, hold, only) in ALERTS.items():
        keys, which = [key] if key else [], {key: only} if only else {}
        v = vectors.aggregated(vectors.rate(s, metric, seconds, *keys, **which), F.sum("value"), *keys)
        breach = F.col("value") > over
        parts.append(telemetry.held(v.withColumn("alert", F.lit(name)).withColumn("label", F.col(key) if key else F.lit("")), ["alert", "label"], breach, hold))
    mode = vectors.aggregated(vectors.instant(s, "degradation_mode"), F.max("value"))
    parts.append(telemetry.held(mode.withColumn("alert", F.lit("degradation")).withColumn("label", F.lit("")), ["alert", "label"], F.col("value") > 0, 1200))
    return _union(parts)


def latest_scalars(spark: SparkSession, d: str) -> DataFrame:
    """What a client that asks for one number gets: a value, the zero that stands in for none, and null for none."""
    s = samples(spark, d)
    total = vectors.aggregated(vectors.instant(s, "transactions_created_total"), F.sum("value"))
    none = vectors.aggregated(vectors.instant(s, "no_such_metric"), F.sum("value"))
    asked = {"created": total, "missing": none, "missing_or_zero": vectors.or_zero(none, total)}
    return _union([vectors.scalar(v).select(F.lit(n).alias("name"), "value") for n, v in asked.items()])


QUERIES = {f.__name__: f for f in (metric_samples, panel_rates, panel_totals, panel_gauges, panel_containers, request_rates, rate_quantiles, rule_alerts, latest_scalars)}

_COUNTERS = ", ".join(f"('{m}', {f'{chr(39)}{k}{chr(39)}' if k else 'NULL'}, {i})" for i, (m, k) in enumerate(metrics.COUNTERS))
_BOUNDS = ", ".join(f"('{b}', {b!r}::DOUBLE)" for b in telemetry.BUCKETS)
_NAME = "CASE WHEN client % 7 = 6 THEN NULL WHEN client % 3 = 0 THEN 'app-' WHEN client % 3 = 1 THEN 'pg-' ELSE 'cache-' END || CAST(client % 4 AS VARCHAR)"
M = f"""{REQ}, e AS (SELECT *, CAST((us // {STEP}000000 + 1) * {STEP} AS BIGINT) AS t, {_NAME} AS name FROM req), names(metric, key, i) AS (VALUES {_COUNTERS}), bounds(le, b) AS (VALUES {_BOUNDS}, ('+Inf', 'inf'::DOUBLE)),
added AS (
  SELECT metric, CASE key WHEN 'shard' THEN '{{"shard":"' || client % 3 || '"}}' WHEN 'step' THEN '{{"step":"' || ['credit', 'debit', 'refund'][id % 3 + 1] || '"}}' WHEN 'side' THEN '{{"side":"' || ['consumer', 'publisher'][id % 2 + 1] || '"}}'
    WHEN 'kind' THEN '{{"kind":"' || ['global', 'local'][id % 2 + 1] || '"}}' ELSE '{{}}' END AS series, t, count(*) AS c FROM e JOIN names ON e.k % {len(metrics.COUNTERS)} = i GROUP BY 1, 2, 3
  UNION ALL SELECT unnest(['container_cpu_usage_seconds_total', 'container_network_receive_bytes_total', 'container_network_transmit_bytes_total']), '{{"name":"' || name || '"}}', t, unnest([sum(k), sum(k) * 10, sum(k) * 100]) FROM e WHERE name IS NOT NULL GROUP BY name, t
  UNION ALL SELECT '{metrics.REQUEST_BUCKETS}', '{{"method":"' || method || '","path":"' || path || '","le":"' || le || '"}}', t, count(*) FILTER (WHERE duration_s <= b) FROM e, bounds GROUP BY method, path, le, t),
span AS (SELECT metric, series, min(t) AS lo, max(t) AS hi FROM added GROUP BY 1, 2), grid AS (SELECT metric, series, unnest(generate_series(lo, hi, {STEP})) AS t FROM span),
counters AS (SELECT metric, series, t, CAST(sum(coalesce(c, 0)) OVER (PARTITION BY metric, series, (t - 1) // {LIFE} ORDER BY t) AS DOUBLE) AS value FROM grid LEFT JOIN added USING (metric, series, t)),
parts AS (SELECT '{{"shard":"' || client % 3 || '","instance":"' || client % 2 || '"}}' AS series, t, CAST(max(k) < 97 AS DOUBLE) AS up, CAST(max(k % 3) AS DOUBLE) AS state, CAST(sum(k) AS DOUBLE) AS pending, CAST(count(*) AS DOUBLE) AS flight,
  CAST(min(k) < 2 AS DOUBLE) AS mode, avg(k) AS size FROM e GROUP BY 1, 2),
gauges AS (SELECT unnest(['up', 'circuit_breaker_state', 'transactions_intake_pending', 'backpressure_in_flight', 'degradation_mode', 'transactions_batch_size']) AS metric, series, t, unnest([up, state, pending, flight, mode, size]) AS value FROM parts
  UNION ALL SELECT '{metrics.MEMORY}', '{{"name":"' || name || '"}}', t, CAST(max(k) * 1000 AS DOUBLE) FROM e WHERE name IS NOT NULL GROUP BY name, t),
every AS (SELECT * FROM counters UNION ALL SELECT * FROM gauges),
deltas AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0.0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS delta FROM counters WINDOW w AS (PARTITION BY metric, series ORDER BY t))"""
_R = lambda s: f"(SELECT metric, series, t, sum(delta) OVER (PARTITION BY metric, series ORDER BY t RANGE BETWEEN {s - 1} PRECEDING AND CURRENT ROW) / {s} AS rate FROM deltas)"
_J = lambda key: f"json_extract_string(series, '$.{key}')" if key else "''"
_RATE_SQL = lambda panel, metric, key, factor=1, where="true": f"SELECT '{panel}' AS panel, {_J(key)} AS label, t, round(sum(rate) * {factor}, 9) AS value FROM r WHERE metric = '{metric}' AND {where} GROUP BY 2, 3"
_SUM = lambda metric: f"(SELECT t, sum(value) AS v FROM every WHERE metric = '{metric}' GROUP BY 1)"
_SUMR = lambda metric: f"(SELECT t, sum(rate) AS v FROM r WHERE metric = '{metric}' GROUP BY 1)"
_QUANTILE = lambda panel, q, route, by: f"""SELECT '{panel}' AS panel, {route} AS label, t, round(CASE WHEN isinf(b) THEN lo ELSE coalesce(CASE WHEN n <> bef THEN lo + (b - lo) * ((total * {q} - bef) / (n - bef)) END, b) END, 9) AS value FROM (
  SELECT *, min(CASE WHEN total > 0 AND n >= total * {q} THEN b END) OVER (PARTITION BY {by} t) AS hit FROM (
    SELECT *, lag(b, 1, 0.0) OVER w AS lo, coalesce(lag(n) OVER w, 0) AS bef, max(n) OVER (PARTITION BY {by} t) AS total FROM (SELECT {by} t, b, sum(rate) AS n FROM h GROUP BY {by} t, b) WINDOW w AS (PARTITION BY {by} t ORDER BY b)))
  WHERE b = hit"""  # noqa: E731
_NOHIT = lambda panel, route, by: f"SELECT '{panel}', {route}, t, NULL FROM h GROUP BY {by} t HAVING max(rate) = 0"


def _alert_sql(name: str, values: str, hold: int) -> str:
    return f"""SELECT '{name}' AS alert, label, min(t) AS since, max(t) AS until, min(t) + {hold} AS firing_from FROM (SELECT label, t, b, sum(CASE WHEN b <> pb THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY t) AS i
  FROM (SELECT label, t, b, lag(b, 1, false) OVER (PARTITION BY label ORDER BY t) AS pb FROM ({values}))) WHERE b GROUP BY label, i HAVING max(t) - min(t) >= {hold}"""


_HOWS = {"sum": "sum(value)", "max": "max(value)", "avg": "avg(value)", "count": "CAST(count(*) AS DOUBLE)"}
_RW = f"WITH {M}, r AS {_R(WINDOW)}"
_CPU = metrics.CONTAINER_COUNTERS[0]

SQL = {
    "metric_samples": f"WITH {M} SELECT metric, series, count(*) AS n, round(max(value), 6) AS most, round(arg_max(value, t), 6) AS \"last\" FROM every GROUP BY 1, 2",
    "panel_rates": f"{_RW} " + " UNION ALL ".join(_RATE_SQL(p, m, k) for p, (m, k) in RATES.items()),
    "panel_totals": f"WITH {M} " + " UNION ALL ".join(f"SELECT '{p}' AS panel, '' AS label, t, round(v, 9) AS value FROM {_SUM(m)}" for p, m in TOTALS.items())
    + f" UNION ALL SELECT 'replays', '', t, round(a.v + b.v, 9) FROM {_SUM('idempotency_hits_total')} a JOIN {_SUM('idempotency_redis_replay_total')} b USING (t)",
    "panel_gauges": f"WITH {M} " + " UNION ALL ".join(f"SELECT '{p}' AS panel, {_J(k)} AS label, t, round({_HOWS[h]}, 9) AS value FROM every WHERE metric = '{m}' AND {w} GROUP BY 2, 3" for p, (m, h, k, w) in GAUGES.items())
    + f""" UNION ALL SELECT 'pending', '', t, round(sum(v), 9) FROM (SELECT {_J("shard")} AS s, t, max(value) AS v FROM every WHERE metric = 'transactions_intake_pending' GROUP BY 1, 2) GROUP BY t
UNION ALL SELECT 'memory_databases', {_J("name")}, t, round(value, 9) FROM every WHERE metric = '{metrics.MEMORY}' AND {_J("name")} LIKE 'pg-%'""",
    "panel_containers": f"""{_RW} {_RATE_SQL("cpu_app", _CPU, "name", 100, _J("name") + " LIKE 'app-%'")} UNION ALL {_RATE_SQL("cpu_total", _CPU, None, 100)} UNION ALL {_RATE_SQL("received_total", metrics.CONTAINER_COUNTERS[1], None)}
UNION ALL {_RATE_SQL("sent_total", metrics.CONTAINER_COUNTERS[2], None)}
UNION ALL SELECT 'cpu_top', label, t, value FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY value DESC, label) AS x FROM ({_RATE_SQL("x", _CPU, "name", 100)})) WHERE x <= 5
UNION ALL SELECT 'memory_top', label, t, value FROM (SELECT {_J("name")} AS label, t, round(value, 9) AS value, row_number() OVER (PARTITION BY t ORDER BY value DESC, {_J("name")}) AS x FROM every WHERE metric = '{metrics.MEMORY}') WHERE x <= 5""",
    "request_rates": f"""{_RW}, c2 AS (SELECT method, path, status, t, count(*) AS c FROM e GROUP BY 1, 2, 3, 4), s2 AS (SELECT method, path, status, min(t) AS lo, max(t) AS hi FROM c2 GROUP BY 1, 2, 3), g2 AS (SELECT method, path, status, unnest(generate_series(lo, hi, {STEP})) AS t FROM s2),
v2 AS (SELECT method, path, status, t, CAST(sum(coalesce(c, 0)) OVER (PARTITION BY method, path, status, (t - 1) // {LIFE} ORDER BY t) AS DOUBLE) AS value FROM g2 LEFT JOIN c2 USING (method, path, status, t)),
d2 AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0.0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS delta FROM v2 WINDOW w AS (PARTITION BY method, path, status ORDER BY t)),
q AS (SELECT method, path, status, t, sum(delta) OVER (PARTITION BY method, path, status ORDER BY t RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) / {WINDOW} AS rate FROM d2),
w AS (SELECT t, sum(rate) AS total, coalesce(sum(rate) FILTER (WHERE status = '200'), 0) AS ok, coalesce(sum(rate) FILTER (WHERE status = '202'), 0) AS accepted, coalesce(sum(rate) FILTER (WHERE status LIKE '4__'), 0) AS e4, coalesce(sum(rate) FILTER (WHERE status LIKE '5__'), 0) AS e5 FROM q GROUP BY 1)
SELECT unnest(['total', 'ok', 'accepted', 'e4', 'e5', 'e5_percent', 'e4_percent']) AS panel, '' AS label, t, round(unnest([total, ok, accepted, e4, e5, e5 / greatest(total, 0.001) * 100, e4 / greatest(total, 0.001) * 100]), 9) AS value FROM w
UNION ALL SELECT 'by_path', method || ' ' || path, t, round(sum(rate), 9) FROM q GROUP BY 2, 3
UNION ALL SELECT 'limited_percent', '', t, round(a.v / greatest(total, 0.001) * 100, 9) FROM {_SUMR("rate_limited_total")} a JOIN w USING (t)
UNION ALL SELECT 'hit_ratio', '', t, round(CASE WHEN a.v + b.v <> 0 THEN a.v / (a.v + b.v) END, 9) FROM {_SUMR("cache_hits_total")} a JOIN {_SUMR("cache_misses_total")} b USING (t)""",
    "rate_quantiles": f"""{_RW}, h AS (SELECT {_J("method")} AS method, {_J("path")} AS path, CASE WHEN {_J("le")} = '+Inf' THEN 'inf'::DOUBLE ELSE CAST({_J("le")} AS DOUBLE) END AS b, t, round(rate * {WINDOW}) AS rate FROM r WHERE metric = '{metrics.REQUEST_BUCKETS}') """
    + " UNION ALL ".join(x for q in (0.5, 0.9, 0.95, 0.99) for x in (_QUANTILE(f"p{q * 100:g}", q, "''", ""), _NOHIT(f"p{q * 100:g}", "''", "")))
    + " UNION ALL " + _QUANTILE("p90_by_path", 0.9, "method || ' ' || path", "method, path,") + " UNION ALL " + _NOHIT("p90_by_path", "method || ' ' || path", "method, path,"),
    "rule_alerts": f"WITH {M} " + " UNION ALL ".join(
        _alert_sql(n, f"SELECT {_J(k)} AS label, t, sum(rate) > {over} AS b FROM {_R(s)} WHERE metric = '{m}' AND {f'{_J(k)} = {chr(39)}{only}{chr(39)}' if only else 'true'} GROUP BY 1, 2", hold) for n, (m, k, s, over, hold, only) in ALERTS.items())
    + " UNION ALL " + _alert_sql("degradation", "SELECT '' AS label, t, max(value) > 0 AS b FROM every WHERE metric = 'degradation_mode' GROUP BY 1, 2", 1200),
    "latest_scalars": f"WITH {M}, c AS {_SUM('transactions_created_total')} SELECT 'created' AS name, arg_max(v, t) AS value FROM c UNION ALL SELECT 'missing', NULL UNION ALL SELECT 'missing_or_zero', 0.0",
}
