"""Queries over recorded requests: time series, objectives, streams and diagnostics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talea.operators import diagnostics, running, streams, telemetry
from talea.sources.events import activity, requests
from talea.sources.tables import table

STEP, LIFE = 600, 86_400
LABELS = ["path", "status"]
#: The end of the recorded month, in microseconds.
END_US = 1_706_659_200_000_000


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.scraped(requests(spark, d), LABELS, "us", STEP, LIFE)


def http_rate(spark: SparkSession, d: str) -> DataFrame:
    """Requests per second over 30 minutes, by path."""
    r = telemetry.rate(_samples(spark, d), LABELS, 1800)
    return r.groupBy("path", "t").agg(F.sum("rate").alias("rate")).select("path", "t", F.round("rate", 9).alias("rate"))


def http_rate_extrapolated(spark: SparkSession, d: str) -> DataFrame:
    """The rate of each series carried on to the range's ends."""
    r = telemetry.extrapolated_rate(_samples(spark, d), LABELS, 3600)
    return r.select(*LABELS, "t", F.round("rate", 9).alias("rate"))


def increase_total(spark: SparkSession, d: str) -> DataFrame:
    """The increase of each series over the month, restarts allowed for, and its last value."""
    s = telemetry.increases(_samples(spark, d), LABELS)
    return s.groupBy(*LABELS).agg(F.sum("delta").alias("increase"), F.max_by("value", "t").alias("last"))


def error_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Shares of failed, refused and limited requests by hour, 0 where there were none."""
    r = requests(spark, d).withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    count = lambda p: F.count_if(telemetry.matching("status", p))
    c = r.groupBy("hour").agg(F.count("*").alias("n"), count("5..").alias("e5"), count("4..").alias("e4"), count("429").alias("limited"))
    return c.select("hour", "n", *[(100 * F.col(x) / F.greatest("n", F.lit(1))).alias(x) for x in ("e5", "e4", "limited")])


def path_matchers(spark: SparkSession, d: str) -> DataFrame:
    """Requests by method and path, without two paths, which must match as a whole."""
    r = requests(spark, d).where(~telemetry.matching("path", "/click|/sign") & telemetry.matching("status", "2..|429"))
    return r.groupBy("method", "path").agg(F.count("*").alias("n"))


def recorded(spark: SparkSession, d: str, least: float = 1.0) -> DataFrame:
    """The recorded series: requests and errors per second, availability and the share within the objective."""
    return telemetry.sli(requests(spark, d), "us", "status", "duration_s", STEP, 3600, least)


def burn_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Spans in which the error budget burns, with the least rate that the panels use: the recorded events stay below one a second."""
    return telemetry.burn_alerts(recorded(spark, d, 0.001), 6 * 3600, 24 * 3600, 1200, 3600, 1800)


def error_budget(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the month's error budget, in percent."""
    c = requests(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("status").startswith("5")).alias("e"))
    return c.select("n", "e", (100 * (1 - (F.col("e") / F.greatest("n", F.lit(1))) / telemetry.BUDGET)).alias("left"))


def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, 90th and 99th percentile of the latency by path, from the buckets."""
    b = telemetry.bucketed(requests(spark, d), ["path"], "duration_s")
    out = None
    for q in (0.5, 0.9, 0.99):
        part = telemetry.histogram_quantile(b, ["path"], q).select("path", F.lit(q).alias("q"), F.round("quantile", 9).alias("quantile"))
        out = part if out is None else out.unionByName(part)
    return out


def latency_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = telemetry.bucketed(requests(spark, d), ["path"], "duration_s")
    return b.select("path", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")).alias("le"), "n")


def topk_series(spark: SparkSession, d: str) -> DataFrame:
    """The two busiest series at each scrape of the last day."""
    s = telemetry.rate(_samples(spark, d), LABELS, 3600).where(F.col("t") > END_US // 1_000_000 - 86_400)
    return telemetry.top_series(s.withColumn("rate", F.round("rate", 9)), 2, "rate", LABELS)


def topk_series_all(spark: SparkSession, d: str) -> DataFrame:
    """The two busiest series at every scrape; ``topk_series`` has those of the last day."""
    s = telemetry.rate(_samples(spark, d), LABELS, 3600)
    return telemetry.top_series(s.withColumn("rate", F.round("rate", 9)), 2, "rate", LABELS)


def rolling_buffer(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the last 30 latencies of each path, for its last 100 requests."""
    r = requests(spark, d).select("path", "us", "id", (F.col("duration_s") * 10000).cast("bigint").alias("v"))
    return streams.last_means(r, "path", ["us", "id"], "v", 30, 100).select("path", "id", F.col("total").alias("last_30"))


def cache_hit_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Hits over hits and misses by hour; null where nothing was asked."""
    r = requests(spark, d).withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    hits, misses = F.count_if(F.expr("path = '/view'")), F.count_if(F.expr("path = '/click'"))
    return r.groupBy("hour").agg(hits.alias("hits"), misses.alias("misses")).withColumn("ratio", F.try_divide("hits", F.col("hits") + F.col("misses")))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    s = telemetry.summary(requests(spark, d).withColumn("ms", F.round(F.col("duration_s") * 1000, 3)), ["path"], "ms")
    return s.select("path", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most", "med", "p90", "p95", "p99", "p999")])


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The figures of all requests against limits."""
    r = requests(spark, d)
    failed = r.agg(F.avg(F.col("status").startswith("5").cast("int")).alias("failed"))
    # one row beside one row
    f = running.percentiles(r, [], "duration_s", {"p95": 0.95, "p99": 0.99}).crossJoin(F.broadcast(failed))
    return telemetry.verdicts(f, {"p95": 0.5, "p99": 1.5, "failed": 0.05}).withColumn("value", F.round("value", 9))


def burst_result(spark: SparkSession, d: str) -> DataFrame:
    """Of each client: good and failed calls, the slowest, and the span of time."""
    return requests(spark, d).groupBy("client").agg(F.count_if(F.expr("status < '400'")).alias("ok"), F.count_if(F.expr("status >= '400'")).alias("failed"), F.max("duration_s").alias("slowest"), (F.max("us") - F.min("us")).alias("span_us"))


def flush_batches(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches of each path's requests: of up to 20, or until 30 minutes pass without one."""
    b = streams.flush_batches(requests(spark, d), "path", "us", "id", 20, 1_800_000_000)
    return b.groupBy("path", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcome counters and the sizes of batches by path."""
    b = streams.flush_batches(requests(spark, d), "path", "us", "id", 20, 1_800_000_000)
    sizes = b.groupBy("path", "batch").agg(F.count("*").alias("n"), F.count_if(F.expr("status < '300'")).alias("acked"), F.count_if(F.expr("status = '429'")).alias("requeued"), F.count_if(F.expr("status = '503'")).alias("dlq"))
    return sizes.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("acked", "requeued", "dlq")], F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.99).alias("p99"))


def rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    """Requests refused by a limit of 3 an hour and client, anchored at a window's first request."""
    r = requests(spark, d).select("client", "us", "id")
    return streams.rate_limited(r, "client", "us", 0, 3).groupBy("client").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    """What a circuit breaker per client admits."""
    r = requests(spark, d).select("client", "us", "id", (F.col("status") == "503").alias("failed"))
    return streams.breaker_states(r, "client", "us", "failed", 2, 3_600_000_000, 2, 1, "id").groupBy("admitted", "state").agg(F.count("*").alias("n"))


def bounded_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose ``k`` is not among the last 20 distinct ones of their path."""
    r = requests(spark, d).select("path", "us", "id", "k")
    return streams.bounded_dedupe(r, "path", ["us", "id"], "k", 20).groupBy("path").agg(F.count_if("fresh").alias("fresh"), F.count("*").alias("n"))


def in_flight(spark: SparkSession, d: str) -> DataFrame:
    """The most requests at once, by path."""
    r = requests(spark, d).withColumn("end", F.col("us") + (F.col("duration_s") * 1_000_000_000).cast("bigint"))
    return streams.in_flight(r, "path", F.col("us"), F.col("end")).groupBy("path").agg(F.max("in_flight").alias("most"))


def load_shed(spark: SparkSession, d: str) -> DataFrame:
    """Requests that a limit of 2 at once refuses, by client."""
    r = requests(spark, d).select("client", "us", "id", (F.col("us") + (F.col("duration_s") * 1_000_000_000).cast("bigint")).alias("end"))
    return streams.shed(r, "client", "us", "end", 2, "id").groupBy("client").agg(F.count_if("let_in").alias("let_in"), F.count_if(~F.col("let_in")).alias("shed"))


def notifications_recent(spark: SparkSession, d: str) -> DataFrame:
    """The newest 50 notices of completed transactions."""
    from talea.plans.ledger import transactions

    tx = transactions(spark, d).where("status = 'completed'")
    body = F.to_json(F.struct("id", "from_account", "to_account", F.col("amount").cast("string").alias("amount"), "currency", "reference_id"))
    events = tx.select("id", F.lit("transactions.committed").alias("name"), F.col("created_at").alias("occurred_at"), body.alias("payload"))
    return streams.recent(streams.notifications(events), 50).select("id", "kind", "recipient", "summary")


def activity_states(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.states(activity(spark, d))


def query_mix(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.query_kinds(activity(spark, d))


def wait_line(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.wait_line(activity(spark, d))


def wait_histogram(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.top_waits(activity(spark, d))


def longest_queries(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.longest_queries(activity(spark, d), END_US)


def blocking_chain(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.blocking(activity(spark, d))


def degraded(spark: SparkSession, d: str) -> DataFrame:
    """What a read-only mode would refuse, by path."""
    return requests(spark, d).groupBy("path").agg(F.count_if(~F.col("method").isin("GET", "HEAD", "OPTIONS")).alias("refused"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    http_rate, http_rate_extrapolated, increase_total, error_ratio, path_matchers, recorded, burn_alerts, error_budget, latency_quantiles, latency_buckets, topk_series, topk_series_all,
    rolling_buffer, cache_hit_ratio, latency_summary, thresholds, burst_result, flush_batches, batch_outcomes, rate_limiter, breaker_states, bounded_dedupe, in_flight, load_shed,
    notifications_recent, activity_states, query_mix, wait_line, wait_histogram, longest_queries, blocking_chain, degraded,
)}

REQ = """req AS (SELECT event_id AS id, epoch_us(ts) AS us, user_id AS client, CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS path,
  CASE WHEN event_type = 'error' THEN '503' WHEN event_type = 'purchase' THEN '202' WHEN event_type = 'signup' AND value > 50 THEN '429' ELSE '200' END AS status,
  value / 100 AS duration_s, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
SAMPLES = f"""{REQ}, counts AS (SELECT path, status, CAST((us // {STEP}000000 + 1) * {STEP} AS BIGINT) AS t, count(*) AS c FROM req GROUP BY 1, 2, 3),
span AS (SELECT path, status, min(t) AS a, max(t) AS b FROM counts GROUP BY 1, 2), grid AS (SELECT path, status, unnest(generate_series(a, b, {STEP})) AS t FROM span),
samples AS (SELECT path, status, t, CAST(sum(coalesce(c, 0)) OVER (PARTITION BY path, status, (t - 1) // {LIFE} ORDER BY t) AS DOUBLE) AS value FROM grid LEFT JOIN counts USING (path, status, t)),
deltas AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0.0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS delta
  FROM samples WINDOW w AS (PARTITION BY path, status ORDER BY t))"""
_RATE = lambda s: f"rates AS (SELECT path, status, t, sum(delta) OVER (PARTITION BY path, status ORDER BY t RANGE BETWEEN {s - 1} PRECEDING AND CURRENT ROW) / {s} AS rate FROM deltas)"
SLI = lambda least: f"""{REQ}, c AS (SELECT CAST((us // {STEP}000000 + 1) * {STEP} AS BIGINT) AS t, count(*) AS r, count(*) FILTER (WHERE status LIKE '5__') AS e, count(*) FILTER (WHERE duration_s <= 0.5) AS u FROM req GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(t) FROM c), (SELECT max(t) FROM c), {STEP})) AS t),
s AS (SELECT t, sum(coalesce(r, 0)) OVER w AS r, sum(coalesce(e, 0)) OVER w AS e, sum(coalesce(u, 0)) OVER w AS u FROM spine LEFT JOIN c USING (t) WINDOW w AS (ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)),
sli AS (SELECT t, CAST(r AS DOUBLE) / 3600 AS requests, CAST(e AS DOUBLE) / 3600 AS errors, 1 - (CAST(e AS DOUBLE) / 3600) / greatest(CAST(r AS DOUBLE) / 3600, {least}) AS availability,
  (CAST(u AS DOUBLE) / 3600) / greatest(CAST(r AS DOUBLE) / 3600, {least}) AS under_slo FROM s)"""  # noqa: E731
_HELD = lambda name, hold: f"""SELECT '{name}' AS alert, min(t) AS since, max(t) AS until, min(t) + {hold} AS firing_from FROM (SELECT t, b, sum(CASE WHEN b <> pb THEN 1 ELSE 0 END) OVER (ORDER BY t) AS i
  FROM (SELECT t, coalesce({name}, false) AS b, lag(coalesce({name}, false), 1, false) OVER (ORDER BY t) AS pb FROM br)) WHERE b GROUP BY i HAVING max(t) - min(t) >= {hold}"""  # noqa: E731
_BOUNDS = ", ".join(repr(b) for b in telemetry.BUCKETS)
HIST = f"""{REQ}, bounds AS (SELECT unnest([{_BOUNDS}, 'inf'::DOUBLE]) AS le), paths AS (SELECT DISTINCT path FROM req),
buckets AS (SELECT p.path, b.le, (SELECT count(*) FROM req r WHERE r.path = p.path AND r.duration_s <= b.le) AS n FROM paths p, bounds b)"""
BATCHES = f"""{REQ}, g AS (SELECT *, coalesce(CASE WHEN us - lag(us) OVER (PARTITION BY path ORDER BY us, id) >= 1800000000 THEN 1 ELSE 0 END, 0) AS gap FROM req),
isle AS (SELECT *, sum(gap) OVER (PARTITION BY path ORDER BY us, id) AS i FROM g), b AS (SELECT *, (row_number() OVER (PARTITION BY path, i ORDER BY us, id) - 1) // 20 AS x FROM isle),
batches AS (SELECT *, dense_rank() OVER (PARTITION BY path ORDER BY i, x) AS batch FROM b)"""
ACT = f"""{REQ}, act AS (SELECT id AS pid, CASE WHEN k % 11 = 0 THEN 'walsender' ELSE 'client backend' END AS backend_type,
  CASE WHEN k % 4 = 0 THEN 'idle' WHEN k % 4 = 1 THEN 'idle in transaction' ELSE 'active' END AS state, CASE WHEN k % 5 = 0 THEN 'Lock' WHEN k % 5 = 1 THEN 'IO' WHEN k % 5 = 2 THEN 'LWLock' END AS wait_event_type,
  CASE WHEN k % 10 = 0 THEN 'transactionid' WHEN k % 5 = 0 THEN 'tuple' WHEN k % 5 = 1 THEN 'DataFileRead' WHEN k % 5 = 2 THEN 'BufferMapping' END AS wait_event,
  CASE path WHEN '/view' THEN 'SELECT id,' || chr(10) || '  status FROM transactions WHERE reference_id = $1' WHEN '/click' THEN 'select balance FROM users WHERE account_number = $1'
    WHEN '/purchase' THEN 'SELECT * FROM transactions  WHERE created_at < $1 ORDER BY created_at DESC' ELSE 'UPDATE cross_shard_outbox SET attempts = attempts + 1' END AS query,
  us AS query_start, CASE WHEN k % 5 = 0 THEN [id - 1, id - 2] END AS blocked_by FROM req)"""
_FLAT = lambda c, n: f"left(regexp_replace({c}, '\\s+', ' ', 'g'), {n})"
_ACTIVE = "backend_type = 'client backend' AND state = 'active'"

SQL = {
    "http_rate": f"WITH {SAMPLES}, {_RATE(1800)} SELECT path, t, round(sum(rate), 9) AS rate FROM rates GROUP BY 1, 2",
    "http_rate_extrapolated": f"""WITH {SAMPLES}, x AS (SELECT path, status, t, first_value(t) OVER w AS a, count(*) OVER w AS n, sum(delta) OVER w - first_value(delta) OVER w AS rise, first_value(value) OVER w AS v
  FROM deltas WINDOW w AS (PARTITION BY path, status ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, CAST(t - a AS DOUBLE) AS span, CAST(a - (t - 3600) AS DOUBLE) AS start FROM x WHERE n > 1),
z AS (SELECT *, least(CASE WHEN start >= span / (n - 1) * 1.1 THEN span / (n - 1) / 2 ELSE start END, CASE WHEN rise > 0 THEN span * v / rise END) AS ext FROM y)
SELECT path, status, t, round(rise * ((span + ext) / span) / 3600, 9) AS rate FROM z UNION ALL SELECT path, status, t, NULL FROM x WHERE n <= 1""",
    "increase_total": f"WITH {SAMPLES} SELECT path, status, sum(delta) AS increase, arg_max(value, t) AS last FROM deltas GROUP BY 1, 2",
    "error_ratio": f"""WITH {REQ} SELECT us // 3600000000 AS hour, count(*) AS n, 100 * CAST(count(*) FILTER (WHERE status LIKE '5__') AS DOUBLE) / count(*) AS e5,
  100 * CAST(count(*) FILTER (WHERE status LIKE '4__') AS DOUBLE) / count(*) AS e4, 100 * CAST(count(*) FILTER (WHERE status = '429') AS DOUBLE) / count(*) AS limited FROM req GROUP BY 1""",
    "path_matchers": f"WITH {REQ} SELECT method, path, count(*) AS n FROM req WHERE NOT regexp_full_match(path, '/click|/sign') AND regexp_full_match(status, '2..|429') GROUP BY 1, 2",
    "recorded": f"WITH {SLI(1.0)} SELECT * FROM sli",
    "burn_alerts": f"""WITH {SLI(0.001)}, w AS (SELECT *, avg(availability) OVER (ORDER BY t RANGE BETWEEN {6 * 3600 - 1} PRECEDING AND CURRENT ROW) AS a1, avg(availability) OVER (ORDER BY t RANGE BETWEEN {24 * 3600 - 1} PRECEDING AND CURRENT ROW) AS a6 FROM sli),
br AS (SELECT t, 1 - availability > 0.0144 AND 1 - a1 > 0.0144 AS fast_burn, 1 - a6 > 0.006 AS slow_burn, under_slo < 0.95 AS latency FROM w)
{_HELD("fast_burn", 1200)} UNION ALL {_HELD("slow_burn", 3600)} UNION ALL {_HELD("latency", 1800)}""",
    "error_budget": f"""WITH {REQ}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE status LIKE '5%') AS e FROM req)
SELECT n, e, 100 * (1 - (CAST(e AS DOUBLE) / greatest(n, 1)) / CAST(0.001 AS DOUBLE)) AS "left" FROM c""",
    "latency_quantiles": f"""WITH {HIST}, o AS (SELECT *, lag(le, 1, 0.0) OVER w AS lo, coalesce(lag(n) OVER w, 0) AS bef, max(n) OVER (PARTITION BY path) AS total FROM buckets WINDOW w AS (PARTITION BY path ORDER BY le)),
qs AS (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS q),
h AS (SELECT *, row_number() OVER (PARTITION BY path, q ORDER BY le) AS k FROM o, qs WHERE total > 0 AND n >= total * q)
SELECT path, q, round(CASE WHEN isinf(le) THEN lo ELSE coalesce(CASE WHEN n <> bef THEN lo + (le - lo) * ((total * q - bef) / (n - bef)) END, le) END, 9) AS quantile FROM h WHERE k = 1""",
    "latency_buckets": f"WITH {HIST} SELECT path, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, n FROM buckets",
    "topk_series": f"""WITH {SAMPLES}, {_RATE(3600)}, r AS (SELECT path, status, t, round(rate, 9) AS rate FROM rates WHERE t > {END_US // 1_000_000 - 86_400})
SELECT path, status, t, rate, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rate DESC, path, status) AS place FROM r) WHERE place <= 2""",
    "topk_series_all": f"""WITH {SAMPLES}, {_RATE(3600)}, r AS (SELECT path, status, t, round(rate, 9) AS rate FROM rates)
SELECT path, status, t, rate, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rate DESC, path, status) AS place FROM r) WHERE place <= 2""",
    "rolling_buffer": f"""WITH {REQ}, r AS (SELECT path, id, sum(CAST(trunc(duration_s * 10000) AS BIGINT)) OVER (PARTITION BY path ORDER BY us, id ROWS 29 PRECEDING) AS last_30, row_number() OVER (PARTITION BY path ORDER BY us DESC, id DESC) AS k FROM req)
SELECT path, id, CAST(last_30 AS BIGINT) AS last_30 FROM r WHERE k <= 100""",
    "cache_hit_ratio": f"""WITH {REQ}, h AS (SELECT us // 3600000000 AS hour, count(*) FILTER (WHERE path = '/view') AS hits, count(*) FILTER (WHERE path = '/click') AS misses FROM req GROUP BY 1)
SELECT hour, hits, misses, CASE WHEN hits + misses > 0 THEN CAST(hits AS DOUBLE) / (hits + misses) END AS ratio FROM h""",
    "latency_summary": f"""WITH {REQ}, m AS (SELECT path, round(duration_s * 1000, 3) AS ms FROM req)
SELECT path, count(ms) AS n, round(avg(ms), 6) AS mean, round(min(ms), 6) AS least, round(max(ms), 6) AS most, round(quantile_cont(ms, 0.5), 6) AS med, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.95), 6) AS p95,
  round(quantile_cont(ms, 0.99), 6) AS p99, round(quantile_cont(ms, 0.999), 6) AS p999 FROM m GROUP BY 1""",
    "thresholds": f"""WITH {REQ}, f AS (SELECT quantile_cont(duration_s, 0.95) AS p95, quantile_cont(duration_s, 0.99) AS p99, CAST(count(*) FILTER (WHERE status LIKE '5%') AS DOUBLE) / count(*) AS failed FROM req)
SELECT 'p95<0.5' AS rule, round(p95, 9) AS value, p95 < 0.5 AS passed FROM f UNION ALL SELECT 'p99<1.5', round(p99, 9), p99 < 1.5 FROM f UNION ALL SELECT 'failed<0.05', round(failed, 9), failed < 0.05 FROM f""",
    "burst_result": f"WITH {REQ} SELECT client, count(*) FILTER (WHERE status < '400') AS ok, count(*) FILTER (WHERE status >= '400') AS failed, max(duration_s) AS slowest, max(us) - min(us) AS span_us FROM req GROUP BY 1",
    "flush_batches": f"WITH {BATCHES} SELECT path, batch, count(*) AS n, min(id) AS \"first\", max(id) AS \"last\" FROM batches GROUP BY 1, 2",
    "batch_outcomes": f"""WITH {BATCHES}, z AS (SELECT path, batch, count(*) AS n, count(*) FILTER (WHERE status < '300') AS acked, count(*) FILTER (WHERE status = '429') AS requeued, count(*) FILTER (WHERE status = '503') AS dlq FROM batches GROUP BY 1, 2)
SELECT path, CAST(sum(acked) AS BIGINT) AS acked, CAST(sum(requeued) AS BIGINT) AS requeued, CAST(sum(dlq) AS BIGINT) AS dlq, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(n, 0.99) AS DOUBLE) AS p99 FROM z GROUP BY 1""",
    # state machines as recursions: each step takes the next row of every key
    "rate_limiter": f"""WITH RECURSIVE {REQ}, o AS (SELECT client, us, row_number() OVER (PARTITION BY client ORDER BY us, id) AS i FROM req),
s(client, i, start, n) AS (SELECT client, i, us, 1 FROM o WHERE i = 1 UNION ALL SELECT o.client, o.i, CASE WHEN o.us - s.start >= 3600000000 THEN o.us ELSE s.start END, CASE WHEN o.us - s.start >= 3600000000 THEN 1 ELSE s.n + 1 END
  FROM s JOIN o ON o.client = s.client AND o.i = s.i + 1)
SELECT client, count(*) FILTER (WHERE n <= 3) AS allowed, count(*) FILTER (WHERE n > 3) AS refused FROM s GROUP BY 1""",
    "breaker_states": f"""WITH RECURSIVE {REQ}, o AS (SELECT client, us, status = '503' AS bad, row_number() OVER (PARTITION BY client ORDER BY us, id) AS i FROM req),
s(client, i, state, fails, last, tried, good, admitted) AS (SELECT client, 0::BIGINT, 'closed', 0, NULL::BIGINT, 0, 0, NULL::BOOLEAN FROM (SELECT DISTINCT client FROM o) UNION ALL
  SELECT client, i, CASE WHEN NOT adm THEN st WHEN bad THEN CASE WHEN st = 'half_open' OR fails + 1 >= 2 THEN 'open' ELSE st END WHEN st = 'half_open' AND gd + 1 >= 1 THEN 'closed' ELSE st END,
    CASE WHEN NOT adm THEN fails WHEN bad THEN fails + 1 WHEN st = 'closed' OR gd + 1 >= 1 THEN 0 ELSE fails END, CASE WHEN adm AND bad THEN us ELSE last END, tr, CASE WHEN adm AND NOT bad AND st = 'half_open' THEN gd + 1 ELSE gd END, adm
  FROM (SELECT *, st <> 'open' AND NOT (st = 'half_open' AND tr > 2) AS adm FROM (SELECT *, CASE WHEN st = 'half_open' THEN CASE WHEN fresh THEN 1 ELSE tried + 1 END ELSE tried END AS tr, CASE WHEN fresh THEN 0 ELSE good END AS gd
    FROM (SELECT *, CASE WHEN fresh THEN 'half_open' ELSE state END AS st FROM (SELECT o.*, s.state, s.fails, s.last, s.tried, s.good, coalesce(s.state = 'open' AND o.us - s.last >= 3600000000, false) AS fresh
      FROM s JOIN o ON o.client = s.client AND o.i = s.i + 1)))))
SELECT admitted, state, count(*) AS n FROM s WHERE i > 0 GROUP BY 1, 2""",
    "bounded_dedupe": f"""WITH RECURSIVE {REQ}, o AS (SELECT path, k, row_number() OVER (PARTITION BY path ORDER BY us, id) AS i FROM req),
s(path, i, known, fresh) AS (SELECT path, 0::BIGINT, []::INTEGER[], NULL::BOOLEAN FROM (SELECT DISTINCT path FROM o) UNION ALL
  SELECT o.path, o.i, CASE WHEN list_contains(s.known, o.k) THEN s.known ELSE list_append(CASE WHEN len(s.known) >= 20 THEN s.known[2:] ELSE s.known END, o.k) END, NOT list_contains(s.known, o.k) FROM s JOIN o ON o.path = s.path AND o.i = s.i + 1)
SELECT path, count(*) FILTER (WHERE fresh) AS fresh, count(*) AS n FROM s WHERE i > 0 GROUP BY 1""",
    "load_shed": f"""WITH RECURSIVE {REQ}, o AS (SELECT client, us, us + CAST(trunc(duration_s * 1000000000) AS BIGINT) AS till, row_number() OVER (PARTITION BY client ORDER BY us, id) AS i FROM req),
s(client, i, held, let_in) AS (SELECT client, 0::BIGINT, []::BIGINT[], NULL::BOOLEAN FROM (SELECT DISTINCT client FROM o) UNION ALL
  SELECT client, i, CASE WHEN len(h) < 2 THEN list_append(h, till) ELSE h END, len(h) < 2 FROM (SELECT o.*, list_filter(s.held, lambda x: x > o.us) AS h FROM s JOIN o ON o.client = s.client AND o.i = s.i + 1))
SELECT client, count(*) FILTER (WHERE let_in) AS let_in, count(*) FILTER (WHERE NOT let_in) AS shed FROM s WHERE i > 0 GROUP BY 1""",
    "in_flight": f"""WITH {REQ}, m AS (SELECT path, us, 1 AS d FROM req UNION ALL SELECT path, us + CAST(trunc(duration_s * 1000000000) AS BIGINT), -1 FROM req), s AS (SELECT path, us, sum(d) AS d FROM m GROUP BY 1, 2)
SELECT path, CAST(max(f) AS BIGINT) AS most FROM (SELECT path, sum(d) OVER (PARTITION BY path ORDER BY us) AS f FROM s) GROUP BY 1""",
    "notifications_recent": """WITH tx AS (SELECT *, upper(trim(from_account, ' ' || chr(9))) AS f, nullif(upper(trim(to_account, ' ' || chr(9))), '') AS o FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM transactions WHERE id IS NOT NULL) WHERE rn = 1)
SELECT id, 'transaction_committed' AS kind, o AS recipient, 'Received ' || CAST(amount AS VARCHAR) || ' ' || currency || ' from ' || f || CASE WHEN reference_id IS NOT NULL THEN ' (ref ' || reference_id || ')' ELSE '' END AS summary
FROM tx WHERE status = 'completed' AND o IS NOT NULL AND f <> '' AND currency IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 50""",
    "activity_states": f"""WITH {ACT} SELECT count(*) AS total, count(*) FILTER (WHERE state = 'active') AS active, count(*) FILTER (WHERE state = 'idle') AS idle,
  count(*) FILTER (WHERE state = 'idle in transaction') AS idle_tx, count(*) FILTER (WHERE backend_type = 'client backend') AS clients FROM act""",
    "query_mix": f"""WITH {ACT} SELECT count(*) FILTER (WHERE query ILIKE '%from transactions where reference_id%') AS by_reference, count(*) FILTER (WHERE query ILIKE '%from users where account_number%') AS balance,
  count(*) FILTER (WHERE query ILIKE '%from transactions%order by%') AS page, count(*) FILTER (WHERE query NOT ILIKE '%from transactions where reference_id%' AND query NOT ILIKE '%from users where account_number%'
  AND query NOT ILIKE '%from transactions%order by%') AS other FROM act WHERE {_ACTIVE}""",
    "wait_line": f"""WITH {ACT}, w AS (SELECT coalesce(wait_event_type, '(run)') || ':' || coalesce(wait_event, '-') AS we, count(*) AS c FROM act WHERE {_ACTIVE} GROUP BY 1)
SELECT string_agg(we || '=' || c, ' ' ORDER BY c DESC, we) AS line FROM w""",
    "wait_histogram": f"WITH {ACT} SELECT wait_event_type, wait_event, count(*) AS n FROM act WHERE state = 'active' AND wait_event IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5",
    "longest_queries": f"WITH {ACT} SELECT pid, CAST(({END_US} - query_start) // 1000000 AS BIGINT) AS seconds, {_FLAT('query', 120)} AS query FROM (SELECT * FROM act WHERE state = 'active' ORDER BY query_start, pid LIMIT 5)",
    "blocking_chain": f"""WITH {ACT}, w AS (SELECT pid, coalesce(wait_event, '?') AS wait_event, {_FLAT("query", 64)} AS query, unnest(blocked_by) AS blocker FROM act WHERE wait_event_type = 'Lock')
SELECT w.pid, w.wait_event, w.query, w.blocker, b.state AS blocker_state, {_FLAT("b.query", 64)} AS blocker_query FROM w JOIN act b ON b.pid = w.blocker""",
    "degraded": f"WITH {REQ} SELECT path, count(*) FILTER (WHERE method NOT IN ('GET', 'HEAD', 'OPTIONS')) AS refused, count(*) AS n FROM req GROUP BY 1",
}
