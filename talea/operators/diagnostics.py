"""Reports over the activity of a database: ``pid, backend_type, state, wait_event_type, wait_event, query, query_start, blocked_by``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = "backend_type = 'client backend' and state = 'active'"
# What the query kinds look like.
KINDS = (("by_reference", "%from transactions where reference_id%"), ("balance", "%from users where account_number%"), ("page", "%from transactions%order by%"))


def states(activity: DataFrame) -> DataFrame:
    """Totals by state, in one row."""
    count = lambda c: F.count_if(F.expr(c))
    return activity.agg(
        F.count("*").alias("total"), count("state = 'active'").alias("active"), count("state = 'idle'").alias("idle"),
        count("state = 'idle in transaction'").alias("idle_tx"), count("backend_type = 'client backend'").alias("clients"),
    )


def query_kinds(activity: DataFrame) -> DataFrame:
    """How many active queries are of each kind; a query may be of several."""
    q = F.col("query")
    kinds = [F.count_if(q.ilike(p)).alias(k) for k, p in KINDS]
    none = F.lit(True)
    for _, p in KINDS:
        none = none & ~q.ilike(p)
    return activity.where(ACTIVE).agg(*kinds, F.count_if(none).alias("other"))


def wait_line(activity: DataFrame) -> DataFrame:
    """``line``: the wait events of active clients with their numbers, the most frequent first."""
    event = F.concat(F.coalesce("wait_event_type", F.lit("(run)")), F.lit(":"), F.coalesce("wait_event", F.lit("-"))).alias("we")
    counts = activity.where(ACTIVE).groupBy(event).agg(F.count("*").alias("c"))
    # one row per kind of event, of which a database has a fixed number
    listed = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), "we", "c")))
    return counts.agg(F.concat_ws(" ", F.transform(listed, lambda x: F.concat(x["we"], F.lit("="), x["c"].cast("string")))).alias("line"))


def top_waits(activity: DataFrame, n: int = 5) -> DataFrame:
    found = activity.where("state = 'active' and wait_event is not null").groupBy("wait_event_type", "wait_event").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "wait_event_type", "wait_event").limit(n)


def flat(query: Column, n: int) -> Column:
    """The query on one line, cut to ``n`` characters."""
    return F.left(F.regexp_replace(query, r"\s+", " "), F.lit(n))


def longest_queries(activity: DataFrame, now_us: int, n: int = 5) -> DataFrame:
    """``pid, seconds, query`` of the active queries that run longest."""
    seconds = F.floor((now_us - F.col("query_start")) / 1_000_000).cast("bigint").alias("seconds")
    return activity.where("state = 'active' and query_start is not null").orderBy("query_start", "pid").limit(n).select("pid", seconds, flat(F.col("query"), 120).alias("query"))


def blocking(activity: DataFrame) -> DataFrame:
    """``pid, wait_event, query, blocker, blocker_state, blocker_query``: who waits for whose lock."""
    waits = activity.where("wait_event_type = 'Lock'").select("pid", F.coalesce("wait_event", F.lit("?")).alias("wait_event"), flat(F.col("query"), 64).alias("query"), F.explode("blocked_by").alias("blocker"))
    holders = activity.select(F.col("pid").alias("blocker"), F.col("state").alias("blocker_state"), flat(F.col("query"), 64).alias("blocker_query"))
    return waits.join(holders, "blocker").select("pid", "wait_event", "query", "blocker", "blocker_state", "blocker_query")


def lock_modes(locks: DataFrame) -> DataFrame:
    """``mode, granted, waiting, relations`` of ``mode, granted, relation``."""
    return locks.groupBy("mode").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("waiting"), F.count_distinct("relation").alias("relations"))


def replication_lag(sent: DataFrame) -> DataFrame:
    """``replica, state, lag_bytes, most_bytes, broken, last_us``: each replica's last report, its greatest lag, and reports in which it was not streaming."""
    lag = F.col("sent_lsn") - F.col("replay_lsn")
    last = F.max(F.struct("us", "id", "state", lag.alias("lag"))).alias("x")
    r = sent.groupBy("replica").agg(last, F.max(lag).alias("most_bytes"), F.count_if(F.col("state") != "streaming").alias("broken"))
    return r.select("replica", "x.state", F.col("x.lag").alias("lag_bytes"), "most_bytes", "broken", F.col("x.us").alias("last_us"))
