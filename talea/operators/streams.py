"""Operators over event streams, in the form they take on recorded events."""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talea.operators.ordered import Step, ordered_fold
from talea.operators.running import running
from talea.schema import COMMITTED

# Sizes of batches, of the window of known events and of the ring, and how many requests may be under way.
BATCH_ROWS, IDLE_US, KNOWN, RING, CAP = 200, 250_000, 4096, 512, 2000
#: The ranges of time into which a group's events are cut: an hour.
PART_US = 3_600_000_000


def flush_batches(events: DataFrame, group: str, us: str, id: str, rows: int = BATCH_ROWS, idle_us: int = IDLE_US, part_us: int = PART_US) -> DataFrame:
    """Events with ``batch``: a new one begins after a gap of at least ``idle_us`` or when ``rows`` are buffered.

    Each step is a running sum or maximum over ranges of ``part_us``, so that
    a group with most events is spread over its ranges of time.
    """
    order, columns = [us, id], events.columns
    e = events.withColumn("_part", F.floor(F.col(us) / part_us))
    # the event before: within a range the row before, else the last of the ranges before
    last = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = e.groupBy(group, "_part").agg(F.max(us).alias("_end")).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.max("_end").over(last).alias("_end"))
    joined = e.join(ends, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    before = F.coalesce(F.lag(us).over(Window.partitionBy(group, "_part").orderBy(*order)), F.col("_end"))
    gap = F.coalesce(F.col(us) - before >= idle_us, F.lit(True))
    numbered = running(joined.select(*columns, "_part", gap.alias("_gap"), F.lit(1).alias("_one")), [group], "_part", order, {"_nth": "_one"})
    starts = running(numbered.withColumn("_at", F.when(F.col("_gap"), F.col("_nth"))), [group], "_part", order, maxima={"_start": "_at"})
    first = ((F.col("_nth") - F.col("_start")) % rows == 0).cast("int")
    return running(starts.withColumn("_first", first), [group], "_part", order, {"batch": "_first"}).select(*columns, "batch")


def dedupe_step(id: str, known: int = KNOWN) -> Step:
    """One event against the last ``known`` distinct ids. The state is the list of these."""

    def step(state: dict, r: tuple) -> tuple[dict, tuple]:
        v = str(getattr(r, id))
        if v in state:
            return state, (False,)
        state[v] = 1
        if len(state) > known:
            state.pop(next(iter(state)))
        return state, (True,)

    return step


def limit_step(us: str, per_second: int, burst: int) -> Step:
    """One request against a window of max(burst / per_second, 1) s that begins with a key's first request."""
    window = max(burst // per_second if per_second > 0 else 1, 1) * 1_000_000

    def step(state: list, r: tuple) -> tuple[list, tuple]:
        t = int(getattr(r, us))
        if not state or t - state[0] >= window:
            state[:] = [t, 0]
        state[1] += 1
        return state, (state[1] <= burst,)

    return step


def breaker_step(us: str, failed: str, threshold: int = 5, recovery_us: int = 30_000_000, probes: int = 5, successes: int = 5) -> Step:
    """One call through a circuit breaker.

    Closed: opens after ``threshold`` failures in a row. Open: admits nothing
    until ``recovery_us`` after the last failure. Half open: admits ``probes``
    calls, closes after ``successes`` good ones (5 for requests, 1 for a
    dependency), opens at a failure.
    """

    def step(s: dict, r: tuple) -> tuple[dict, tuple]:
        if not s:
            s |= {"state": "closed", "fails": 0, "last": None, "tried": 0, "good": 0}
        t, bad = int(getattr(r, us)), bool(getattr(r, failed))
        if s["state"] == "open" and s["last"] is not None and t - s["last"] >= recovery_us:
            s |= {"state": "half_open", "tried": 0, "good": 0}
        if s["state"] == "open":
            return s, (False, "open")
        if s["state"] == "half_open":
            s["tried"] += 1
            if s["tried"] > probes:
                return s, (False, "half_open")
        if bad:
            s["fails"] += 1
            s["last"] = t
            if s["state"] == "half_open" or s["fails"] >= threshold:
                s["state"] = "open"
        elif s["state"] == "closed":
            s["fails"] = 0
        else:
            s["good"] += 1
            if s["good"] >= successes:
                s |= {"state": "closed", "fails": 0}
        return s, (True, s["state"])

    return step


def bounded_dedupe(events: DataFrame, group: str, order: list[str], id: str, known: int = KNOWN) -> DataFrame:
    """Events with ``fresh``: whether the id is not among the last ``known`` distinct ones, which repeats do not refresh."""
    return ordered_fold(events, [group], order, dedupe_step(id, known), dict, "fresh boolean")


def rate_limited(requests: DataFrame, key: str, us: str, per_second: int, burst: int, tie: str | None = None) -> DataFrame:
    """Requests with ``allowed``: up to ``burst`` in a window, see :func:`limit_step`."""
    return ordered_fold(requests, [key], [us, *([tie] if tie else [])], limit_step(us, per_second, burst), list, "allowed boolean")


def breaker_states(calls: DataFrame, key: str, us: str, failed: str, threshold: int = 5, recovery_us: int = 30_000_000, probes: int = 5, successes: int = 5, tie: str | None = None) -> DataFrame:
    """Calls with ``admitted`` and ``state`` (closed, open, half_open) after them, see :func:`breaker_step`."""
    step = breaker_step(us, failed, threshold, recovery_us, probes, successes)
    return ordered_fold(calls, [key], [us, *([tie] if tie else [])], step, dict, "admitted boolean, state string")


def in_flight(requests: DataFrame, group: str, start_us: Column, end_us: Column, part_us: int = PART_US) -> DataFrame:
    """``group, us, in_flight`` after each begin or end of a request; ends come before begins at the same time.

    Changes are summed by time before the running sum, which runs over ranges of ``part_us``.
    """
    marks = F.explode(F.array(F.struct(start_us.alias("us"), F.lit(1).alias("d")), F.struct(end_us.alias("us"), F.lit(-1).alias("d")))).alias("m")
    steps = requests.select(group, marks).select(group, "m.us", "m.d").groupBy(group, "us").agg(F.sum("d").alias("d"))
    return running(steps.withColumn("_part", F.floor(F.col("us") / part_us)), [group], "_part", ["us"], {"in_flight": "d"}).select(group, "us", "in_flight")


def shed_step(start: str, end: str, cap: int = CAP) -> Step:
    """One request against at most ``cap`` at once: whether it is let in. The state is the ends of those under way."""

    def step(state: list, r: tuple) -> tuple[list, tuple]:
        t = int(getattr(r, start))
        while state and state[0] <= t:
            heappop(state)
        if len(state) >= cap:
            return state, (False,)
        heappush(state, int(getattr(r, end)))
        return state, (True,)

    return step


def shed(requests: DataFrame, group: str, start: str, end: str, cap: int = CAP, tie: str | None = None) -> DataFrame:
    """Requests with ``let_in``: those beyond ``cap`` at once are refused and take no place."""
    return ordered_fold(requests, [group], [start, *([tie] if tie else [])], shed_step(start, end, cap), list, "let_in boolean")


def last_means(events: DataFrame, group: str, order: Sequence[str], value: str, n: int, k: int) -> DataFrame:
    """``group``, the order and ``total`` of the last ``n`` values, for each group's last ``k`` events: only so many events of a group are gathered."""
    newest = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    some = events.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= k + n - 1)
    total = F.sum(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(1 - n, 0))
    return some.select(group, *order, "_k", total.alias("total")).where(F.col("_k") <= k).drop("_k")


def notifications(events: DataFrame) -> DataFrame:
    """``id, kind, recipient, summary, created_at`` of committed transactions; other events and malformed ones are dropped."""
    p = F.from_json("payload", COMMITTED)
    # The text of a notice.
    base = F.concat(F.lit("Received "), p["amount"], F.lit(" "), p["currency"], F.lit(" from "), p["from_account"])
    text = F.when(p["reference_id"].isNotNull(), F.concat(base, F.lit(" (ref "), p["reference_id"], F.lit(")"))).otherwise(base)
    good = p["to_account"].isNotNull() & p["from_account"].isNotNull() & p["amount"].isNotNull() & p["currency"].isNotNull()
    return events.where((F.col("name") == "transactions.committed") & good).select("id", F.lit("transaction_committed").alias("kind"), p["to_account"].alias("recipient"), text.alias("summary"), F.col("occurred_at").alias("created_at"))


def recent(entries: DataFrame, n: int, ring: int = RING) -> DataFrame:
    """The newest ``n`` entries of a ring that keeps the last ``ring``."""
    return entries.orderBy(F.col("created_at").desc_nulls_last(), F.desc("id")).limit(min(n, ring, 200))


def notice_counters(events: DataFrame, ring: int = RING) -> DataFrame:
    """``other, malformed, kept, evicted``: what becomes of events on their way into a ring of notices, in one row."""
    p = F.from_json("payload", COMMITTED)
    mine = F.col("name") == "transactions.committed"
    good = p["to_account"].isNotNull() & p["from_account"].isNotNull() & p["amount"].isNotNull() & p["currency"].isNotNull()
    n = events.agg(F.count_if(~mine).alias("other"), F.count_if(mine & ~good).alias("malformed"), F.count_if(mine & good).alias("kept"))
    return n.withColumn("evicted", F.greatest(F.col("kept") - ring, F.lit(0).cast("bigint")))


def gated(method: Column, mode: Column) -> Column:
    """Whether a mode other than normal refuses a request: all but reads."""
    return (mode != "normal") & ~method.isin("GET", "HEAD", "OPTIONS")
