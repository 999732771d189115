"""The queries p2, p3, p4 and p5, and their SQL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talea.functions.keys import account_key, number, plain_text
from talea.operators import copies, hotkeys, orphans, rolling
from talea.operators.current import current_rows
from talea.session import stored
from talea.sources.tables import table

#: p2_corrected: what arrived before this day is the first version of the state.
FIRST_LOAD = "2024-04-01"
#: p2_versions: where the loads are cut.
LOADS = ("2024-02-01", "2024-03-01", "2024-04-01", "2024-05-01")


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Trailing 7- and 30-day count, total and average per sending account and day."""
    tx = current_rows(table(spark, d, "transactions"), "from_account", "amount", "created_at")
    state = rolling.rolling_state(rolling.daily_amounts(tx))
    return rolling.with_averages(state).select(F.col("key").alias("account"), "day", *[f"{x}_{w}" for w in rolling.WINDOWS for x in ("n", "total", "avg")])


def _versioned(spark: SparkSession, d: str, cuts: Sequence[str]) -> DataFrame:
    """The state as it stands after several loads: the rows that arrived before the first cut, between it and the next, and so on.

    A load's rows replace known versions of their ids, which are looked up by
    id in the loads before; what changes in the daily amounts is applied to
    them, and the affected days are written as a new version that starts from
    the state of the day before.
    """
    names = ("id", "from_account", "amount", "created_at")
    tx = table(spark, d, "transactions", *names, "updated_at")
    at = F.col("updated_at")
    ends = [F.lit(c).cast("timestamp") for c in cuts]
    loads = [at < ends[0], *[(at >= a) & (at < b) for a, b in zip(ends, ends[1:])], (at >= ends[-1]) | at.isNull()]
    arrived = [stored(current_rows(tx.where(x), *names[1:], keep_version=True)) for x in loads]
    daily = stored(rolling.daily_amounts(arrived[0]))
    versions = stored(rolling.rolling_state(daily).withColumn("version", F.lit(1)))
    for v in range(1, len(loads)):
        # of earlier loads only the ids that arrive again
        known = [x.join(arrived[v].select("id"), "id", "left_semi") for x in arrived[:v]]
        changes = stored(rolling.arrival_changes(current_rows(reduce(DataFrame.unionByName, known), *names[1:], keep_version=True), arrived[v]))
        earlier, daily = daily, stored(rolling.changed_daily(daily, changes))
        versions = versions.unionByName(stored(rolling.advanced(versions, earlier, daily, changes, version=v + 1)))
    state = rolling.with_averages(rolling.latest(versions))
    return state.select(F.col("key").alias("account"), "day", *[f"{x}_{w}" for w in rolling.WINDOWS for x in ("n", "total", "avg")])


def p2_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The same figures, from a first version of the state and the corrections that later arrivals cause."""
    return _versioned(spark, d, (FIRST_LOAD,))


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    """The same figures, the state being advanced load by load, each month's arrivals and corrections at a time."""
    return _versioned(spark, d, LOADS)


def _references(spark: SparkSession, d: str) -> DataFrame:
    tx = current_rows(table(spark, d, "transactions"), "from_account", "to_account", "created_at")
    outbox = table(spark, d, "cross_shard_outbox", "id", "to_account", "created_at").distinct()
    return orphans.references(
        orphans.Reference("transactions", tx, ("from_account", "to_account")),
        orphans.Reference("cross_shard_outbox", outbox, ("to_account",)),
    )


def _orphans(spark: SparkSession, d: str, refs: DataFrame) -> DataFrame:
    parents = orphans.parent_births(table(spark, d, "users", "account_number", "created_at"))
    return orphans.orphans(refs, parents, orphans.removed_keys(table(spark, d, "account_tombstone", "account_number")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References to accounts that do not exist at the record's time."""
    # repeats of one outbox id with another spelling of the account are one case
    return _orphans(spark, d, _references(spark, d)).select("tab", "id", "field", "kind").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field and month."""
    refs = _references(spark, d)
    return orphans.orphan_report(refs, _orphans(spark, d, refs))


def p4_figures(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct counterparties, most frequent counterparty and latest time per account and side."""
    tx = table(spark, d, "transactions", "from_account", "to_account", "created_at")
    return hotkeys.key_figures(hotkeys.side_frequencies(tx, "from_account", "to_account", "created_at"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that hold at least 1 % of all stored rows on a side."""
    totals = hotkeys.side_totals(table(spark, d, "transactions"), "from_account", "to_account")
    return hotkeys.hot_keys(p4_figures(spark, d), totals).select("side", "account")


FIELDS = ("reference_id", "status", "amount")


def _differences(spark: SparkSession, d: str) -> DataFrame:
    def normal(df: DataFrame) -> DataFrame:
        amount = F.col("amount").cast("decimal(38,10)") if dict(df.dtypes)["amount"].startswith("decimal") else number("amount", 10)
        return df.select(F.lower(F.trim("id")).alias("id"), plain_text("reference_id").alias("reference_id"), F.lower(F.trim("status")).alias("status"), amount.alias("amount"))

    tx = table(spark, d, "transactions", "id", "updated_at", *FIELDS).withColumn("id", F.lower(F.trim("id")))
    copy = table(spark, d, "transactions_copy", "id", *FIELDS)
    return copies.compare_copies(normal(current_rows(tx, *FIELDS)), normal(copy), "id", FIELDS, multiset=False)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Transactions lacking on a side, and the fields that differ."""
    names = F.create_map(F.lit("missing_right"), F.lit("missing_in_copy"), F.lit("missing_left"), F.lit("missing_in_source"))
    found = _differences(spark, d).where("kind in ('missing_right', 'missing_left', 'field')")
    return found.select("id", F.coalesce("field", names[F.col("kind")]).alias("field"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Each differing field with both values, amounts at their shortest scale of at least 2."""
    found = _differences(spark, d).where("kind = 'field'")
    short = lambda c: F.when(F.col("field") == "amount", F.regexp_replace(c, r"(\.\d\d\d*?)0*$", "$1")).otherwise(F.col(c)).alias(c)
    return found.select("id", "field", short("left_value"), short("right_value"))


def p5_repeated(spark: SparkSession, d: str) -> DataFrame:
    """The copies compared by a key that repeats, each stored copy row counted: how many fields differ under a reference, and rows too many."""
    c = F.col
    fields = ("account", "status", "amount")
    tx = current_rows(table(spark, d, "transactions", "id", "updated_at", "reference_id", "from_account", "status", "amount"), "reference_id", "from_account", "status", "amount")
    copy = table(spark, d, "transactions_copy", "reference_id", "from_account", "status", "amount").withColumn("amount", number("amount", 10))
    normal = lambda df: df.select(plain_text("reference_id").alias("reference_id"), account_key("from_account").alias("account"), F.lower(F.trim("status")).alias("status"), c("amount").cast("decimal(38,10)").alias("amount"))
    found = copies.compare_copies(normal(tx), normal(copy), "reference_id", fields)
    # which of several equally near rows are paired is open; how much they differ is not
    return found.groupBy("reference_id", "kind").agg(F.sum("n").alias("n"))


QUERIES = {
    "p2_rolling": p2_rolling,
    "p2_corrected": p2_corrected,
    "p2_versions": p2_versions,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_figures": p4_figures,
    "p5_found": p5_found,
    "p5_values": p5_values,
    "p5_repeated": p5_repeated,
}

_KEY = "nullif(upper(trim({}, ' ' || chr(9))), '')"
_DAY = "(DATE '1970-01-01' + CAST(epoch_us({}) // 86400000000 AS INTEGER))"

CURRENT_SQL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM transactions WHERE id IS NOT NULL) WHERE rn = 1"

_P2 = f"""
WITH tx AS ({CURRENT_SQL}),
daily AS (
  SELECT {_KEY.format("from_account")} AS account, {_DAY.format("created_at")} AS day, count(*) AS n, sum(amount) AS total
  FROM tx WHERE {_KEY.format("from_account")} IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2),
span AS (SELECT account, min(day) AS lo, max(day) AS hi FROM daily GROUP BY 1),
days AS (SELECT account, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
filled AS (SELECT account, day, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM days LEFT JOIN daily USING (account, day)),
roll AS (
  SELECT account, day, sum(n) OVER w7 AS n_7, sum(total) OVER w7 AS total_7, sum(n) OVER w30 AS n_30, sum(total) OVER w30 AS total_30
  FROM filled WINDOW w7 AS (PARTITION BY account ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY account ORDER BY day ROWS 29 PRECEDING))
SELECT account, day, CAST(n_7 AS BIGINT) AS n_7, CAST(total_7 AS DECIMAL(38,2)) AS total_7,
  CASE WHEN n_7 > 0 THEN CAST(total_7 AS DOUBLE) / CAST(n_7 AS DOUBLE) END AS avg_7,
  CAST(n_30 AS BIGINT) AS n_30, CAST(total_30 AS DECIMAL(38,2)) AS total_30,
  CASE WHEN n_30 > 0 THEN CAST(total_30 AS DOUBLE) / CAST(n_30 AS DOUBLE) END AS avg_30
FROM roll"""

_REFS = f"""
tx AS ({CURRENT_SQL}),
refs AS (
  SELECT * FROM (
    SELECT 'transactions' AS tab, 'from_account' AS field, id, {_KEY.format("from_account")} AS k, created_at FROM tx
    UNION ALL SELECT 'transactions', 'to_account', id, {_KEY.format("to_account")}, created_at FROM tx
    UNION ALL SELECT DISTINCT 'cross_shard_outbox', 'to_account', id, {_KEY.format("to_account")}, created_at FROM cross_shard_outbox)
  WHERE k IS NOT NULL),
parents AS (SELECT {_KEY.format("account_number")} AS k, min(created_at) AS born FROM users GROUP BY 1),
gone AS (SELECT DISTINCT {_KEY.format("account_number")} AS k FROM account_tombstone),
judged AS (
  SELECT r.tab, r.field, r.id, r.k, r.created_at,
    CASE WHEN p.k IS NOT NULL THEN CASE WHEN p.born > r.created_at THEN 'late' END WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
  FROM refs r LEFT JOIN parents p ON r.k = p.k LEFT JOIN gone g ON r.k = g.k)"""

_SIDES = f"""
s AS (
  SELECT 'from_account' AS side, {_KEY.format("from_account")} AS account, {_KEY.format("to_account")} AS other, created_at FROM transactions
  UNION ALL SELECT 'to_account', {_KEY.format("to_account")}, {_KEY.format("from_account")}, created_at FROM transactions)"""

_P5 = f"""
WITH tx AS ({CURRENT_SQL}),
s AS (SELECT lower(trim(id)) AS id, nullif(trim(reference_id), '') AS reference_id, lower(trim(status)) AS status, CAST(amount AS DECIMAL(38,10)) AS amount FROM tx),
c AS (SELECT DISTINCT lower(trim(id)) AS id, nullif(trim(reference_id), '') AS reference_id, lower(trim(status)) AS status,
  TRY_CAST(replace(trim(amount), ',', '') AS DECIMAL(38,10)) AS amount FROM transactions_copy WHERE id IS NOT NULL),
j AS (SELECT coalesce(s.id, c.id) AS id, s.id AS sid, c.id AS cid, s.reference_id AS sr, c.reference_id AS cr, s.status AS ss, c.status AS cs, s.amount AS sa, c.amount AS ca
  FROM s FULL JOIN c ON s.id = c.id)"""

_SHORT = r"regexp_replace(CAST({} AS VARCHAR), '(\.\d\d\d*?)0*$', '\1')"

SQL = {
    "p2_rolling": _P2,
    "p2_corrected": _P2,
    "p2_versions": _P2,
    "p3_found": f"WITH {_REFS} SELECT DISTINCT tab, id, field, kind FROM judged WHERE kind IS NOT NULL",
    "p3_report": f"""WITH {_REFS} SELECT tab, field, CAST(date_trunc('month', {_DAY.format("created_at")}) AS DATE) AS month, count(*) AS refs,
  count(*) FILTER (WHERE kind = 'late') AS late, count(*) FILTER (WHERE kind = 'deleted') AS deleted, count(*) FILTER (WHERE kind = 'missing') AS missing,
  count(DISTINCT k) FILTER (WHERE kind IS NOT NULL) AS orphan_keys FROM judged GROUP BY 1, 2, 3""",
    "p4_found": f"WITH {_SIDES} SELECT side, account FROM s WHERE account IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 100 >= (SELECT count(*) FROM transactions)",
    "p4_figures": f"""WITH {_SIDES},
f AS (SELECT side, account, other, count(*) AS n, max(created_at) AS latest FROM s WHERE account IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT side, account, other, n, row_number() OVER (PARTITION BY side, account ORDER BY n DESC, other) AS rn FROM f WHERE other IS NOT NULL),
g AS (SELECT side, account, CAST(sum(n) AS BIGINT) AS n, count(other) AS counterparties, max(latest) AS latest FROM f GROUP BY 1, 2)
SELECT g.side, g.account, g.n, g.counterparties, m.other AS top_counterparty, m.n AS top_n, g.latest
FROM g LEFT JOIN m ON g.side = m.side AND g.account = m.account AND m.rn = 1""",
    "p5_found": f"""{_P5}
SELECT id, 'missing_in_copy' AS field FROM j WHERE cid IS NULL UNION SELECT id, 'missing_in_source' FROM j WHERE sid IS NULL
UNION SELECT id, 'reference_id' FROM j WHERE sid IS NOT NULL AND cid IS NOT NULL AND sr IS DISTINCT FROM cr
UNION SELECT id, 'status' FROM j WHERE sid IS NOT NULL AND cid IS NOT NULL AND ss IS DISTINCT FROM cs
UNION SELECT id, 'amount' FROM j WHERE sid IS NOT NULL AND cid IS NOT NULL AND sa IS DISTINCT FROM ca""",
    "p5_values": f"""{_P5}
SELECT id, 'reference_id' AS field, sr AS left_value, cr AS right_value FROM j WHERE sid IS NOT NULL AND cid IS NOT NULL AND sr IS DISTINCT FROM cr
UNION ALL SELECT id, 'status', ss, cs FROM j WHERE sid IS NOT NULL AND cid IS NOT NULL AND ss IS DISTINCT FROM cs
UNION ALL SELECT id, 'amount', {_SHORT.format("sa")}, {_SHORT.format("ca")} FROM j WHERE sid IS NOT NULL AND cid IS NOT NULL AND sa IS DISTINCT FROM ca""",
    # the least cost by trying every way to give each leftover row of the smaller side another of the greater
    "p5_repeated": f"""WITH RECURSIVE tx AS ({CURRENT_SQL}),
u AS (SELECT nullif(trim(reference_id), '') AS k, {_KEY.format("from_account")} AS f, lower(trim(status)) AS s, CAST(amount AS DECIMAL(38,10)) AS a, 1 AS l, 0 AS r FROM tx
  UNION ALL SELECT nullif(trim(reference_id), ''), {_KEY.format("from_account")}, lower(trim(status)), TRY_CAST(replace(trim(amount), ',', '') AS DECIMAL(38,10)), 0, 1 FROM transactions_copy),
c AS (SELECT k, f, s, a, sum(l) AS l, sum(r) AS r FROM u WHERE k IS NOT NULL GROUP BY 1, 2, 3, 4),
t AS (SELECT k, CAST(sum(l) AS BIGINT) AS nl, CAST(sum(r) AS BIGINT) AS nr, CAST(sum(greatest(l - r, 0)) AS BIGINT) AS na, CAST(sum(greatest(r - l, 0)) AS BIGINT) AS nb FROM c GROUP BY 1),
o AS (SELECT c.k, f, s, a, (l > r) = (na <= nb) AS small, unnest(generate_series(1, CAST(abs(l - r) AS BIGINT))) AS x FROM c JOIN t USING (k) WHERE l <> r AND na > 0 AND nb > 0),
e AS (SELECT *, row_number() OVER (PARTITION BY k, small ORDER BY f, s, a, x) AS i FROM o),
way(k, i, used, cost) AS (SELECT DISTINCT k, 0, 0::BIGINT, 0 FROM e UNION ALL
  SELECT w.k, w.i + 1, w.used | (1::BIGINT << CAST(q.i AS INTEGER)), w.cost + CAST(p.f IS DISTINCT FROM q.f AS INTEGER) + CAST(p.s IS DISTINCT FROM q.s AS INTEGER) + CAST(p.a IS DISTINCT FROM q.a AS INTEGER)
  FROM way w JOIN e p ON p.k = w.k AND p.small AND p.i = w.i + 1 JOIN e q ON q.k = w.k AND NOT q.small AND (w.used >> CAST(q.i AS INTEGER)) & 1 = 0)
SELECT k AS reference_id, 'field' AS kind, CAST(min(cost) AS BIGINT) AS n FROM way JOIN t USING (k) WHERE i = least(na, nb) GROUP BY 1
UNION ALL SELECT k, 'missing_right', nl FROM t WHERE nr = 0 UNION ALL SELECT k, 'missing_left', nr FROM t WHERE nl = 0
UNION ALL SELECT k, 'extra_left', na - nb FROM t WHERE nl > 0 AND nr > 0 AND na > nb UNION ALL SELECT k, 'extra_right', nb - na FROM t WHERE nl > 0 AND nr > 0 AND nb > na""",
}
