"""Small cases for rolling totals, orphan references, hot keys and copies."""

import datetime as dt
import random
from collections import Counter, defaultdict
from decimal import Decimal
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from talea.operators import copies, hotkeys, orphans, rolling
from talea.operators.assignment import cheapest_transport
from talea.operators.current import current_rows

DAY0 = dt.date(2024, 1, 1)


def at(day, hour=12):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def brute(daily, windows=(7, 30)):
    """Trailing figures from {(key, day): (n, total)}."""
    out = {}
    for key in {k for k, _ in daily}:
        days = [d for k, d in daily if k == key]
        for d in range(min(days), max(days) + 1):
            row = []
            for w in windows:
                inside = [daily[key, x] for x in range(d - w + 1, d + 1) if (key, x) in daily]
                row += [sum(n for n, _ in inside), sum((t for _, t in inside), Decimal(0))]
            out[key, d] = tuple(row)
    return out


def figures(state):
    return {(r.key, (r.day - DAY0).days): (r.n_7, r.total_7, r.n_30, r.total_30) for r in state.collect()}


TX = "id string, from_account string, amount decimal(18,2), created_at timestamp, updated_at timestamp"


def test_current_rows_takes_the_latest_and_drops_null_ids(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 9, "n"), ("b", None, "q")], "id string, updated_at int, v string")
    assert sorted((r.id, r.v) for r in current_rows(df).collect()) == [("a", "z"), ("b", "q")]
    assert current_rows(df.limit(0)).count() == 0


def test_rolling_state_equals_brute_force(spark):
    rnd = random.Random(1)
    rows, daily = [], defaultdict(lambda: (0, Decimal(0)))
    for i in range(300):
        k, d, a = rnd.choice("abc"), rnd.choice([0, 1, 2, 9, 35, 36, 70, 100]), Decimal(rnd.randrange(1, 10**6)) / 100
        rows.append((str(i), f" {k}\t", a, at(d, rnd.choice([0, 23])), at(d)))
        n, t = daily[k.upper(), d]
        daily[k.upper(), d] = n + 1, t + a
    state = rolling.rolling_state(rolling.daily_amounts(spark.createDataFrame(rows, TX)))
    assert figures(state) == brute(daily)


def test_rolling_nulls_and_empty(spark):
    rows = [("1", None, Decimal(1), at(0), at(0)), ("2", "  ", Decimal(1), at(0), at(0)), ("3", "a", None, at(0), at(0)), ("4", "a", Decimal(5), None, at(0))]
    df = spark.createDataFrame(rows, TX).withColumn("n", F.lit(1)).withColumn("key", F.lit("clash"))
    out = rolling.with_averages(rolling.rolling_state(rolling.daily_amounts(df))).collect()
    assert [(r.key, r.n_7, r.total_7, r.avg_7) for r in out] == [("A", 1, Decimal(0), 0.0)]
    assert rolling.rolling_state(rolling.daily_amounts(df.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_versions_and_corrections_equal_a_full_count(spark, seed):
    rnd = random.Random(seed)
    records, known = {}, {}
    schema = TX
    versions, daily_df, v = None, None, 0
    for batch in range(3):
        arrived = []
        for _ in range(25):
            i = str(rnd.randrange(60))
            day = rnd.choice([0, 3, 5, 20, 40, 41, 90]) + 10 * batch * rnd.choice([0, 1])
            arrived.append((i, rnd.choice("ab"), Decimal(rnd.randrange(1, 9999)) / 100, at(day), dt.datetime(2024, 6, 1) + dt.timedelta(hours=batch * 100 + len(arrived))))
        arrived = list({r[0]: r for r in arrived}.values())
        k = spark.createDataFrame(list(known.values()), schema)
        a = spark.createDataFrame(arrived, schema)
        changes = rolling.arrival_changes(k, a)
        v += 1
        if versions is None:
            daily_df = rolling.daily_amounts(a)
            versions = rolling.rolling_state(daily_df).withColumn("version", F.lit(v))
        else:
            earlier, daily_df = daily_df, rolling.changed_daily(daily_df, changes)
            versions = versions.unionByName(rolling.advanced(versions, earlier, daily_df, changes, v))
        versions, daily_df = spark.createDataFrame(versions.collect(), versions.schema), spark.createDataFrame(daily_df.collect(), daily_df.schema)
        known |= {r[0]: r for r in arrived}
        daily = defaultdict(lambda: (0, Decimal(0)))
        for _, key, amount, t, _u in known.values():
            n, s = daily[key.upper(), (t.date() - DAY0).days]
            daily[key.upper(), (t.date() - DAY0).days] = n + 1, s + amount
        assert figures(rolling.latest(versions)) == brute(daily), (seed, batch)


def test_orphans_of_each_kind(spark):
    t = lambda d: at(d)
    rows = spark.createDataFrame(
        [("1", "a", t(5), 1), ("1", "a", t(5), 1), ("2", " A\t", t(1), 1), ("3", "gone", t(1), 1), ("4", "never", t(1), 1), ("5", None, t(1), 1), ("6", " ", t(1), 1), ("7", "a", None, 1), ("8", "late2", t(0), 1)],
        "id string, to_account string, created_at timestamp, k int",
    )
    users = spark.createDataFrame([("A ", t(3)), ("a", t(9)), ("late2", None)], "account_number string, created_at timestamp")
    dead = spark.createDataFrame([("GONE",), ("GONE",), (None,)], "account_number string")
    refs = orphans.references(orphans.Reference("t", rows, ("to_account",)))
    found = orphans.orphans(refs, orphans.parent_births(users), orphans.removed_keys(dead))
    assert sorted((r.id, r.kind) for r in found.collect()) == [("2", "late"), ("3", "deleted"), ("4", "missing")]
    report = {(str(r.month)): (r.refs, r.late, r.deleted, r.missing, r.orphan_keys) for r in orphans.orphan_report(refs, found).collect()}
    assert report == {"2024-01-01": (6, 1, 1, 1, 3), "None": (1, 0, 0, 0, 0)}
    assert orphans.orphans(refs, orphans.parent_births(users.limit(0)), orphans.removed_keys(dead.limit(0))).where("kind = 'missing'").count() == 7
    assert orphans.orphans(refs.limit(0), orphans.parent_births(users), orphans.removed_keys(dead)).count() == 0


def test_hot_keys_and_figures(spark):
    rows = [("hot", f"x{i % 7}", at(i)) for i in range(90)] + [("b", None, at(1)), (None, "x1", at(1)), (" B ", "x1", at(2))] + [(f"c{i}", "x1", None) for i in range(7)]
    df = spark.createDataFrame(rows, "f string, t string, created_at timestamp").withColumn("n", F.lit(0)).withColumn("side", F.lit("clash"))
    fig = hotkeys.key_figures(hotkeys.side_frequencies(df, "f", "t", "created_at"))
    got = {(r.side, r.account): r for r in fig.collect()}
    hot = got["f", "HOT"]
    assert (hot.n, hot.counterparties, hot.top_counterparty, hot.top_n, hot.latest) == (90, 7, "X0", 13, at(89))
    assert (got["f", "B"].n, got["f", "B"].counterparties) == (2, 1) and got["f", "C1"].latest is None
    assert got["t", "X1"].counterparties == 9
    names = hotkeys.hot_keys(fig, hotkeys.side_totals(df, "f", "t"), 10).select("side", "account").collect()
    assert {(r.side, r.account) for r in names if r.side == "f"} == {("f", "HOT")}
    assert hotkeys.key_figures(hotkeys.side_frequencies(df.limit(0), "f", "t", "created_at")).count() == 0


def _differing(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("seed", range(60))
def test_assignment_is_of_least_cost(seed):
    """Against all permutations; with many fields each pair has its arc, with few the combinations of values have."""
    rnd = random.Random(seed)
    pad = (0,) * rnd.choice([0, 0, 7])
    sides = [sorted({tuple(rnd.randrange(3 + side) for _ in range(3)) + pad for _ in range(rnd.randrange(1, 5))}) for side in (0, 1)]
    many = [[rnd.randrange(1, 3) for _ in s] for s in sides]
    pairs = cheapest_transport(sides[0], many[0], sides[1], many[1])
    units = sorted(([x for x, n in zip(s, m) for _ in range(n)] for s, m in zip(sides, many)), key=len)
    best = min(sum(map(_differing, units[0], p)) for p in permutations(units[1], len(units[0])))
    assert sum(n for *_, n in pairs) == len(units[0]) and sum(_differing(sides[0][i], sides[1][j]) * n for i, j, n in pairs) == best
    for side in (0, 1):
        assert all(sum(p[2] for p in pairs if p[side] == i) <= n for i, n in enumerate(many[side]))


def _copies(spark, left, right, **options):
    schema = "id string, a string, b int, c string, kind string"
    l = spark.createDataFrame([(*r, "clash") for r in left], schema)
    r = spark.createDataFrame([(*r, "clash") for r in right], schema)
    return sorted((x.id, x.kind, x.field) for x in copies.compare_copies(l, r, "id", ["a", "b", "c"], **options).collect() for _ in range(x.n))


def test_copies_cancel_and_pair(spark):
    left = [("1", "x", 1, "p"), ("2", "x", 1, "p"), ("2", "x", 1, "p"), ("3", "x", 1, None), ("4", "u", 1, "p"), ("4", "v", 2, "q"), ("5", "z", 9, "z"), (None, "n", 0, "n"), ("7", "x", 1, "p")]
    right = [("1", "x", 1, "p"), ("2", "x", 1, "p"), ("3", "x", 1, ""), ("4", "v", 2, "r"), ("4", "u", 1, "s"), ("6", "z", 9, "z"), ("7", "x", 2, "p"), ("7", "y", 2, "q"), ("7", "x", 3, "q")]
    assert _copies(spark, left, right) == [
        ("2", "extra_left", None), ("3", "field", "c"), ("4", "field", "c"), ("4", "field", "c"), ("5", "missing_right", None), ("6", "missing_left", None),
        ("7", "extra_right", None), ("7", "extra_right", None), ("7", "field", "b"),
    ]
    assert ("2", "extra_left", None) not in _copies(spark, left, right, multiset=False)
    assert _copies(spark, [], right[:1]) == [("1", "missing_left", None)] and _copies(spark, [], []) == []


def _least(left, right):
    """Dense Hungarian method over units, for tests."""
    a, b = Counter(left), Counter(right)
    rows, cols = sorted((list((a - b).elements()), list((b - a).elements())), key=len)
    inf, m = float("inf"), len(cols)
    u, v, own = [0] * (len(rows) + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, len(rows) + 1):
        own[0], j, low, way, used = i, 0, [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while own[j]:
            used[j], step, nxt = True, inf, 0
            for k in range(1, m + 1):
                if not used[k]:
                    c = _differing(rows[own[j] - 1], cols[k - 1]) - u[own[j]] - v[k]
                    if c < low[k]:
                        low[k], way[k] = c, j
                    if low[k] < step:
                        step, nxt = low[k], k
            for k in range(m + 1):
                if used[k]:
                    u[own[k]] += step
                    v[k] -= step
                else:
                    low[k] -= step
            j = nxt
        while j:
            own[j], j = own[way[j]], way[j]
    return sum(_differing(rows[own[k] - 1], cols[k - 1]) for k in range(1, m + 1) if own[k])


@pytest.mark.parametrize("arcs", [copies.ARCS, 3])
def test_copies_of_many_rows_under_a_key(spark, arcs):
    """Of least cost; beyond the arcs of a task every row is paired, at a cost that may be greater."""
    rnd = random.Random(8)
    left, right = ([("k", rnd.choice("abc"), rnd.randrange(9), rnd.choice("vwxyz")) for _ in range(120)] for _ in "lr")
    found, least = _copies(spark, left, right, arcs=arcs), _least(left, right)
    assert len(found) == least if arcs > 3 else least <= len(found) <= 1.3 * least
    assert {k for _, k, _ in found} == {"field"}


def test_copies_of_ten_thousand_rows_under_a_key(spark):
    """5,000 leftover rows a side whose least cost is known: each was made from its partner by changing one or two fields to new values."""
    rnd = random.Random(2)
    left = [("k", f"a{rnd.randrange(10**9)}", i, rnd.choice("xyz")) for i in range(5000)]
    fresh = iter(range(10**6, 2 * 10**6))
    two = [rnd.random() < 0.3 for _ in left]
    right = [("k", f"n{next(fresh)}" if t else a, next(fresh), c) for (_, a, _, c), t in zip(left, two)]
    rnd.shuffle(right)
    found = _copies(spark, left, right)
    # the first field tells the partners apart; those that changed it too are left to agree in the third only
    assert Counter(f for _, _, f in found) == {"a": sum(two), "b": 5000}
    assert copies.compare_copies(*[spark.createDataFrame(x, "id string, a string, b int, c string") for x in (left, left[:2])], "id", ["a", "b", "c"]).where("kind = 'extra_left'").first().n == 4998


@pytest.mark.parametrize("seed", range(3))
def test_copies_do_not_depend_on_where_the_network_lies(spark, seed):
    """In memory or in files, as pairs or as combinations of values: the same differences, as few as there can be."""
    rnd = random.Random(seed)
    some = lambda: (rnd.choice(["a", "b", None, "=", "-"]), rnd.choice([1, 2, 3, None]), rnd.choice(["x", "y", ",", None, "1=x"]))
    left, right = ([(k, *some()) for k, n in (("p", 60), ("q", 40), ("r", 9), ("s", 3)) for _ in range(rnd.randrange(n, 2 * n))] for _ in "lr")
    frames = [spark.createDataFrame(x, "id string, a string, b int, c string") for x in (left, right)]
    found = [sorted(map(tuple, copies.compare_copies(*frames, "id", ["a", "b", "c"], arcs=arcs).groupBy("id", "kind", "field", "left_value", "right_value").agg(F.sum("n")).collect()), key=str) for arcs in (copies.ARCS, 3)]
    assert found[0] == found[1]
    of = lambda rows, k: [x for x in rows if x[0] == k]
    assert sum(x[-1] for x in found[0] if x[1] == "field") == sum(_least(of(left, k), of(right, k)) for k in "pqrs")
