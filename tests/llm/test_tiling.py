"""String tiling against brute force."""

import random

import pytest

from talea.llm import tiling as t
from talea.llm.queries import QUERIES, SQL
from tests.compare import same


def test_found_same_as_sql(spark, data, duck):
    same(QUERIES["p6_found"](spark, data), duck, SQL["p6_found"])


def longest_common(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def greedy(a, b, least):
    """The definition: mark the longest free match again and again."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(out)
        for k in range(n):
            fa[i + k] = fb[j + k] = False
        out.append((i, j, n))


@pytest.mark.parametrize("seed", range(40))
def test_tiles_are_greedy(seed):
    rnd = random.Random(seed)
    a = [rnd.choice("abcdefgh"[: rnd.randrange(2, 9)]) for _ in range(rnd.randrange(60))]
    b = [rnd.choice("abcdefgh") for _ in range(20)] + a[10:40] + ["x"] + a[:12] + [rnd.choice("ab") for _ in range(20)]
    least = rnd.randrange(1, 9)
    mine, want = t.tiles(a, b, least), greedy(a, b, least)
    assert sorted((n for *_, n in mine), reverse=True)[:1] == sorted((n for *_, n in want), reverse=True)[:1]
    assert all(a[i : i + n] == b[j : j + n] and n >= least for i, j, n in mine)
    for side in (0, 1):
        taken = [x for m in mine for x in range(m[side], m[side] + m[2])]
        assert len(taken) == len(set(taken))
    # nothing of the least length is left free on both sides
    fa = [None if any(i <= k < i + n for i, _, n in mine) else w for k, w in enumerate(a)]
    fb = ["-" if any(j <= k < j + n for _, j, n in mine) else w for k, w in enumerate(b)]
    assert longest_common([w if w else object() for w in fa], fb) < least


def test_reordered_passages_are_covered():
    item = [f"w{i}" for i in range(40)]
    doc = ["x"] * 5 + item[20:] + ["y"] * 3 + item[:20]
    assert t.tiles(item, doc, 12) == [(0, 28, 20), (20, 5, 20)]
    assert t.tiles(item, item, 12) == [(0, 0, 40)] and t.tiles([], doc, 12) == [] and t.tiles(item, [], 12) == []


def test_words():
    assert t.words("Don’t STOP—3½ Ärger_x́y") == ["don", "t", "stop", "3½", "ärger", "x", "y"]
    assert t.words(None) == t.words(" .,") == []


def test_leaks(spark):
    item = " ".join(f"w{i}" for i in range(30))
    long = "z " * 50_000
    docs = [(1, f"A, {item.upper()}!"), (2, " ".join(item.split()[5:17])), (3, " ".join(item.split()[5:16])), (4, long + item), (5, None), (6, ""), (7, "short one here now"), (None, item), (8, item), (8, item)]
    items = [(100, item), (101, "Short one!"), (102, None), (103, "..."), (104, "one short"), (101, "Short one!")]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, seed string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, salt string")
    got = {(r.doc_id, r.item_id): (r.covered, r.item_words) for r in t.leaks(d, i).collect()}
    assert got == {(1, 100): (30, 30), (2, 100): (12, 30), (4, 100): (30, 30), (8, 100): (30, 30), (7, 101): (2, 2)}
    assert all(r.coverage >= t.COVER or r.longest >= min(t.LEAST, r.item_words) for r in t.leaks(d, i).collect())
    assert t.leaks(d.limit(0), i).count() == 0 and t.leaks(d, i.limit(0)).count() == 0


def test_short_blocks_in_another_order_are_found(spark):
    """All words of an item in blocks of 8 and of 5, none of which would be a leak by itself; half of them is too little."""
    words = [f"w{i}" for i in range(48)]
    eights = [words[i : i + 8] for i in range(0, 48, 8)]
    fives = [words[i : i + 5] for i in range(0, 45, 5)]
    apart = lambda blocks: " ".join(" ".join([*b, f"x{n}"]) for n, b in enumerate(blocks))
    docs = [(1, apart(eights[::-1])), (2, apart(fives[::2] + fives[1::2])), (3, apart(eights[:3])), (4, apart([words[i : i + 4] for i in range(0, 48, 4)]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(9, " ".join(words))], "item_id bigint, text string")
    got = {r.doc_id: (r.tiles, r.covered, r.longest, r.in_order) for r in t.leaks(d, i).collect()}
    assert got == {1: (6, 48, 8, False), 2: (9, 45, 5, False)}


def test_what_a_pair_must_share_is_never_more_than_a_reported_pair_shares(spark):
    """The filter before the tiling loses nothing: brute force over all pairs."""
    rnd = random.Random(6)
    text = lambda n: [rnd.choice("abcdefghijkl") for _ in range(n)]
    items = [text(rnd.choice([1, 3, 5, 6, 11, 12, 13, 25, 40])) for _ in range(25)]
    docs = []
    for _ in range(60):
        it = rnd.choice(items)
        cut = [it[a : a + rnd.randrange(4, 13)] for a in range(0, len(it), rnd.randrange(4, 9))]
        rnd.shuffle(cut)
        docs.append([w for c in cut for w in c] + text(5))
    want = set()
    for j, b in enumerate(docs):
        for i, a in enumerate(items):
            got = t.tiles(a, b, min(t.SEED, len(a)))
            if got and (sum(n for *_, n in got) >= t.COVER * len(a) or max(n for *_, n in got) >= min(t.LEAST, len(a))):
                want.add((j, i))
    frame = lambda x, name: spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(x)], f"{name} bigint, text string")
    assert {(r.doc_id, r.item_id) for r in t.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()} == want and want
