"""Budgets, thresholds and the draw."""

import random

import pytest

from talea.llm import mixture as m
from talea.llm.tokens import count_tokens, encoder, RANKS
from talea.llm.queries import QUERIES


def tables(spark, docs, targets):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, source string, tokens string")
    return d, spark.createDataFrame(targets, "mix string, source string, weight double, max_repeats int")


def test_tokens_of_odd_texts():
    texts = ["", "Hello world", "<|endoftext|>", " " * 300_000 + "x", "a" * 100_000, "é\ud800", "日本語 текст"]
    got = count_tokens(texts)
    own = encoder(RANKS)
    assert got[0] == 0 and got[1] == len(own.encode_ordinary("Hello world")) and got[2] > 1
    # the other way to split long white space gives the same as the tokenizer's own
    text = "a" + " " * 6000 + "b\n" + "\t " * 2600 + "c"
    assert count_tokens([text]) == [len(own.encode_ordinary(text))]


def filled(weights, most, total):
    """Brute force: raise one level in small steps, until the total is reached or all sources are used up."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most[k], mid * w) for k, w in weights.items()) < total else (lo, mid)
    return {k: min(most[k], lo * w) for k, w in weights.items()}


@pytest.mark.parametrize("total", [None, 5_000, 40_000, 10_000_000])
def test_shares_and_shortfalls(spark, total):
    rnd = random.Random(2)
    docs = [(i, "word " * rnd.randrange(1, 40), rnd.choice([" Web", "web", "FORUM", "forum ", "news", None, "other"])) for i in range(3000)]
    targets = [("m", "web", 0.5, 2), ("m", "Forum", 0.3, 1), ("m", "news", 0.2, 5), ("n", "web", 0.2, 1), ("n", "news", 0.6, 1), ("n", "nothing", 0.2, 1), ("m", "news", 0.2, 5), (None, "web", 1.0, 1), ("m", "zero", 0.0, 1)]
    d, t = tables(spark, docs, targets)
    draw, report = m.mixture(d, t, total=total)
    rows = {(r.mix, r.source): r for r in report.collect()}
    assert set(rows) == {("m", "web"), ("m", "forum"), ("m", "news"), ("n", "web"), ("n", "news"), ("n", "nothing")}
    have = {r.source: r.n for r in m.sizes(d).groupBy("source").agg(m.F.sum("tokens").alias("n")).collect()}
    caps = {("m", "web"): 2, ("m", "forum"): 1, ("m", "news"): 5, ("n", "web"): 1, ("n", "news"): 1, ("n", "nothing"): 1}
    for mix in "mn":
        mine = {k[1]: r for k, r in rows.items() if k[0] == mix}
        size = sum(have.get(k, 0) for k in mine) if total is None else total
        want = filled({k: r.goal for k, r in mine.items()}, {k: have.get(k, 0) * caps[mix, k] for k in mine}, size)
        for k, r in mine.items():
            assert abs(r.budget - want[k]) <= 1 and abs(r.target - r.goal * size) <= 1 and r.shortfall == max(0, r.target - r.budget)
            # a record has at most 41 tokens
            assert abs(r.drawn_tokens - r.budget) <= 41
        assert abs(sum(r.share for r in mine.values()) - 1) < 1e-9
    assert rows["n", "nothing"].drawn_tokens == 0 and rows["n", "nothing"].shortfall > 0
    got = draw.collect()
    assert all(1 <= r.copies <= caps[r.mix, r.source] for r in got) and len({(r.mix, r.doc_id) for r in got}) == len(got)
    if total == 5_000:  # nothing binds: the shares are the weights
        assert all(abs(r.share - r.goal) < 0.01 for k, r in rows.items() if k[0] == "m")


def test_a_small_source_does_not_shrink_the_mix(spark):
    docs = [(i, "some words here", "big" if i else "small") for i in range(2000)]
    draw, report = m.mixture(*tables(spark, docs, [("m", "big", 0.5, 2), ("m", "small", 0.5, 2)]))
    rows = {r.source: r for r in report.collect()}
    assert (rows["small"].drawn_tokens, rows["small"].most_copies) == (6, 2) and rows["small"].shortfall > 2000
    assert rows["big"].records == 1998 and rows["big"].drawn_tokens + 6 == 6000


def test_thresholds_equal_a_sort_and_are_nested(spark):
    rnd = random.Random(4)
    docs = [(i, "x " * rnd.randrange(0, 30), "s") for i in range(500)]
    d, t = tables(spark, docs, [("m", "s", 1.0, 1)])
    sized = m.sizes(d)
    by_hash = sorted((r.h, r.tokens) for r in sized.collect())
    total = sum(n for _, n in by_hash)
    small = None
    for part in (0, 1, total // 3, total // 2, total):
        b = spark.createDataFrame([("m", "s", 1.0, 1.0, 1, total, part)], "mix string, source string, weight double, goal double, cap int, have bigint, budget bigint")
        r = m.thresholds(sized, b).first()
        if part == total:
            assert (r.base, r.below) == (1, 0)
            continue
        taken = {h for h, _ in by_hash if h < r.below}
        size = sum(n for h, n in by_hash if h in taken)
        best = min(abs(part - sum(n for _, n in by_hash[:k])) for k in range(len(by_hash) + 1))
        assert r.base == 0 and abs(size - part) == best
        assert small is None or small <= taken
        small = taken


def test_empty_and_null(spark):
    docs = [(1, None, "a"), (2, "", "a"), (None, "some words here", "a"), (3, "some words here", None)]
    d, t = tables(spark, docs, [("m", "a", 0.5, None), ("m", "b", 0.5, 1)])
    draw, report = m.mixture(d, t)
    assert {r.source: r.drawn_tokens for r in report.collect()} == {"a": 3, "b": 0}
    draw, report = m.mixture(d.limit(0), t)
    assert draw.count() == 0 and all(r.share == 0 for r in report.collect())
    assert m.mixture(d, t.limit(0))[0].count() == 0


def test_queries(spark, data):
    shares = QUERIES["p7_shares"](spark, data).collect()
    assert len(shares) == 12
    for mix in ("balanced", "expert"):
        assert abs(sum(r.share for r in shares if r.mix == mix) - 1) < 1e-9
