"""Test items leaking into documents: greedy string tiling by running Karp-Rabin hashes.

Shared runs of a few words are the seeds that bring a document and an item
together; the tiling marks their longest common passages, longest first; a
pair is reported if the tiles cover enough of the item, in whatever order they
lie, or if one of them is long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talea.session import stored

#: The words of a seed, and of the shortest tile.
SEED = 5
#: The share of an item's words that tiles must cover.
COVER = 0.8
#: The number of consecutive words that is a leak by itself.
LEAST = 12
#: Where the search for long matches starts.
START = 32
#: Bits of the bitmap of the items' seeds: so many for each seed, but no less and no more than these (8 MB).
BITS_EACH, BITS_LEAST, BITS_MOST = 16, 1 << 16, 1 << 26
#: Into how many parts the documents with one seed are split.
SALTS = 16
_RUNS = regex.compile(r"[\p{L}\p{N}]+")
_MOD, _BASE = (1 << 61) - 1, 1_000_003

Tile = tuple[int, int, int]


def words(text: str | None) -> list[str]:
    """The maximal runs of letters and digits, in lower case."""
    return [w.lower() for w in _RUNS.findall(text or "")]


def _free_windows(marked: bytearray, size: int) -> Iterator[int]:
    """Starts of the windows of ``size`` unmarked words."""
    run = 0
    for i, m in enumerate(marked):
        run = 0 if m else run + 1
        if run >= size:
            yield i - size + 1


def _hashes(codes: list[int], size: int) -> list[int]:
    """The Karp-Rabin hash of every window, each from the one before."""
    if len(codes) < size:
        return []
    top, h = pow(_BASE, size - 1, _MOD), 0
    for c in codes[:size]:
        h = (h * _BASE + c) % _MOD
    out = [h]
    for old, new in zip(codes, codes[size:]):
        h = ((h - old * top) * _BASE + new) % _MOD
        out.append(h)
    return out


def tiles(item: list[str], doc: list[str], least: int) -> list[Tile]:
    """``(item position, document position, length)`` of a greedy tiling, longest matches first.

    Tiles share no word on either side and are at least ``least`` words long;
    their order may differ between item and document. Equal lengths: the one
    that begins first in the item, then in the document, is taken.
    """
    if least < 1 or len(item) < least or len(doc) < least:
        return []
    ids: dict[str, int] = {}
    a = [ids.setdefault(w, len(ids) + 1) for w in item]
    b = [ids.get(w, 0) for w in doc]
    marked_a, marked_b, out = bytearray(len(a)), bytearray(0 if c else 1 for c in b), []
    size = max(least, min(START, len(a)))
    while True:
        ha, hb = _hashes(a, size), _hashes(b, size)
        at: dict[int, list[int]] = {}
        for i in _free_windows(marked_a, size):
            at.setdefault(ha[i], []).append(i)
        found, longest = [], 0
        for j in _free_windows(marked_b, size):
            for i in at.get(hb[j], ()):
                if i and j and not marked_a[i - 1] and not marked_b[j - 1] and a[i - 1] == b[j - 1]:
                    continue  # the longer match began before
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not marked_a[i + n] and not marked_b[j + n]:
                    n += 1
                if n >= size:
                    found.append((-n, i, j))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest  # much longer matches exist: they go first
            continue
        again = False
        for n, i, j in sorted(found):
            if any(marked_a[i : i - n]) or any(marked_b[j : j - n]):
                again = True  # a longer one took part of it; what is left of it is found by another scan
                continue
            marked_a[i : i - n] = marked_b[j : j - n] = b"\1" * -n
            out.append((i, j, -n))
        if again:
            continue
        if size == least:
            return sorted(out)
        size = size // 2 if size >= 2 * least else least


def _seeds(texts: Iterable[str], sizes: list[int], seed: int, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of words, the place of the text that each is from, and where in it the run begins.

    ``every``: runs of all ``sizes``; otherwise of ``seed`` words, or of all words of a shorter text.
    The hash is that of Karp and Rabin modulo 2^64 over a whole batch at once; the run's length is mixed in.
    """
    coded = [[word_code(w) for w in words(t)] for t in texts]
    n = np.array([len(c) for c in coded], dtype=np.int64)
    codes = np.fromiter(chain.from_iterable(coded), dtype=np.uint64, count=int(n.sum()))
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    left = np.repeat(n, n) - at  # words from here to the text's end
    own = np.minimum(n, seed)[owner] if len(owner) else n
    seeds, places, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s in sizes:
        if s > len(codes):
            continue
        h = np.full(len(codes) - s + 1, s, dtype=np.uint64)
        for k in range(s):
            h = h * np.uint64(_BASE) + codes[k : k + len(h)]
        fits = left[: len(h)] >= s
        if not every:
            fits &= own[: len(h)] == s
        seeds.append(h[fits])
        places.append(owner[: len(h)][fits])
        starts.append(at[: len(h)][fits])
    return np.concatenate(seeds).view(np.int64), np.concatenate(places), np.concatenate(starts)


def _sieve(i: DataFrame) -> np.ndarray:
    """The bitmap of the items' seeds, put together by 64 bits at a time: at most BITS_MOST / 64 numbers reach the driver."""
    bits = BITS_LEAST
    while bits < BITS_MOST and bits < BITS_EACH * i.count():
        bits *= 2
    at = F.col("seed").bitwiseAND(bits - 1)
    word = F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("word")
    parts = i.groupBy(F.shiftright(at, 6).alias("at")).agg(word).toPandas()
    marks = np.zeros(bits // 64, dtype=np.int64)
    marks[parts["at"].to_numpy()] = parts["word"].to_numpy()
    return marks


def _salted(df: DataFrame) -> DataFrame:
    """Each row once per salt. Written, as the planner would take it to be no larger than ``df`` and broadcast it by that."""
    return stored(df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))


def _need(n: Column, seed: int, cover: float, least: int) -> Column:
    """How many of an item's seeds a document has at least, if it is to be reported.

    A tile of L words holds L - seed + 1 seeds, so a share of the words has at
    least a share / seed of them; a long passage of ``least`` words has
    least - seed + 1.
    """
    own = F.least(n, F.lit(seed))
    return F.least(F.ceil(n * cover / own), F.least(n, F.lit(least)) - own + 1)


def _shared_seeds(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, doc_text: str, item_text: str, seed: int, cover: float, least: int) -> DataFrame | None:
    """``doc, item`` of the pairs that share as many seeds as a pair to be reported must.

    Seeds are runs of ``seed`` words, or all words of a shorter item. A false
    seed is harmless: the tiling compares the words. Most seeds of documents
    meet no item and are left out where they arise, by a bitmap of the items'
    seeds; it may let others through, but loses none. Seeds are joined under a
    salt, as a phrase of an item may be in very many documents.
    """
    spark = docs.sparkSession
    # at most `seed` numbers
    sizes = sorted(r.s for r in items.select(F.least(n_words(item_text), F.lit(seed)).alias("s")).where("s > 0").distinct().collect())
    if not sizes:
        return None

    def seeded(df: DataFrame, id: str, text: str, every: bool, sieve: Broadcast | None) -> DataFrame:
        def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                seeds, places, starts = _seeds(f["text"], sizes, seed, every)
                if sieve is not None and len(seeds):
                    marks = sieve.value
                    kept = (marks[(seeds & (len(marks) * 64 - 1)) >> 6] >> (seeds & 63)) & 1 > 0
                    seeds, places, starts = seeds[kept], places[kept], starts[kept]
                ids = f["id"].to_numpy()[places] if len(f) else []
                out = pd.DataFrame({"id": ids, "seed": seeds, "at": starts})
                yield out if sieve is None else out.drop_duplicates(["id", "seed"])

        slim = df.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
        return slim.mapInPandas(parts, "id bigint, seed bigint, at bigint")

    i = stored(seeded(items, item_id, item_text, False, None).withColumnRenamed("id", "item").distinct())
    d = seeded(docs, doc_id, doc_text, True, spark.sparkContext.broadcast(_sieve(i))).select(F.col("id").alias("doc"), "seed", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    met = d.join(_salted(i), ["seed", "salt"]).groupBy("doc", "item").agg(F.count("*").alias("hits"))
    need = items.select(F.col(item_id).alias("item"), n_words(item_text).alias("n")).where("n > 0").groupBy("item").agg(F.min(_need(F.col("n"), seed, cover, least)).alias("need"))
    return met.join(need, "item").where("hits >= need").select("doc", "item")


@lru_cache(maxsize=1 << 18)
def word_code(word: str) -> int:
    """A 61-bit code of a word, the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(word) % _MOD


def n_words(text: str) -> Column:
    """The number of words of a text column; 0 for null."""

    @F.pandas_udf("long")
    def counted(s: pd.Series) -> pd.Series:
        return s.map(lambda t: len(words(t))).astype("int64")

    return counted(F.col(text))


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    seed: int = SEED, cover: float = COVER, least: int = LEAST,
) -> DataFrame:
    """``doc_id, item_id, tiles, covered, item_words, longest, coverage, in_order``: one row per document and item it contains, whole or in part.

    A pair has a row if tiles of at least ``seed`` words cover the share
    ``cover`` of the item's words, wherever they lie, or if ``least``
    consecutive words of the item (all of a shorter item's) occur in the
    document. ``covered`` is the number of the item's words in tiles, so that a
    passage whose parts were put in another order is still covered;
    ``in_order`` says whether they kept their order. Null ids and texts, texts
    without words and empty tables give no rows. Repeated rows of an id count
    once; if an id has several texts, the greatest coverage is given.
    """
    pairs = _shared_seeds(docs, items, doc_id, item_id, text, text, seed, cover, least)
    out = f"{doc_id} bigint, {item_id} bigint, tiles int, covered int, item_words int, longest int, coverage double, in_order boolean"
    if pairs is None:
        return docs.sparkSession.createDataFrame([], out)
    d = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("doc_text")).where("doc_text is not null")
    # items are joined under a salt: a document that a third of the corpus copies brings one item into as many pairs
    i = items.select(F.col(item_id).alias("item"), F.col(text).alias("item_text")).where("item_text is not null").distinct()
    texts = pairs.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(_salted(i), ["item", "salt"]).join(d, "doc")

    def tiled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, item, dt, it in zip(f["doc"], f["item"], f["doc_text"], f["item_text"]):
                a, b = words(it), words(dt)
                got = tiles(a, b, min(seed, len(a)))
                covered, longest = sum(n for _, _, n in got), max((n for _, _, n in got), default=0)
                if got and (covered >= cover * len(a) or longest >= min(least, len(a))):
                    places = [j for _, j, _ in got]
                    rows.append((doc, item, len(got), covered, len(a), longest, covered / len(a), places == sorted(places)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    found = texts.select("doc", "item", "doc_text", "item_text").mapInPandas(tiled, out)
    names = [c.split()[0] for c in out.split(", ")][2:]
    best = F.max(F.struct("covered", "longest", "tiles", "item_words", "coverage", "in_order")).alias("b")
    return found.groupBy(doc_id, item_id).agg(best).select(doc_id, item_id, *[f"b.{c}" for c in names])
