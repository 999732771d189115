"""The queries without SQL on the stored tables: what must hold of their rows."""

from pyspark.sql import functions as F

from talea.llm import tiling
from talea.llm.encoding import SPLIT
from talea.llm.queries import QUERIES
from talea.sources.tables import table


def test_leaks_hold_the_found_pairs(spark, data):
    leaks = {(r.doc_id, r.item_id): r for r in QUERIES["p6_leaks"](spark, data).collect()}
    found = {tuple(r) for r in QUERIES["p6_found"](spark, data).collect()}
    assert found and found <= set(leaks)
    texts = {r.doc_id: r.text for r in table(spark, data, "documents", "doc_id", "text").collect()}
    items = {r.item_id: r.text for r in table(spark, data, "eval_items", "item_id", "text").collect()}
    for (doc, item), r in leaks.items():
        a = tiling.words(items[item])
        tiles = tiling.tiles(a, tiling.words(texts[doc]), min(tiling.SEED, len(a)))
        assert (r.tiles, r.covered, r.item_words) == (len(tiles), sum(n for *_, n in tiles), len(a))
        assert (doc, item) in found or r.covered >= tiling.COVER * len(a)


def test_restored_reviews_are_the_found_ones(spark, data):
    found = {r.doc_id for r in QUERIES["p8_found"](spark, data).collect()}
    back = {r.doc_id: r for r in QUERIES["p8_restored"](spark, data).collect()}
    texts = {r.doc_id: r.text for r in table(spark, data, "documents", "doc_id", "text").collect()}
    assert found and found == set(back)
    for i, r in back.items():
        assert r.damaged > 0 and (r.unrecovered > 0 or r.restored != texts[i])
        # words that are not damaged, and all blanks, stay
        assert len(SPLIT.split(r.restored)) == len(SPLIT.split(texts[i]))


def test_shares_are_those_of_the_draw(spark, data):
    shares = {(r.mix, r.source): r for r in QUERIES["p7_shares"](spark, data).collect()}
    drawn = QUERIES["p7_mixture"](spark, data).groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n"), F.max("copies").alias("most")).collect()
    assert {(r.mix, r.source): (r.n, r.most) for r in drawn} == {k: (r.drawn_tokens, r.most_copies) for k, r in shares.items() if r.records}
    caps = {(r.mix, r.source.strip().lower()): r.max_repeats for r in table(spark, data, "mix_targets").collect()}
    assert all(r.most_copies <= max(caps[k], 1) and (r.shortfall == 0 or r.most_copies in (0, caps[k])) for k, r in shares.items())
