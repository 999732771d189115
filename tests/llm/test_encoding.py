"""Misread text made from clean text, found and restored."""

import math
import random

import pytest

from talea.llm import encoding as e

SENTENCES = [
    "Das Café schließt früh – schöne Grüße aus Köln!", "L’été dernier, à Nîmes, nous étions ravis de la qualité.", "El niño compró una lámpara después de la función.",
    "It’s better than I’d hoped… about 20 °C for £40.", "Товар бесполезный, деньги на ветер.", "Przesyłka dotarła wcześniej niż sądziłem.", "とても丈夫で、家族も気に入っています。", "I paid €30 — what a 😀 deal.",
]
DECOYS = ["ÎLE, ÂNE, ÊTRE", "¡¡¡ATENCIÓN!!! ¿TALLA Ñ?", "Gehäuse Ø 12 mm, Toleranz ±½ mm.", "Printed © and ® marks look fine.", "Rated 5 µF / 20 Ω", "NÃO COMPREI", "»sehr gut« & co. &amp; so", "⭐⭐⭐⭐⭐"]


def corpus():
    rnd = random.Random(7)
    docs, truth = [], {}
    for i in range(900):
        clean = " ".join(rnd.choice(SENTENCES) for _ in range(3)) + " " + rnd.choice([*DECOYS, "", ""])
        docs.append((i, clean))
    channels = {
        "utf8": lambda s: "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in s.encode()),
        "mac": lambda s: s.encode().decode("mac_roman"), "cp437": lambda s: s.encode().decode("cp437"), "latin": lambda s: s.encode().decode("latin-1"),
        "lost": lambda s: s.encode().decode("ascii", "replace"), "cp850": lambda s: s.encode("cp1252").decode("cp850"), "cp1250": lambda s: s.encode("cp1250").decode("cp1252"), "cp1251": lambda s: s.encode("cp1251").decode("cp1252"),
        "koi8": lambda s: s.encode("koi8_r").decode("cp1251"), "twice": lambda s: channels["utf8"](channels["utf8"](s)),
    }
    per = {"cp850": [0, 1, 2, 3], "cp1250": [5], "cp1251": [4], "koi8": [4]}
    n = 900
    for name, garble in channels.items():
        for k in per.get(name, range(8)):
            clean = SENTENCES[k]
            truth[n] = clean + " Fine."
            docs.append((n, garble(clean) + " Fine."))
            n += 1
    return docs, truth


def test_found_and_restored(spark):
    docs, truth = corpus()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, word string")
    found = e.damaged(df)
    ids = {r.id for r in found.collect()}
    assert not ids - set(truth), sorted(ids - set(truth))[:5]
    assert len(ids) >= 0.95 * len(truth), sorted(set(truth) - ids)
    back = {r.doc_id: r.restored for r in e.restored(df, found).collect()}
    good = sum(back[i] == truth[i] for i in back)
    assert good >= 0.85 * len(truth), [(back[i], truth[i]) for i in back if back[i] != truth[i]][:5]


def test_copies_of_a_damaged_text_do_not_make_it_usual(spark):
    docs, truth = corpus()
    one = "Das Café war gut.".encode("cp1252").decode("cp850")
    copies = [(10_000 + i, one) for i in range(len(docs) // 2)]
    df = spark.createDataFrame(docs + copies, "doc_id bigint, text string")
    found = e.damaged(df)
    ids = {r.id for r in found.collect()}
    assert {i for i, _ in copies} <= ids and not ids - set(truth) - {i for i, _ in copies}
    assert {r.restored for r in e.restored(df, found).collect() if r.doc_id >= 10_000} == {"Das Café war gut."}


def test_lost_letters(spark):
    """A question mark amid letters stands for one if the corpus has such a word; a lost byte is given the letter of the likeliest word."""
    rows = [(i, f"Café schließt früh, Gäste gehen heim {i}") for i in range(200)] + [(300, "Das Caf? schlie?t fr?h"), (301, "Caf\ufffd schlie\ufffdt"), (302, "fr\u00c3\ufffdh und G\u00c3\ufffdste"), (303, "see page?id=3 or why?because wh?t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    back = {r.doc_id: r.restored for r in e.restored(df, e.damaged(df)).collect()}
    assert back == {300: "Das Caf? schließt früh", 301: "Café schließt", 302: "früh und Gäste"}


def test_a_word_found_damaged_elsewhere_is_not_usual(spark):
    """A lone damaged word that also lies in damaged spans of other texts."""
    wrong = lambda t: t.encode("koi8_r").decode("cp1251")
    rows = [(i, f"Заказ сделан в среду, день {i}. Доставили раньше срока") for i in range(300)]
    rows += [(400 + i, wrong(f"Заказ сделан в среду, день {i}. Доставили раньше срока")) for i in range(6)] + [(500, "Заказ сделан в " + wrong("среду") + ", день 15. Доставили раньше срока")]
    found = {r.id: r.damaged for r in e.damaged(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(found) == {400, 401, 402, 403, 404, 405, 500} and found[500] == 1


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "plain words only"), (4, "x" * 300_000 + " " + "é" * 5_000 + "." * 50_000 + "é"), (None, "cafÃ©"), (5, "lost � byte"), (6, "control \x85\x9d here")] + [(10 + i, "un café et un thé") for i in range(50)] + [(80, "un cafÃ© et un thÃ©"), (80, "un cafÃ© et un thÃ©")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.id: (r.damaged, r.unrecovered) for r in e.damaged(df).collect()}
    assert set(found) == {5, 6, 80} and found[6][1] > 0
    assert e.damaged(df.limit(0)).count() == 0


def test_undo_keeps_what_was_not_misread():
    chars = e.Characters({"é": 50, "n": 100, "a": 100, "“": 5, "Ã": 1, "©": 1, "ï": 5})
    assert e.undo_utf8("“naÃ¯ve”Ã©", "cp1252", chars) == "“naïve”é"
    assert e.undo_utf8("NÃO", "cp1252", chars) == "NÃO"
    assert e.decode_words([]) == []
    assert e.decode_words([[("cp1252<cp850", "x", False, 5.0)]]) == [None]
    assert e.decode_words([[("a<b", "x", False, 6.0)], [("a<b", "y", False, 6.0)]]) == [("a<b", "x", False), ("a<b", "y", False)]


def test_any_word_of_the_corpus_may_fill_a_lost_byte(spark):
    """However rare its letter is among those that fit: here the eighth of those whose first byte is known."""
    rows = [(i, f"łoś środa szyba życie nő fű cœur koń {i}") for i in range(60)] + [(100 + i, f"sieťová karta {i}") for i in range(30)] + [(200, "sieÅ�ovÃ¡ karta")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: (r.restored, r.channels) for r in e.restored(df, e.damaged(df)).collect()} == {200: ("sieťová karta", "utf8<cp1252^1")}


def test_ways_with_lost_bytes_equal_all_ways():
    """Against every way through small lattices: the best of all, and the best of the corpus's words."""
    rnd = random.Random(3)
    letters = "aeéèüÜßñcфЖжA-1İ"
    read = e._read_as("cp1252")
    chars = e.Characters({c: rnd.randrange(1, 500) for c in [*letters, e.LOST, *(x for c in letters if ord(c) > 127 for b in c.encode() for x in read.get(b, ()))]})

    def every(text, i=0):
        if i == len(text):
            return {""}
        found = {text[i] + x for x in every(text, i + 1)}
        for at, run in e._runs(text, "cp1252"):
            fits = [c for c, raw in chars.by_lead.get(len(run), ()) if all(a in (-2, b) for a, b in zip(run, raw, strict=True))]
            found |= {c + x for c in fits if at == i for x in every(text, i + len(run))}
        return found

    for _ in range(60):
        text = "".join(rnd.choice([e.LOST, read.get(b, (e.LOST,))[0]]) if b > 127 else chr(b) for b in "".join(rnd.choice(letters) for _ in range(3)).encode())
        if e.LOST not in text:
            continue
        gains = {x: g for x in every(text) if (g := e._gain(text, text, x, chars)) is not None}
        mine = [g for x in e.ways_utf8(text, "cp1252", chars) if (g := e._gain(text, text, x, chars)) is not None]
        assert max(gains.values(), default=0) == pytest.approx(max(mine, default=0)), text
        seen = {p: rnd.randrange(1, 99) for p in sorted({e.probe(x) for x in gains}) if rnd.random() < 0.5}
        got = [math.log(seen[e.probe(x)] + 0.5) + g for c, x, g in e.Corpus(seen, chars).ways(text) if c == "utf8<cp1252^1"]
        best = max((math.log(seen[e.probe(x)] + 0.5) + g for x, g in gains.items() if e.probe(x) in seen), default=None)
        assert best is None or got and got[0] >= best - 1e-9, text
