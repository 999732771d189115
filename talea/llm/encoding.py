"""Text read in the wrong character encoding: found and restored by noisy-channel decoding.

A channel says in which encoding text was written and in which it was read.
Undoing it turns the characters of a word back into bytes, with a wildcard for
each byte that was lost (U+FFFD), and looks for the characters those bytes can
stand for. The ways to do so form a lattice; the best path through it is found
by a Viterbi search under the frequencies of characters. The words it gives
are weighed by how often they occur in the corpus against how often the word
as it stands does, and a second Viterbi search over the words of a document,
whose states are the channels, decides which words are damaged: to enter a
channel is costly, to stay in it is not, so that a damaged span is decoded as
one and a lone odd word is left as it is.

Only words with characters beyond ASCII (or character references, or question
marks in place of letters) can be damaged. Their distinct forms, not the documents, are decoded, so the costly
part grows with the vocabulary.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talea.session import stored

#: Readers of UTF-8 as one byte a character. ``cp1252`` also reads the bytes it leaves undefined, as latin-1 does.
SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "cp866", "iso8859_2", "cp852", "iso8859_5", "cp1253", "cp1254", "cp1257")
#: Writers of one byte a character, and who may have misread them, the likelier first.
WESTERN, CENTRAL, CYRILLIC = ("cp1252", "cp850", "cp437", "mac_roman"), ("cp1250", "iso8859_2", "cp852"), ("cp1251", "koi8_r", "cp866", "iso8859_5")
PAIRS = tuple(
    (w, r)
    for writers, readers in (
        (WESTERN, (*WESTERN, *CENTRAL, *CYRILLIC, "cp1253")),
        (CENTRAL, ("cp1252", *CENTRAL, "cp850", "cp437", "mac_roman", *CYRILLIC)),
        (CYRILLIC, (*CYRILLIC, *WESTERN, *CENTRAL)),
        (("cp1253", "cp1254", "cp1257"), ("cp1252",)),
    )
    for w in writers
    for r in readers
    if w != r
)
#: Writers of several bytes a character besides UTF-8, and readers of UTF-8 of that kind.
MULTI = ("cp932", "euc_jp", "gbk", "big5", "euc_kr")
#: How often UTF-8 may have been misread in turn.
LEVELS = 4
#: Log-odds of a damaged span's begin (UTF-8 misread, which proves itself by its form; any other), of its end, and of going on.
ENTER_UTF8, ENTER, LEAVE, STAY = -6.0, -9.0, -0.5, -0.05
#: Hypotheses whose characters are so much less likely than the word as it stands are not weighed.
UNLIKELY = -3.0
#: Log-odds for a word of ordinary shape, against one with capitals or signs amid its small letters.
SHAPE = 4.0
#: Log-odds for a word in another script than it seems to be in: of one or two letters, and longer.
OTHER_SCRIPT, OTHER_SCRIPT_LONG = -8.0, -2.0
#: Log-odds for other Cyrillic letters in place of one or two.
OTHER_CYRILLIC = -4.0
#: Invisible characters that later steps strip: soft hyphen and no-break space, the second bytes of í and à in UTF-8.
STRIPPED = "\u00ad\u00a0"
#: Log-odds of a question mark amid letters, before the frequency of the word it may stand for: it may also be one.
QUESTION = 4.0
#: Log-odds of a less likely channel, by its place in the lists, if two give one word.
RANK = -0.02
#: Ways of less log-odds are not searched.
LEAST_ODDS = -3.0
#: By how much a second look must raise a word's log-odds, and by how much it may.
LEAST_SHIFT, MOST_SHIFT = 0.5, 6.0
#: Forms that one task decodes, and the most tasks for them.
FORMS, MOST_TASKS = 1_000, 20_000
#: Words of the corpus that a task holds at once to look for those that a lattice with lost bytes has.
HELD = 50_000
#: Categories of characters that no text has.
NO_TEXT = ("Cn", "Co", "Cs", "Cc")
LOST = "�"
SPLIT = re.compile("[ \t\r\n]+")
#: The first byte of à to ÿ without one that could be its second.
_BARE = re.compile("Ã(?![\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ])")
_DIGITS = re.compile(r"\d")
#: What a word or text has that can be damaged: characters beyond ASCII, character references, question marks amid letters.
ODD = r"[^\x00-\x7F]|&[A-Za-z#][A-Za-z0-9]+;|[A-Za-z]\?+[A-Za-z]"
_ASKED = re.compile(r"(?<=[^\W\d_])\?(?=\??[^\W\d_])|(?<=[^\W\d_]\?)\?(?=[^\W\d_])")
_PART = re.compile(r"[^\W\d_]")
_BEYOND = re.compile(r"[^\x00-\x7F]+")
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
#: ASCII but for its letters.
_ENDS = "".join(chr(i) for i in range(128) if not chr(i).isalpha())


@lru_cache(maxsize=None)
def _tables(name: str) -> tuple[dict[str, int], dict[int, str]]:
    """Character to byte and byte to character, for bytes from 0x80."""
    to_char = {}
    for b in range(0x80, 0x100):
        try:
            to_char[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            if name in ("cp1252", "cp1250", "cp1254", "cp1257", "cp1253", "cp1251"):
                to_char[b] = chr(b)
    to_byte = {c: b for b, c in to_char.items()}
    if name == "cp1252":
        to_byte |= {chr(b): b for b in range(0x80, 0xA0)}
    return to_byte, to_char


class Characters:
    """Log-probabilities of characters, from their counts in the corpus."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.total = sum(counts.values()) + 1
        self.logs = {c: math.log((n + 0.5) / self.total) for c, n in counts.items()}
        self.unseen = math.log(0.5 / self.total) - 6
        # for wildcards: characters beyond ASCII by their bytes in UTF-8, likeliest first
        self.by_lead: dict[bytes, list[tuple[str, bytes]]] = {}
        for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if ord(c) > 127 and c != LOST and not 0x80 <= ord(c) < 0xA0 and not 0xD800 <= ord(c) < 0xE000:
                self.by_lead.setdefault(len(c.encode()), []).append((c, c.encode()))
        self.fits: dict[tuple[int, ...], list[str]] = {}
        # by the first of the small letters and noughts as which it is counted: a character, and the rest of these
        self.as_counted: dict[str, list[tuple[str, str]]] = {}
        for c in sorted({x for c in counts for x in (c, c.lower(), c.upper(), c.title()) if len(x) == 1}):
            for low in {_DIGITS.sub("0", c.lower()), *("ς" if c == "Σ" else ())}:
                self.as_counted.setdefault(low[0], []).append((c, low[1:]))

    def fillers(self, run: tuple[int, ...]) -> list[str]:
        """The characters whose bytes fit a run with lost ones (-2): the likeliest of each kind, as it stands and as a small letter."""
        if run not in self.fits:
            best: dict[tuple, str] = {}
            for c, raw in self.by_lead.get(len(run), ()):
                if all(a in (-2, b) for a, b in zip(run, raw)) and unicodedata.category(c) not in NO_TEXT:
                    for low in (False, True):
                        at = (low, _kind(c))
                        if at not in best or self.log(c, low) > self.log(best[at], low):
                            best[at] = c
            self.fits[run] = list(dict.fromkeys(best.values()))
        return self.fits[run]

    def log(self, c: str, low: bool = False) -> float:
        return sum(self.logs.get(x, self.unseen) for x in c.lower()) if low else self.logs.get(c, self.unseen)

    def of(self, text: str) -> float:
        """The log-probability of a text; capitals of a word all in capitals count as small letters."""
        letters = [c for c in text if c.isalpha()]
        if len(letters) > 1 and all(c.isupper() for c in letters):
            text = text.lower()
        return sum(self.logs.get(c, self.unseen) for c in text)


def _utf8_length(lead: int) -> int:
    return 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0


def _runs(text: str, reader: str) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Where bytes of one character of UTF-8 can begin in ``text``, and these; -2 for a lost one."""
    to_byte = _tables(reader)[0]
    codes = [to_byte.get(c, -1) if c != LOST else -2 for c in text]
    for i, lead in enumerate(codes):
        for k in () if lead == -1 else (_utf8_length(lead),) if lead >= 0 else (2, 3, 4):
            run = tuple(codes[i : i + k])
            if k and len(run) == k and -1 not in run and not any(0 <= b < 0x80 or b >= 0xC0 for b in run[1:]):
                yield i, run


def _decoded(run: tuple[int, ...]) -> list[str]:
    try:
        c = bytes(run).decode()
    except UnicodeDecodeError:
        return []
    return [c] if unicodedata.category(c) not in NO_TEXT else []


def undo_utf8(text: str, reader: str, chars: Characters) -> str:
    """The likeliest text whose UTF-8 bytes, read by ``reader``, give ``text``.

    The lattice has an edge for each character left as it is, and for each
    character that a run of bytes can stand for; a lost byte fits any. Without
    a run the text comes back unchanged.
    """
    n = len(text)
    edges: list[list[tuple[int, str]]] = [[(i + 1, c)] for i, c in enumerate(text)]
    for i, run in _runs(text, reader):
        edges[i] += [(i + len(run), c) for c in (chars.fillers(run) if -2 in run else _decoded(run))]
    best: list[tuple[float, tuple | None] | None] = [(0.0, None)] + [None] * n
    for i in range(n):
        score, chain = best[i]
        best[i] = None  # what begins here is decided
        for at, c in edges[i]:
            if best[at] is None or score + chars.log(c) > best[at][0]:
                best[at] = (score + chars.log(c), (chain, c))
    return _unchained(best[n][1])


def _unchained(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, c = chain
        out.append(c)
    return "".join(reversed(out))


@lru_cache(maxsize=None)
def _kind(c: str) -> tuple:
    """What of a character the odds of a word's shape and script depend on: its script, and whether it is a letter, a capital, small, a title's, part of words, of two cases, a sign, a digit, Latin beyond ASCII."""
    alpha, high = c.isalpha(), ord(c) > 127
    return (
        frozenset(_scripts(c)), alpha, c.isupper(), c.islower(), c.istitle() and not c.isupper(), bool(_PART.match(c)), c.lower() != c.upper(),
        high and unicodedata.category(c)[0] in "SN", "0" <= c <= "9", alpha and "\x80" <= c < "Ͱ",
    )


def _odd_part(part: tuple | None) -> bool:
    if not part or not part[-1]:
        return False
    small, capital, title, first, rest_small, rest_other, _ = part
    return not ((small and not capital and not title) or (capital and not small and not title) or (first and rest_small and not rest_other))


#: Of an empty word: its scripts, letters (3: or more), whether all are capitals, whether it is odd, its last part, what its last character is.
_EMPTY = (frozenset(), 0, True, False, None, (False, False, False, False))


@lru_cache(maxsize=1 << 16)
def _shape(of: tuple, kind: tuple) -> tuple:
    """The shape, as :func:`_odd`, :func:`_scripts` and the search see it, of a word of shape ``of`` with one more character."""
    scripts, letters, capitals, odd, part, (alpha, digit, latin, sign) = of
    own, is_alpha, upper, lower, title, wordy, cased, is_sign, is_digit, is_latin = kind
    odd = odd or (sign and is_alpha) or (digit and is_latin) or (latin and is_digit)
    if not wordy:
        odd, part = odd or _odd_part(part), None
    elif part is None:
        part = (lower, upper, title, upper, False, False, cased)
    else:
        a, b, c, first, d, e, f = part
        part = (a or lower, b or upper, c or title, first, d or lower, e or upper or title, f or cased)
    if odd:
        # it stays so
        return scripts | own, min(3, letters + is_alpha), capitals and (upper or not is_alpha), True, None, _EMPTY[-1]
    return scripts | own, min(3, letters + is_alpha), capitals and (upper or not is_alpha), odd, part, (is_alpha, is_digit, is_latin, is_sign and alpha)


def _likeliest(n: int, end: int, edges: Callable[[int, int], Iterable[tuple[int, int, str, bool]]], chars: Characters, scripts: int = 3) -> list[str]:
    """Of the ways from place 0 to ``n``, the likeliest of each shape.

    The odds of a word follow from its shape and its characters, so that no
    other way of the same shape has better ones. ``edges(i, t)`` gives ``(place,
    place in the word looked for, character, whether it is restored)``. Ways
    of more than so many scripts are left out.
    """
    # capitals of a word all in capitals count as small letters: such ways are followed on their own
    best: list[dict[tuple, tuple[float, tuple | None]]] = [{} for _ in range(n + 1)]
    best[0] = {(0, _EMPTY, low, False): (0.0, None) for low in (False, True)}
    for i in range(n):
        for (t, shape, low, changed), (score, chain) in best[i].items():
            for at, to, c, fresh in edges(i, t):
                kind = _kind(c)
                if low and kind[1] and not kind[2]:
                    continue
                key, gain = (to, _shape(shape, kind), low, changed or fresh), score + chars.log(c, low)
                if len(key[1][0]) <= scripts and (key not in best[at] or gain > best[at][key][0]):
                    best[at][key] = (gain, (chain, c))
        best[i] = {}  # what begins here is decided
    return list(dict.fromkeys(_unchained(chain) for (t, _, _, changed), (_, chain) in best[n].items() if changed and t == end))


def ways_utf8(text: str, reader: str, chars: Characters, scripts: int = 3) -> list[str]:
    """The texts whose UTF-8 bytes, read by ``reader``, give ``text``: of each shape and script the likeliest by its characters.

    These are all that can be best among words that the corpus has not; those
    that it has are found by :class:`Corpus`.
    """
    edges: list[list[tuple[int, int, str, bool]]] = [[(i + 1, 0, c, False)] for i, c in enumerate(text)]
    for i, run in _runs(text, reader):
        edges[i] += [(i + len(run), 0, c, True) for c in (chars.fillers(run) if -2 in run else _decoded(run))]
    return _likeliest(len(text), 0, lambda i, _: edges[i], chars, scripts)


@lru_cache(maxsize=None)
def _read_as(reader: str) -> dict[int, tuple[str, ...]]:
    out: dict[int, tuple[str, ...]] = {}
    for c, b in _tables(reader)[0].items():
        out[b] = (*out.get(b, ()), c)
    return out


class _Reading:
    """Which characters, misread so and so often by ``reader``, can lie where in ``text``."""

    def __init__(self, text: str, reader: str) -> None:
        self.text, self.read_as, self.known = text, _read_as(reader), {}

    def ends(self, c: str, level: int, i: int) -> frozenset[int]:
        """Where ``c`` can end if it begins at ``i``: as it is, or its bytes, each read or lost."""
        if not level:
            return frozenset((i + 1,)) if self.text[i : i + 1] == c else frozenset()
        key = (c, level, i)
        if key not in self.known:
            at = {i} if ord(c) > 127 else set()
            for b in c.encode("utf-8", "surrogatepass") if at else b"":
                at = {e for x in (*self.read_as.get(b, ()), LOST) for j in at for e in self.ends(x, level - 1, j)}
                if not at:
                    break
            self.known[key] = self.ends(c, level - 1, i) | at
        return self.known[key]


    def is_whole(self, word: str, level: int) -> bool:
        at = {0}
        for c in word:
            at = {e for i in at for e in self.ends(c, level, i)}
        return len(self.text) in at


class Corpus:
    """Words of the corpus as they are counted, in order: those that a lattice with lost bytes has are found without trying its ways one by one."""

    def __init__(self, seen: dict[str, int], chars: Characters) -> None:
        self.seen, self.words, self.chars = seen, sorted(seen), chars

    def fitting(self, reading: _Reading, level: int) -> list[str]:
        """The words that the text can have been before it was misread at most ``level`` times."""
        words, n, found = self.words, len(reading.text), []
        open_ = [(0, len(words), 0, frozenset(((0, ""),)))]
        while open_:
            # the words from lo to hi begin alike, and with t characters can reach these places (with characters still to come)
            lo, hi, t, places = open_.pop()
            if len(words[lo]) == t if lo < hi else False:
                if (n, "") in places:
                    found.append(words[lo])
                lo += 1
            while lo < hi:
                c = words[lo][t]
                end = bisect_right(words, c, lo, hi, key=lambda w: w[t])  # noqa: B023
                then = set()
                for i, rest in places:
                    if rest:
                        then |= {(i, rest[1:])} if rest[0] == c else set()
                    else:
                        then |= {(e, more) for x, more in self.chars.as_counted.get(c, ()) for e in reading.ends(x, level, i)}
                if then:
                    open_.append((lo, end, t + 1, frozenset(then)))
                lo = end
        return found

    def texts(self, reading: _Reading, level: int, word: str) -> list[str]:
        """The ways to read the text as a word of the corpus."""
        text = reading.text

        def edges(i: int, t: int) -> Iterator[tuple[int, int, str, bool]]:
            for c, more in self.chars.as_counted.get(word[t : t + 1], ()):
                if word.startswith(more, t + 1):
                    for e in reading.ends(c, level, i):
                        yield e, t + 1 + len(more), c, e != i + 1 or c != text[i]

        return _likeliest(len(text), len(word), edges, self.chars)

    def forms(self, word: str) -> list[str]:
        """A word of the corpus with capitals or without: of each shape the likeliest."""
        edges = lambda i, _: ((i + 1 + len(more), i + 1 + len(more), c, True) for c, more in self.chars.as_counted.get(word[i], ()) if word.startswith(more, i + 1))
        return _likeliest(len(word), len(word), edges, self.chars)

    def ways(self, word: str) -> list[tuple[str, str, float]]:
        """``(channel, restored word, log-odds by its characters)``: for each channel the best of the words of the corpus."""
        plain, own = html.unescape(word) if _ENTITY.search(word) else word, None
        own = core(plain)
        head, tail = plain.partition(own)[::2] if own else (plain, "")
        longest = max((len(x) for x in _BEYOND.findall(own)), default=0)
        # where all is lost nothing says that it was misread more than once
        deepest = min(LEVELS if set(own) - {LOST, *map(chr, range(128))} else 1, longest - 1)
        free: dict[str, tuple[float, str] | None] = {}
        known: dict[tuple, tuple[list[str], str | None, float]] = {}
        out = []

        def weighed(w: str, forms: list[str]) -> tuple[float, str] | None:
            texts = [head + x + tail for x in forms]
            return max(((g, x) for x in texts if probe(x) == w and (g := _gain(word, plain, x, self.chars)) is not None), default=None)

        def best_of(reading: _Reading, level: int, words: list[str]) -> tuple[str | None, float]:
            most = []
            for w in words:
                if w not in free:
                    free[w] = weighed(w, self.forms(w)) if w != probe(plain) else None
                most.append((math.log(self.seen[w] + 0.5) + free[w][0] if free[w] else math.inf, w))
            best = (-math.inf, None, 0.0)
            for limit, w in sorted(most, reverse=True):
                # no form of this word or the next ones can have more
                if limit <= best[0]:
                    break
                got = free[w]
                if not got or not reading.is_whole(got[1][len(head) : len(got[1]) - len(tail)], level):
                    got = weighed(w, self.texts(reading, level, w))
                if got and (value := math.log(self.seen[w] + 0.5) + got[0]) > best[0]:
                    best = (value, got[1], got[0])
            return best[1:]

        for reader in SINGLE:
            met: set[str] = set()
            reading, to_byte = _Reading(own, reader), _tables(reader)[0]
            # a character misread so often takes one more at least
            for level in range(1, deepest + 1):
                # once misread, a text is what its bytes are, whoever read them
                same = (tuple(-2 if c == LOST else to_byte.get(c, c) for c in own), *((reader, level) if level > 1 else ()))
                if same not in known:
                    words = [w for w in self.fitting(reading, level) if w not in met]
                    known[same] = (words, *best_of(reading, level, words))
                words, text, gain = known[same]
                met.update(words)
                if text is not None:
                    out.append((f"utf8<{reader}^{level}", text, gain))
        return out


def core(word: str) -> str:
    """A word without the ASCII signs and digits around it."""
    return word.strip(_ENDS)


def probe(word: str) -> str:
    """The form under which a word is counted: its core in small letters, with all digits alike."""
    return _DIGITS.sub("0", core(word).lower())


def _scripts(word: str) -> set[str]:
    return {"c" if "Ѐ" <= c <= "ԯ" else "g" if "Ͱ" <= c <= "Ͽ" else "l" for c in word if c.isalpha() and (c < "԰")}


def _odd(word: str) -> bool:
    """Whether a word is of no ordinary shape.

    That is: a part is neither small, nor capital, nor capitalised, or signs,
    numbers or letters of Latin script beyond ASCII lie amid letters or at digits.
    """
    if any(not (p.islower() or p.isupper() or (p[:1].isupper() and p[1:].islower())) for p in re.findall(r"[^\W\d_]+", word) if p.lower() != p.upper()):
        return True
    if any(ord(c) > 127 and unicodedata.category(c)[0] in "SN" and b.isalpha() and d.isalpha() for b, c, d in zip(word, word[1:], word[2:])):
        return True
    return any("0" <= x <= "9" and "\x80" <= y < "Ͱ" and y.isalpha() for b, c in zip(word, word[1:]) for x, y in ((b, c), (c, b)))


def hypotheses(word: str, chars: Characters) -> list[tuple[str, str, float]]:
    """``(channel, restored word, log-odds by its characters)`` for each channel that can have given the word."""
    plain = html.unescape(word) if _ENTITY.search(word) else word
    out: dict[str, str] = {}
    more: list[tuple[str, str]] = []
    known: dict[tuple, tuple[float, str] | None] = {}
    mixed = _most_scripts(plain)
    for reader in SINGLE:
        text = plain
        for level in range(1, LEVELS + 1):
            if LOST in text:
                # readers under whom the bytes are the same give the same
                runs = (text, *_runs(text, reader))
                if runs not in known:
                    every = [(x, _gain(word, plain, x, chars)) for x in ways_utf8(text, reader, chars, mixed)]
                    known[runs] = max(((g, x) for x, g in every if g is not None), default=None)
                more += [(f"utf8<{reader}^{level}", known[runs][1])] if known[runs] else []
            fresh = undo_utf8(text, reader, chars)
            if fresh == text:
                break
            text = fresh
            out[f"utf8<{reader}^{level}"] = text
    if "Ã" in plain:
        for name, c in zip(("shy", "nbsp"), STRIPPED):
            whole = _BARE.sub("Ã" + c, plain)
            if whole != plain:
                out[f"utf8<cp1252-{name}"] = undo_utf8(whole, "cp1252", chars)
    high = {c for c in plain if ord(c) > 127}
    if high and LOST not in high:
        raw_by: dict[str, bytes | None] = {}
        for writer, reader in PAIRS:
            to_byte, to_char = _tables(reader)[0], _tables(writer)[1]
            if all(c in to_byte and to_byte[c] in to_char for c in high):
                out[f"{writer}<{reader}"] = plain.translate({ord(c): to_char[to_byte[c]] for c in high})
        for reader in WESTERN:
            to_byte = _tables(reader)[0]
            raw_by[reader] = b"".join(bytes([to_byte[c]]) if ord(c) > 127 else c.encode() for c in plain) if all(c in to_byte for c in high) else None
        for writer in MULTI:
            for reader, raw in raw_by.items():
                try:
                    if raw is not None:
                        out[f"{writer}<{reader}"] = raw.decode(writer)
                except UnicodeDecodeError:
                    pass
        for reader in MULTI:
            try:
                out[f"utf8<{reader}"] = plain.encode(reader).decode()
            except UnicodeError:
                pass
    found: dict[tuple[str, bool], tuple[str, float]] = {}
    places = {channel: rank for rank, channel in enumerate(out)}
    for i, (channel, text) in enumerate([*out.items(), *more]):
        gain = _gain(word, plain, text, chars)
        if gain is not None:
            gain += RANK * places.get(channel, len(places))
            # of several shapes the best
            at = (channel, i < len(out))
            if (gain >= UNLIKELY or LOST in word) and (at not in found or gain > found[at][1]):
                found[at] = (text, gain)
    return [(channel, text, gain) for (channel, _), (text, gain) in found.items()]


def _most_scripts(plain: str) -> int:
    """Of how many scripts a restored word can be."""
    return 1 if len(_scripts(plain)) < 2 else 3


def _gain(word: str, plain: str, text: str, chars: Characters) -> float | None:
    """The log-odds by characters, shape and script that ``text`` is what ``word`` was; None if it can't be."""
    if text in (plain, word) or any(unicodedata.category(c) in NO_TEXT for c in text):
        return None
    scripts, now = _scripts(plain), _scripts(text)
    if len(now) > _most_scripts(plain):
        return None
    gain = chars.of(text) - chars.of(word) + SHAPE * (_odd(word) - _odd(text))
    # a script that the word does not seem to have, or all of its own given up; signs are of no script
    short = sum(c.isalpha() for c in text) < 3
    if short and now == scripts == {"c"}:
        gain += OTHER_CYRILLIC
    if now - scripts - {"l"} or (scripts and "l" not in scripts and not now & scripts):
        gain += OTHER_SCRIPT if short else OTHER_SCRIPT_LONG
    return gain


def _lost_skeleton(word: str, utf8: bool) -> str:
    """The word with each character beyond ASCII lost, as one byte or as those of UTF-8."""
    return "".join(c if ord(c) < 128 else LOST * (len(c.encode("utf-8", "replace")) if utf8 else 1) for c in word)


_HYPOTHESES = "word string, n bigint, core string, channel string, restored string, gain double, probe string, exact boolean"
#: Marks the words that have lost bytes at some level.
OPEN = "open"
_INDEX = "probe string, form string, n bigint"


def _expand(cast: Broadcast) -> object:
    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars = Characters(cast.value)
        names = [x.split()[0] for x in _HYPOTHESES.split(", ")]
        for f in frames:
            rows = []
            for word, n in zip(f["word"], f["n"]):
                own = core(word)
                found = hypotheses(word, chars)
                for channel, text, gain in found:
                    rows.append((word, n, probe(word), channel, text, gain, "w:" + probe(text), False))
                if LOST in html.unescape(word) or any(LOST in text for _, text, _ in found):
                    rows.append((word, n, probe(word), OPEN, None, 0.0, None, False))
                if LOST in word:
                    for kind, mark in (("lost", "s:"), ("lost-utf8", "u:")):
                        rows.append((word, n, probe(word), kind, None, 20.0, mark + own, True))
                elif _ASKED.search(own):
                    rows.append((word, n, probe(word), "lost", None, QUESTION, "s:" + _ASKED.sub(LOST, own), True))
            yield pd.DataFrame(rows, columns=names).astype({"n": "int64", "gain": "float64", "exact": "bool"})

    return expand


def _fit(cast: Broadcast) -> object:
    def fit(words: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        held = Corpus(dict(zip(corpus["core"], corpus["own_n"])), Characters(cast.value))
        rows = []
        for word, n in zip(words["word"], words["n"]) if len(corpus) else ():
            for channel, text, gain in held.ways(word):
                rows.append((word, n, probe(word), channel, text, gain + RANK * SINGLE.index(channel[5:].partition("^")[0]), "w:" + probe(text), False))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _HYPOTHESES.split(", ")]).astype({"n": "int64", "gain": "float64", "exact": "bool"})

    return fit


def _in_corpus(open_words: DataFrame, own: DataFrame, cast: Broadcast) -> DataFrame:
    """Rows of ``_HYPOTHESES`` for words with lost bytes: each against all words of the corpus, in as many parts of both as tasks can hold."""
    splits, parts = (max(1, -(-d.count() // most)) for d, most in ((open_words, FORMS // 10), (own, HELD)))
    some = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    words = open_words.select("word", "n", some("word", splits).alias("split")).withColumn("part", every(parts))
    corpus = own.select("core", "own_n", some("core", parts).alias("part")).withColumn("split", every(splits))
    # a number of partitions that is given is kept, however few bytes they have
    words, corpus = (d.repartition(min(MOST_TASKS, splits * parts), "split", "part") for d in (words, corpus))
    return words.groupBy("split", "part").cogroup(corpus.groupBy("split", "part")).applyInPandas(_fit(cast), _HYPOTHESES)


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Under which probes a word of the corpus is looked for."""
    for f in frames:
        rows = []
        for word, n in zip(f["word"], f["n"]):
            own = core(word)
            rows.append(("w:" + probe(word), own, n))
            if LOST not in word and own and not any(0x80 <= ord(c) < 0xA0 for c in own):
                rows += [("s:" + _lost_skeleton(own, False), own, n), ("u:" + _lost_skeleton(own, True), own, n)]
        yield pd.DataFrame(rows, columns=["probe", "form", "n"]).astype({"n": "int64"})


def is_odd(word: Column) -> Column:
    """Whether a word matches ODD; patterns are tried only on words that have their signs."""
    entity, asked = ODD.split("|")[1:]
    return (F.octet_length(word) != F.char_length(word)) | (word.contains("&") & word.rlike(entity)) | (word.contains("?") & word.rlike(asked))


def odd_words(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id, pos, word``: the words that can be damaged, and their places."""
    cut = F.posexplode(F.split(F.col(text), "[ \t\r\n]+", -1)).alias("pos", "word")
    return docs.where(f"`{id}` is not null and `{text}` is not null").select(F.col(id).alias("id"), cut).where(is_odd(F.col("word")))


def distinct_words(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``word``: the words that can be damaged, those of each distinct text once.

    Frequencies are taken from these: copies of a damaged text would make its
    damage look usual. Of a text only its hash and these words are shuffled.
    """
    some = docs.where(f"`{id}` is not null and `{text}` is not null").where(is_odd(F.col(text)))
    odd = F.filter(F.split(F.col(text), "[ \t\r\n]+", -1), is_odd)
    once = some.select(F.sha2(F.col(text), 256).alias("hash"), odd.alias("odd")).groupBy("hash").agg(F.first("odd").alias("odd"))
    return once.select(F.explode("odd").alias("word"))


def suspects(words: DataFrame) -> DataFrame:
    """``word, core, channel, restored, exact, odds, own_n``: the words that may be damaged, with a row for each way.

    ``core`` is the form that ``own_n`` counts. ``words`` has a row per occurrence that counts: see :func:`distinct_words`.
    """
    spark = words.sparkSession
    forms = stored(words.groupBy("word").agg(F.count("*").alias("n")))
    counts = forms.select(F.explode(F.split("word", "")).alias("c"), "n").where("c <> ''").groupBy("c").agg(F.sum("n").alias("n"))
    # one row per character there is, of which Unicode has a fixed number
    cast = spark.sparkContext.broadcast({r.c: r.n for r in counts.collect()})
    # a thousand forms are a task's worth, however few files they lie in
    spread = forms.repartition(max(1, min(MOST_TASKS, forms.count() // FORMS)))
    ways = stored(spread.mapInPandas(_expand(cast), _HYPOTHESES))
    index = forms.mapInPandas(_index, _INDEX).groupBy("probe").agg(F.sum("n").alias("seen"), F.max(F.struct("n", "form")).alias("top"))
    index = stored(index.select("probe", "seen", F.col("top.form").alias("form"), F.col("top.n").alias("top_n")))
    own = index.where("probe like 'w:%'").select(F.expr("substr(probe, 3)").alias("core"), F.col("seen").alias("own_n"))
    open_words = ways.where(F.col("channel") == OPEN).select("word", "n")
    ways = ways.where(F.col("channel") != OPEN)
    if not open_words.isEmpty():
        ways = ways.unionByName(stored(_in_corpus(open_words, own, cast)))
    met = ways.join(index, "probe", "left").join(own, "core", "left")
    half = F.lit(0.5)
    weigh = F.log((F.coalesce(F.col("seen"), F.lit(0)) + half) / (F.coalesce(F.col("own_n"), F.lit(0)) + half))
    # a lost byte is damage for certain: what it says is only which form is likeliest
    odds = F.when(F.col("exact"), F.log(F.coalesce("top_n", F.lit(0)) + half)).otherwise(weigh) + F.col("gain")
    scored = met.select("word", "core", "channel", F.coalesce("restored", F.when(F.col("exact"), F.col("form"))).alias("restored"), "exact", odds.alias("odds"), F.coalesce("own_n", F.lit(0)).alias("own_n"))
    scored = scored.where(f"odds > {LEAST_ODDS - MOST_SHIFT} and restored is not null")
    lost = forms.where(F.col("word").rlike(r"[\x{FFFD}\x{80}-\x{9F}]")).select(
        "word", F.lit(None).cast("string").alias("core"), F.lit("unknown").alias("channel"), F.lit(None).cast("string").alias("restored"), F.lit(True).alias("exact"), F.lit(9.0).alias("odds"), F.lit(0).cast("bigint").alias("own_n"),
    )
    return stored(scored.unionByName(lost))


def _ways(scored: DataFrame) -> DataFrame:
    """``word, ways`` of the ways that are not too unlikely."""
    return scored.where(f"odds > {LEAST_ODDS}").groupBy("word").agg(F.collect_list(F.struct("channel", "restored", "exact", "odds")).alias("ways"))


def second_look(scored: DataFrame, found: DataFrame) -> DataFrame:
    """``scored`` for words of which a first search found many occurrences damaged: these do not show that the word is usual, nor does the one looked at.

    Copies of a text count once here too: they have the same words at the same places.
    """
    once = found.select("places", "cores").distinct()
    bad = once.select(F.explode("cores").alias("core")).groupBy("core").agg(F.count("*").alias("bad"))
    shift = F.log((F.col("own_n") + 0.5) / (F.greatest(F.col("own_n") - F.col("bad") - 1, F.lit(0)) + 0.5))
    again = scored.join(bad, "core").where("not exact").withColumn("shift", F.least(shift, F.lit(MOST_SHIFT))).where(f"shift >= {LEAST_SHIFT}")
    return again.select(*[(F.col("odds") + F.col("shift")).alias("odds") if c == "odds" else F.col(c) for c in scored.columns])


def _enter(channel: str) -> float:
    return ENTER_UTF8 if channel.startswith("utf8") or channel in ("lost", "lost-utf8", "unknown") else ENTER


def decode_words(ways: list[list[tuple[str, str | None, bool, float]]]) -> list[tuple[str, str | None, bool] | None]:
    """For each word in turn its channel, restored form and whether that stands for the word's core only; None where it is undamaged.

    Viterbi search with the channels as states. ``ways`` lists for each word
    (channel, restored, exact, log-odds against its being undamaged).
    """
    states: dict[str, float] = {"": 0.0}
    back: list[dict[str, str]] = []
    at: list[dict[str, tuple[str | None, bool, float]]] = []
    for options in ways:
        own: dict[str, tuple[str | None, bool, float]] = {}
        for channel, text, exact, odds in options:
            if channel not in own or odds > own[channel][2]:
                own[channel] = (text, exact, odds)
        fresh, came = {}, {}
        best = max(states, key=lambda s: states[s] + (LEAVE if s else 0))
        for s in {"", *own}:
            into = {best: states[best] + (_enter(s) if s and s != best else LEAVE if best and not s else STAY if s else 0.0)}
            if s in states:
                into[s] = max(into.get(s, -math.inf), states[s] + (STAY if s else 0.0))
            clean = states.get("")
            if clean is not None and s:
                into[""] = max(into.get("", -math.inf), clean + _enter(s))
            where = max(into, key=into.get)
            fresh[s], came[s] = into[where] + (own[s][2] if s else 0.0), where
        # a channel goes on over a word that it cannot have damaged
        for s in states:
            if s and s not in own:
                fresh[s], came[s] = states[s] + STAY * 4, s
        states = fresh
        back.append(came)
        at.append(own)
    s, out = max(states, key=states.get), []
    for i in range(len(ways) - 1, -1, -1):
        hit = at[i].get(s)
        out.append((s, hit[0], hit[1]) if s and hit else None)
        s = back[i][s]
    return out[::-1]


def _rebuilt(word: str, hit: tuple[str, str | None, bool]) -> str | None:
    channel, text, exact = hit
    if text is None:
        return None
    return word.replace(core(word), text, 1) if exact else text


_FOUND = "id bigint, damaged int, unrecovered int, channels string, places array<int>, forms array<string>, cores array<string>"


def _decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for id, hits in zip(f["id"], f["hits"]):
            words = [h["word"] for h in hits]
            decided = decode_words([[(w["channel"], w["restored"], bool(w["exact"]), float(w["odds"])) for w in h["ways"]] for h in hits])
            got = [(int(h["pos"]), _rebuilt(w, d), d[0]) for h, w, d in zip(hits, words, decided) if d]
            cores = [probe(w) for w, d in zip(words, decided) if d and not d[2]]
            if got:
                open_ = sum(t is None or LOST in t for _, t, _ in got)
                rows.append((id, len(got), open_, ",".join(sorted({c for _, _, c in got})), [p for p, _, _ in got], [t for _, t, _ in got], cores))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FOUND.split(", ")])


def damaged(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """``id, damaged, unrecovered, channels, places, forms``: the documents with damaged words, and what these were.

    Null ids and texts give no row, nor do texts without damage; an empty table
    gives none. A repeated id is decoded as if its texts followed each other;
    ids are expected to be unique. Words are joined with their decodings under
    a salt, as a few odd words (dashes, currency signs) are in very many texts.
    """
    words = stored(odd_words(docs, id, text).withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(salts)).cast("int")))
    scored = suspects(distinct_words(docs, id, text))

    def decoded(words: DataFrame, ways: DataFrame) -> DataFrame:
        # written, so that its size with all salts is what the planner goes by
        met = words.join(stored(ways.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))), ["word", "salt"])
        hits = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "ways"))).alias("hits"))
        return hits.mapInPandas(_decide, _FOUND)

    found = stored(decoded(words, _ways(scored)))
    raised = stored(second_look(scored, found))
    if raised.isEmpty():
        return found.drop("cores")
    # only documents with such a word are searched again
    changed = raised.select("word").distinct()
    ids = words.join(changed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["word", "salt"], "left_semi").select("id").distinct()
    unlike = scored.join(raised.select("word", "channel", "restored"), ["word", "channel", "restored"], "left_anti")
    more = decoded(words.join(ids, "id", "left_semi"), _ways(unlike.select(*raised.columns).unionByName(raised)))
    return found.join(ids, "id", "left_anti").unionByName(more).drop("cores")


def restored(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, damaged, unrecovered, channels, restored``: the damaged documents with their text as far as it can be restored.

    Words that cannot be restored stay as they are and are counted in ``unrecovered``.
    """

    def rebuild(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t, places, forms in zip(f["t"], f["places"], f["forms"]):
                parts = re.split("([ \t\r\n]+)", t)
                for p, form in zip(places, forms):
                    if form is not None:
                        parts[2 * p] = form
                out.append("".join(parts))
            yield pd.DataFrame({id: f["id"], "damaged": f["damaged"], "unrecovered": f["unrecovered"], "channels": f["channels"], "restored": out})

    both = found.join(docs.select(F.col(id).alias("id"), F.col(text).alias("t")), "id")
    return both.mapInPandas(rebuild, f"`{id}` bigint, damaged int, unrecovered int, channels string, restored string")
