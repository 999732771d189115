"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A file of token ranks; it must lie at this path on every machine.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which the vocabulary was made.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of such length is split off by another engine: the tokenizer's own overflows its stack there.
LONG_SPACE = 5000


@lru_cache(maxsize=4)
def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, read once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str], path: str = RANKS) -> list[int]:
    """The number of tokens of each text; text that looks like a special token is ordinary."""
    own = encoder(path)
    long = re.compile(r"\s{%d}" % LONG_SPACE)
    # a lone surrogate has no UTF-8 form
    texts = [t.encode("utf-8", "replace").decode("utf-8") for t in texts]
    plain = [i for i, t in enumerate(texts) if not long.search(t)]
    sizes = dict(zip(plain, map(len, own.encode_ordinary_batch([texts[i] for i in plain], num_threads=1)), strict=True))
    if len(plain) < len(texts):
        import regex

        pieces = regex.compile(PATTERN)
        for i, t in enumerate(texts):
            if i not in sizes:
                sizes[i] = sum(len(own._encode_single_piece(p)) for p in pieces.findall(t))
    return [sizes[i] for i in range(len(texts))]


def n_tokens(text: Column | str, path: str = RANKS) -> Column:
    """The number of tokens of a text column; 0 for null."""

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(count_tokens(s.fillna("").tolist(), path), dtype="int64")

    return counted(F.col(text) if isinstance(text, str) else text)
