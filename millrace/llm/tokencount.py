"""Token counts with a whole-token shortcut.

The vocabulary is examined once, offline: a string that the library itself
encodes as exactly one token, at the start of a text and after other text, is a
*whole token*. A text is cut into pre-tokens (a run of word-boundary marks and
what follows, up to the next mark). No vocabulary piece holds a mark after
another character, so merges never cross these cuts, and a text's count is the
sum over its pre-tokens. Those that are whole tokens count one without any
merging; only the others go through the library.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import claim

#: Pre-tokens whose counts a worker keeps, and their greatest length.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64
_MARK = "▁"


@functools.lru_cache(maxsize=2)
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens that provably encode as one token.

    The model adds one mark before a text, so a piece "mark + x" is tried as the
    text ``x``. A single remaining token proves the string, as a pre-token's
    encoding does not depend on what stands around it.
    """
    sp = load(path)
    pieces = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if p[0] == _MARK and len(p) > 1 and _MARK not in p[1:]]
    plain = [p[1:] for p in pieces]
    lone = [_MARK] if len(sp.encode("x ")) == len(sp.encode("x")) + 1 else []  # a mark at a text's end
    return frozenset([*lone, *(p for p, ids in zip(pieces, sp.encode(plain), strict=True) if len(ids) == 1)])


def check_model(path: str) -> None:
    """Raise unless the model has the properties that the shortcut rests on."""
    sp = load(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    crossing = [p for p in pieces if _MARK in p.lstrip(_MARK)]
    if crossing or _MARK not in whole_tokens(path) or sp.encode("a  b", out_type=str) != [*sp.encode("a", out_type=str), *sp.encode(" b", out_type=str)]:
        raise ValueError(f"{path}: pieces cross word boundaries or the text is normalised; the shortcut is not exact")


class _Counts(dict):
    """Counts by pre-token; misses are merged by the library."""

    def __init__(self, path: str):
        super().__init__(dict.fromkeys(whole_tokens(path), 1))
        self.path, self.base = path, len(self)

    def __missing__(self, piece: str) -> int:
        # The library adds the first mark by itself, so one is taken off.
        n = len(load(self.path).encode(piece[1:].replace(_MARK, " ")))
        if len(piece) <= CACHE_CHARS:
            if len(self) - self.base >= CACHE_ENTRIES:
                kept = whole_tokens(self.path)
                self.clear()
                self.update(dict.fromkeys(kept, 1))
            self[piece] = n
        return n


@functools.lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(path)


_PRE = re.compile(f"{_MARK}+[^{_MARK}]*")


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of one text, as the library gives them; 0 for null and empty."""
    if not text:
        return 0
    # The library takes NUL and malformed input its own way; such texts go to it whole.
    if "\0" in text:
        return len(load(path).encode(text))
    marked = _MARK + text.replace(" ", _MARK)
    return sum(map(_counts(path).__getitem__, _PRE.findall(marked)))


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted one
    by one. Other columns are ignored. No row leaves its partition: there is no
    shuffle, and a lost task is simply run again.
    """
    check_model(model_path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim(_counts.cache_clear)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "n_bytes": b["n_bytes"], "n_tokens": [count_tokens(t, model_path) for t in b["text"]]})

    src = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Ids go as strings: pandas would turn a number column with nulls into floats.
    out = src.mapInPandas(count, "id string, n_bytes long, n_tokens long")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
