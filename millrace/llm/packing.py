"""Sum-of-squares online packing of documents into windows of one length.

Each task packs the documents of its partition as they come. N[h], the level
array, holds how many open windows are filled up to h. A document of s tokens
goes to the open window, or a new one, for which the sum of the squared N[h]
afterwards is least (Csirik and others). Documents of a window's length and more
first give whole windows; the rest is placed. When a partition ends, its open
windows are closed up: the emptiest ones' pieces are cut to fill the fullest
ones' gaps, so that one window at most is left short.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import claim

WINDOW = 2048
#: Chunks whose ids a worker keeps (about 170 MB), and their greatest length.
CACHE_ENTRIES, CACHE_CHARS = 700_000, 48
#: Open windows that a task holds; with more it closes them up. This bounds its memory.
MAX_OPEN = 8192
#: Sequences of one task are numbered within this many.
TASK_IDS = 1 << 36

# What stands between white space that the tokenizer drops and that Python and the
# library agree on. A plain word is cut from the punctuation after it, where a
# pre-token ends in any case; that leaves fewer distinct chunks.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_CHUNK = re.compile(f"[{_LETTERS}]+(?=[,.;:!?])|[^ \t\n\r]+")
_PLAIN = re.compile(f"[{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()


class _Ids(dict):
    """Ids of chunks, as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, chunk: str) -> bytes:
        """A chunk of plain letters is one pre-token: its lower-cased bytes go straight
        to the library's merges. Any other goes through the library as a whole."""
        if _PLAIN.fullmatch(chunk):
            low = chunk.lower()
            mapped = low if low.isascii() else "".join(map(_BYTES.__getitem__, low.encode()))
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids


def _lowered(text: str) -> str:
    """A-Z lower-cased, as the tokenizer does anyway; not near special strings, which it looks for first."""
    return text if "<|" in text else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def encode(text: str | None, path: str) -> bytes:
    """The tokenizer's ids of a text, without added ones, as little-endian 32-bit bytes.

    It drops white space and no pre-token spans it, so what stands between white
    space is encoded piece by piece.
    """
    return b"".join(map(_ids(path).__getitem__, _CHUNK.findall(_lowered(text)))) if text else b""


class SumOfSquares:
    """Online packing of lengths into windows; keeps the open windows by level."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[deque[int]] = [deque() for _ in range(window)]
        self.fill: dict[int, int] = {}  # level of each open window
        self.next = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for an item of 1 to ``window`` tokens."""
        w = self.window
        # The sum changes by 1 - 2 N[h] for the level left (none for a new window)
        # and by 1 + 2 N[h + size] for the level reached (none for a full window).
        reached = 1 + 2 * self.count[size : w + 1]
        reached[-1] = 0
        left = 1 - 2 * self.count[: w - size + 1]
        left[0] = 0
        change = reached + left
        change[1:][self.count[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        level = w - size - int(np.argmin(change[::-1]))  # of equals the fullest
        if level:
            at = self.open[level].popleft()
            self.count[level] -= 1
        else:
            at, self.next = self.next, self.next + 1
        if level + size < w:
            self.open[level + size].append(at)
            self.count[level + size] += 1
            self.fill[at] = level + size
        else:
            self.fill.pop(at, None)
        return at, level

    def clear(self) -> None:
        """Forget the open windows."""
        self.count[:] = 0
        self.fill.clear()
        for level in self.open:
            level.clear()

    def whole(self) -> int:
        """A new full window."""
        self.next += 1
        return self.next - 1


def close_up(pieces: list[tuple], fill: dict[int, int], window: int = WINDOW) -> list[tuple]:
    """Cut the emptiest windows' pieces into the gaps of the fullest.

    ``pieces`` are (document, start, length, window, offset) of the open windows.
    """
    order = sorted(fill, key=lambda k: (fill[k], k))
    by: dict[int, list[tuple]] = {}
    for p in pieces:
        by.setdefault(p[3], []).append(p)
    level = dict(fill)
    i, j, done = 0, len(order) - 1, []
    while i < j:
        if not by[order[i]]:
            i += 1
            continue
        if level[order[j]] >= window:
            j -= 1
            continue
        doc, start, length, _, offset = by[order[i]].pop()
        take = min(length, window - level[order[j]])
        done.append((doc, start + length - take, take, order[j], level[order[j]]))
        level[order[j]] += take
        if take < length:
            by[order[i]].append((doc, start, length - take, order[i], offset))
    return done + [p for k in order for p in by[k]]


def pack_lengths(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) for documents in order."""
    packer, pieces = SumOfSquares(window), []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= window:
            pieces.append((doc, start, window, packer.whole(), 0))
            start += window
        if n > start:
            at, offset = packer.place(n - start)
            pieces.append((doc, start, n - start, at, offset))
    shut = [p for p in pieces if p[3] not in packer.fill]
    return shut + close_up([p for p in pieces if p[3] in packer.fill], packer.fill, window)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the single end id. Repeated rows are documents of
    their own. Other columns are ignored. A task packs its own partition, as its
    rows come, and holds their ids' checksums and the open windows only: nothing
    is shuffled, and a lost task's sequences are made again as a whole.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim(_ids.cache_clear)
        base = TaskContext.get().partitionId() * TASK_IDS
        packer = SumOfSquares(window)
        held: dict[int, list[tuple]] = {}  # pieces of open windows with their ids

        def row(piece: tuple, ids: bytes) -> tuple:
            (doc, total), start, length, at, offset = piece
            return doc, start, length, zlib.crc32(ids), total, base + at, offset

        def shut() -> list[tuple]:
            """Close up the open windows."""
            whole, pieces, out = [], [], []
            for (doc, start, length, at, offset), ids in (x for xs in held.values() for x in xs):
                pieces.append((len(whole), start, length, at, offset))
                whole.append((doc, start, ids))
            for i, start, length, at, offset in close_up(pieces, packer.fill, window):
                doc, first, ids = whole[i]
                out.append(row((doc, start, length, at, offset), ids[4 * (start - first) : 4 * (start - first + length)]))
            held.clear()
            packer.clear()
            return out

        for b in batches:
            out = []
            for doc, text in zip(b["id"], b["text"], strict=True):
                ids = encode(text, tokenizer_path) + end
                n, start = len(ids) // 4, 0
                doc = (doc, n)
                while n - start >= window:
                    out.append(row((doc, start, window, packer.whole(), 0), ids[4 * start : 4 * (start + window)]))
                    start += window
                if n > start:
                    at, offset = packer.place(n - start)
                    held.setdefault(at, []).append(((doc, start, n - start, at, offset), ids[4 * start :]))
                    if at not in packer.fill:
                        out += [row(*x) for x in held.pop(at)]
                    elif len(held) > MAX_OPEN:
                        out += shut()
            yield pd.DataFrame(out, columns=_COLUMNS)
        yield pd.DataFrame(shut(), columns=_COLUMNS)

    src = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = src.mapInPandas(packed, "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    # Ids went as strings: pandas would turn a number column with nulls into floats.
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *_COLUMNS[1:])


_COLUMNS = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
