"""Near-duplicates by the Jaccard similarity of shingle sets, found by MinHash bands.

Each distinct set gets ``BANDS`` keys of ``BAND_ROWS`` minima; sets that share a key
are compared by their true similarity. A pair at similarity s shares a key with
probability 1 - (1 - s^5)^16: 0.998 at 0.8, more above. Classes of rows that another
method holds alike (SimHash) may be given; they are one more band.

There are two rounds. The first takes a few bands and deals keys with more than
``GROUP`` sets at random into groups of about that size: many near copies of one
text are united through those they meet, with work that grows with the rows. The
second leaves no pair out: in every band, sets of one key that are not united yet
are compared, those outside the key's most frequent component with all of the key,
block against block. It first compares what little a pair needs to be ruled out
(its earlier bands, sizes and sketches), and sends whole sets only for the rest. A
pair that is similar but ruled out by its sketches has a probability below 0.0001.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import claim, materialize, scratch
from .components import connected_components
from .hnsw import _merge

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 16, 5
#: Bands of the first round, and sets of a group there that are compared pair by pair.
FIRST_BANDS, GROUP = 2, 128
#: Sets of a block in the second round.
BLOCK = 256
#: Of its minima (a byte each) a similar pair's sketches have as many in common at least:
#: 4 standard deviations below what is expected.
MISSES = 4.0
#: Tables of up to this many rows of two dozen bytes are broadcast.
BROADCAST_ROWS = 1_000_000

_random = np.random.default_rng(20)
_TIMES = _random.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of words, A-Z lower-cased; none without words.

    With fewer words than a shingle, the whole sequence is the only one.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(flat, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashed = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.array([hashed(flat[a:b], 42) for a, b in pairs], np.uint64))


def band_keys(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """A signed key for each band, and a byte of each minimum; nothing for an empty set."""
    import xxhash

    if not len(hashes):
        return [], b""
    least = np.full(len(_TIMES), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 512):  # fits the cache
        least = np.minimum(least, (np.multiply.outer(_TIMES, hashes[i : i + 512]) + _PLUS[:, None]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(b.tobytes()) for b in least.reshape(BANDS, BAND_ROWS)]
    return np.array(keys, np.uint64).astype(np.int64).tolist(), (least >> np.uint64(24)).astype(np.uint8).tobytes()


def shingle_sets(docs: DataFrame, row_col: str, *, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(row, same, keys, sketch, n, hashes): a number that equal sets share, and the set in 32 bits a shingle."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        claim()
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                sets = [shingle_hashes(t.encode("utf-8", "surrogatepass") if t else b"", shingle) for t in part["text"]]
                same = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).astype(np.int64)
                small = [(s & np.uint64(2**32 - 1)).astype(np.uint32).tobytes() for s in sets]
                keys, sketches = zip(*map(band_keys, sets), strict=True)
                yield pd.DataFrame({"row": part["row"].to_numpy(), "same": same, "keys": keys, "sketch": sketches, "n": list(map(len, sets)), "hashes": small})

    src = docs.select(F.col(row_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInPandas(hashed, "row long, same long, keys array<long>, sketch binary, n long, hashes binary")


def similar_pairs(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of the sets with at least that Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    at = (np.cumsum(shared) - 1)[column]
    owner, at = owner[shared[column]], at[shared[column]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(shared.sum()), 8192):  # a block of shingles at a time
        lo, hi = np.searchsorted(at, [first, first + 8192])
        has = np.zeros((len(sets), 8192), np.float32)
        has[owner[lo:hi], at[lo:hi] - first] = 1
        both += (has @ has.T).astype(np.int64)
    either = sizes[:, None] + sizes[None, :] - both
    return np.nonzero(np.triu(both >= similarity * either - 1e-9, 1))


def broadcast_if_few(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _compared(sets: DataFrame, groups: DataFrame, similarity: float, most: int) -> DataFrame:
    """Edges (a, b) over ``row`` that join the similar ones of each group ``m`` of rows.

    Several bands often have one and the same group; it is compared once.
    """
    groups = materialize(groups.select("m").distinct().withColumn("g", F.monotonically_increasing_id()), "groups", most)
    listed = materialize(groups.select("g", F.explode("m").alias("row")), "listed", most)
    # Only sets that are in a group are sent; they are written so that a row in many groups can be split.
    needed = materialize(sets.select("row", "hashes").join(broadcast_if_few(materialize(listed.select("row").distinct(), "wanted", most)), "row", "left_semi"), "needed", most)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf["row"].to_numpy(np.int64)
        i, j = similar_pairs([np.frombuffer(h, np.uint32) for h in pdf["hashes"]], similarity)
        label = np.arange(len(rows))
        _merge(label, i, j)
        own = np.flatnonzero(label != np.arange(len(rows)))
        return pd.DataFrame({"a": rows[label[own]], "b": rows[own]})

    return listed.join(needed, "row").groupBy("g").applyInPandas(compared, "a long, b long")


def _tables(sets: DataFrame, bands: int, alike: DataFrame | None) -> DataFrame:
    """``sets`` (row, keys, ...) by band ``t`` and key ``k`` instead of keys; the classes ``alike`` (row, alike) are band BANDS."""
    keys = F.transform(F.slice("keys", 1, bands), lambda k, t: F.struct(t.alias("t"), k.alias("k")))
    if alike is not None:
        sets = sets.join(broadcast_if_few(alike), "row")
        # Empty sets have no keys, and are like no other.
        keys = F.when(F.size("keys") > 0, F.concat(keys, F.array(F.struct(F.lit(BANDS).alias("t"), F.col("alike").alias("k")))))
    others = [c for c in sets.columns if c not in ("keys", "alike")]
    return sets.select(*others, F.explode(keys).alias("x")).select(*others, "x.t", "x.k")


def first_links(sets: DataFrame, distinct: DataFrame, n: int, similarity: float = SIMILARITY, alike: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) among the ``n`` rows of ``distinct`` that the first bands show, not all of them for keys of many sets."""
    most = n * (FIRST_BANDS + (alike is not None))
    tables = _tables(sets.select("row", "keys").join(distinct, "row", "left_semi"), FIRST_BANDS, alike)
    sizes = materialize(tables.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets", most)
    # Written before it is grouped, so that this join's hot partitions can be split.
    members = materialize(tables.join(broadcast_if_few(sizes), ["t", "k"]), "members", most)
    dealt = members.withColumn("part", F.pmod(F.xxhash64("row", "t"), F.ceil(F.col("n") / GROUP)))
    groups = dealt.groupBy("t", "k", "part").agg(F.array_sort(F.collect_list("row")).alias("m")).where("size(m) > 1")
    return _compared(sets, groups, similarity, most)


def possible_pairs(own: pd.DataFrame, others: pd.DataFrame, t: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of pairs from different components that meet in band ``t`` first and may be similar.

    Both have root, n, keys and sketch.
    """
    if not len(own) or not len(others):
        return np.zeros(0, int), np.zeros(0, int)
    least = BANDS * BAND_ROWS * similarity - MISSES * (BANDS * BAND_ROWS * similarity * (1 - similarity)) ** 0.5
    x, y = ({"root": f["root"].to_numpy(np.int64), "n": f["n"].to_numpy(np.int64), "keys": np.stack(f["keys"].to_numpy()), "sketch": np.stack([np.frombuffer(b, np.uint8) for b in f["sketch"]])} for f in (own, others))
    found = []
    for at in range(len(own)):
        near = (y["root"] != x["root"][at]) & (np.minimum(y["n"], x["n"][at]) >= similarity * np.maximum(y["n"], x["n"][at]) - 1e-9)
        near = np.flatnonzero(near)
        near = near[~(y["keys"][near, :t] == x["keys"][at, :t]).any(axis=1)]
        near = near[(y["sketch"][near] == x["sketch"][at]).sum(axis=1) >= least]
        found.append(np.stack([np.full(len(near), at), near]))
    return tuple(np.concatenate(found, axis=1))


def other_links(sets: DataFrame, distinct: DataFrame, n: int, united: DataFrame, similarity: float = SIMILARITY, alike: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that join the similar ones among the ``n`` rows of ``distinct`` that share a band.

    Left out are pairs that have one root in ``united`` (v, root).
    """
    most = n * (BANDS + (alike is not None))
    roots = broadcast_if_few(united).select(F.col("v").alias("row"), "root")
    rooted = sets.select("row", "keys").join(distinct, "row", "left_semi").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    tables = _tables(rooted, BANDS, alike)
    # Of each key, the component with the most sets is home; sets of others meet all of the key.
    counts = tables.groupBy("t", "k", "root").agg(F.count(F.lit(1)).alias("c"))
    open_ = counts.groupBy("t", "k").agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("home"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    # The first round compared all sets of small keys.
    open_ = open_.where(F.col("t").between(FIRST_BANDS, BANDS - 1) | (F.col("size") > GROUP))
    sizes = materialize(open_.select("t", "k", "size", (F.col("size") - F.col("home.c")).alias("away"), F.col("home.root").alias("home")), "buckets", most)
    members = materialize(tables.join(broadcast_if_few(sizes), ["t", "k"]), "members", most)
    blocks = lambda of: F.when(F.col("size") <= BLOCK, 1).otherwise(F.ceil(F.col(of) / BLOCK)).cast("int")
    everyone = members.withColumns({"x": F.explode(F.sequence(F.lit(0), blocks("away") - 1)), "y": F.pmod(F.xxhash64("row"), blocks("size")).cast("int"), "asks": F.lit(False)})
    asking = members.where((F.col("size") > BLOCK) & (F.col("root") != F.col("home")))
    asking = asking.withColumns({"y": F.explode(F.sequence(F.lit(0), blocks("size") - 1)), "x": F.pmod(F.xxhash64("row", F.lit(1)), blocks("away")).cast("int"), "asks": F.lit(True)})
    traits = materialize(sets.join(broadcast_if_few(materialize(members.select("row").distinct(), "open", n)), "row", "left_semi").select("row", "n", "keys", "sketch"), "traits", n)
    cols = ["row", "root", "t", "k", "x", "y", "asks"]
    met = everyone.select(*cols).union(asking.select(*cols)).join(traits, "row")

    def possible(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        whole = not asks.any()  # a key of one block asks itself
        own, others = (pdf, pdf) if whole else (pdf[asks], pdf[~asks])
        i, j = possible_pairs(own, others, int(pdf["t"].iloc[0]), similarity)
        rows = np.union1d(own["row"].to_numpy(np.int64)[i], others["row"].to_numpy(np.int64)[j])
        return pd.DataFrame({"m": pd.Series([rows.tolist()] if len(rows) > 1 else [], dtype=object)})

    groups = met.groupBy("t", "k", "x", "y").applyInPandas(possible, "m array<long>")
    return _compared(sets, groups, similarity, most)


def near_copies(numbered: DataFrame, row_col: str, *, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, alike: DataFrame | None = None) -> DataFrame:
    """(row, root) for every row: rows with one root are near-duplicates, linked one by one.

    Texts without words are all equal. ``row_col`` has a number for each row. Rows of
    one class in ``alike`` (row, alike: long) are candidates like those that share a band.
    """
    with scratch() as keep:
        every = materialize(shingle_sets(numbered, row_col, text_col=text_col, shingle=shingle), "shingles")
        rows = every.count()  # like the other counts, from the files' footers
        same = materialize(every.groupBy("same").agg(F.min("row").alias("first")), "same", rows)
        n = same.count()
        distinct = same.select(F.col("first").alias("row"))
        united = connected_components(first_links(every, distinct, n, similarity, alike), n * (FIRST_BANDS + 1))
        edges = other_links(every, distinct, n, united, similarity, alike).union(united.select(F.col("v").alias("a"), F.col("root").alias("b")))
        united = connected_components(edges, n * (BANDS + 1))
        roots = same.join(united.select(F.col("v").alias("first"), "root"), "first", "left").select("same", F.coalesce("root", "first").alias("root"))
        return keep(materialize(every.select("row", "same").join(materialize(roots, "roots", n), "same").select("row", "root"), "row_roots", rows))
