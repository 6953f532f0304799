"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints within radius r must be found without fail. Every one of the 64 bit
positions gets a nonzero vector of r + 1 bits, dealt out in turn, and there is a
table for every nonzero v of r + 1 bits whose mask keeps the positions with an
odd scalar product with v (Pagh's covering family). The at most r positions in
which a pair differs span at most r dimensions, so some v is orthogonal to them
all: that table's mask hides every difference and the pair collides there. For
r = 2 there are 7 tables with keys of 36 or 37 bits.

Only distinct fingerprints enter the tables. A bucket with few of them has its
pairs compared. In a bucket with more, no pairs are made: each member names
itself and its 64 one-bit neighbours instead, and two of them are within 2 bits
exactly if they name a fingerprint in common. At most 65 fingerprints name any
one, so these groups are bounded by construction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import minhash
from .common import claim, materialize, scratch
from .components import connected_components

RADIUS, BITS = 2, 64
#: Buckets up to this many fingerprints have their pairs compared one by one.
SMALL_BUCKET = 16


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks of the 2^(radius+1) - 1 tables."""
    n = 2 ** (radius + 1) - 1
    vector = [1 + i % n for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of a text in UTF-8, A-Z lower-cased; 0 if it has no words.

    Shingles count as often as they occur. With fewer words than a shingle, the
    whole sequence is the only one. A bit is set if it is in over half the hashes.
    """
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and at space and U+0009..U+000D
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(flat, seed)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashed = xxhash.xxh64_intdigest
        pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.array([hashed(flat[a:b], seed) for a, b in pairs], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], *, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, the fingerprint as a signed 64-bit number."""
    # As strings: pandas would turn a number column with nulls into floats.
    fields = ", ".join(f"`{c}` string" for c in keep)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim()
        for b in batches:
            fp = np.array([simhash(t.encode("utf-8", "surrogatepass") if t else b"", shingle) for t in b.pop("__mr_text")], dtype=np.uint64)
            yield b.assign(__mr_fp=fp.astype(np.int64))

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(*[F.col(f"`{c}`").cast("string") for c in keep], text.alias("__mr_text")).mapInPandas(hashed, f"{fields}, __mr_fp long")
    return out.select(*[F.col(f"`{c}`").cast(docs.schema[c].dataType) for c in keep], F.col("__mr_fp").alias("fp"))


def _bits_apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) that join the ``n`` distinct fingerprints ``fp`` within the radius.

    Two fingerprints at up to 2 differing bits are in one connected component of
    these edges, and every edge lies within a chain of such links.
    """
    masks = [_signed(m) for m in covering_masks()]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
    tables = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")
    # Map-side partial counts bound what a hot bucket sends; sizes first, members after.
    sizes = materialize(tables.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets", n * len(masks))
    # Written before it is grouped, so that this join's hot partitions can be split.
    members = materialize(tables.join(sizes, ["t", "k"]), "members", n * len(masks))
    small = members.where(F.col("n") <= SMALL_BUCKET).groupBy("t", "k").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    pairs = small.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    near = pairs.where(_bits_apart("a", "b") <= RADIUS)
    hot = members.where(F.col("n") > SMALL_BUCKET).select("fp").distinct()
    bits = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(BITS)])
    named = hot.select("fp", F.explode(bits).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("name"))
    # At most 65 fingerprints name one, so the sets are small.
    stars = named.groupBy("name").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1).select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return near.union(stars).distinct()


def _rooted(fps: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``fps`` (fp, ...) with ``root``: the same for all fingerprints that links connect."""
    # A fingerprint has SMALL_BUCKET links a table at most, and those of its star.
    labels = connected_components(links(fps, n), n * (len(covering_masks()) * SMALL_BUCKET + BITS + 1))
    return fps.join(labels.select(F.col("v").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def classes(rows: DataFrame, row_col: str, *, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(row, alike) for every row: one number for rows whose fingerprints links connect. ``row_col`` has a number for each row."""
    with scratch() as keep:
        found = materialize(fingerprints(rows, [row_col], text_col=text_col, shingle=shingle), "fingerprints")
        fps = materialize(found.select("fp").distinct(), "distinct", found.count())
        n = fps.count()
        named = materialize(_rooted(fps, n), "named", n)
        return keep(materialize(found.join(named, "fp").select(F.col(row_col).alias("row"), F.col("root").alias("alike")), "alike", found.count()))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    Rows whose fingerprints differ in 2 bits or fewer are linked; component_id is
    the smallest id reachable, a row's own included. Null and empty texts have
    fingerprint zero and are linked like any other. A null id belongs to its
    component but is never its id, unless no row there has one. Repeated rows stay.
    Other columns are ignored.
    """
    rows = materialize(fingerprints(docs, [id_col], text_col=text_col, shingle=shingle), "fingerprints")
    with scratch() as keep:
        fps = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct", rows.count())
        n = fps.count()  # like the one before, from the files' footers
        named = materialize(_rooted(fps, n), "named", n)
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        of = materialize(least, "least", n)
        classes = keep(materialize(named.join(of, "root").select("fp", "component_id"), "classes", n))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(classes, "fp").select(F.col(id_col), text.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = minhash.SHINGLE, similarity: float = minhash.SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group one row stays.

    Candidates come from SimHash: texts that links of fingerprints within the radius
    connect. An exact check follows: those whose sets of shingles have a Jaccard
    similarity of ``similarity`` or more are linked. That similarity is far beyond a
    fingerprint's reach of 2 bits, so MinHash bands add the candidates that differ in
    more. The row that stays has the group's smallest id, or is any one
    if the group has no ids. Ids decide nothing else: rows of different groups stay,
    whether they have one id in common or none at all.
    """
    # A written number tells rows apart; ids may be null or repeated.
    numbered = materialize(docs.withColumn("__mr_row", F.monotonically_increasing_id()), "numbered")
    with scratch() as keep:
        alike = classes(numbered, "__mr_row", text_col=text_col)
        roots = minhash.near_copies(numbered, "__mr_row", text_col=text_col, shingle=shingle, similarity=similarity, alike=alike)
        first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__mr_row").alias("row")))
        named = roots.withColumnRenamed("row", "__mr_row").join(numbered.select("__mr_row", f"`{id_col}`"), "__mr_row")
        kept = named.groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("__mr_row"))
        gone = keep(materialize(named.select("__mr_row").join(kept, "__mr_row", "left_anti"), "gone", numbered.count()))
    # The texts are shuffled only where the rows that go are too many to be broadcast.
    return numbered.join(minhash.broadcast_if_few(gone), "__mr_row", "left_anti").select(*[f"`{c}`" for c in docs.columns])
