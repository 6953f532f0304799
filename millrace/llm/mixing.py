"""Mixing sources to target weights, in DataFrame functions only.

The words of a source are laid end to end in a pseudorandom order of its rows
and packed into blocks of one length. The mix is a list of slots of one block
each, dealt to output shards: multinomial draws say how many slots each source
fills in each shard. Slot j of a source in pass e takes the block at index
perm(j), a pseudorandom permutation of the source's block indexes, and its place
in the shard is drawn by a permutation of the shard's places. Blocks and slots
are joined by index: both permutations are bijections with known inverses, so a
row works out the shards and places of its own blocks, and the blocks of a shard
meet at their places. No table of slots is generated or shuffled for that.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import P, let, materialize, word_count

#: Words of a block (a source's last block has what is left) and output shards.
BLOCK_WORDS, OUT_SHARDS = 512, 64
#: Parts of a source for numbering its words, so that no task orders a whole source.
PARTS = 1024
#: The plan of up to this many sources is broadcast (a few kB each); that of more is joined.
BROADCAST_SOURCES = 2000
#: Files of the table of parts, and places of a shard that go to one task together.
PART_FILES, CHUNK_PLACES = 16, 64
ROUNDS = 12


def target_sizes(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> list[float]:
    """What each source should give: by weight, but at most ``cap`` times its size.

    The excess of those at their cap is shared out by weight among the others,
    again and again until none is above.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(w[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * w[i] / total >= cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            free.discard(i)
        left -= sum(out[i] for i in over)
    return out


def draw_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each output shard, [shards, sources].

    Shards are of equal size and drawn one after the other, each a multinomial
    over what the sources still have to give; a draw beyond that is drawn again
    among the others. So the totals come out exactly.
    """
    rng = np.random.default_rng(seed)
    left = np.array(slots, dtype=np.int64)
    total, out = int(left.sum()), np.zeros((shards, len(slots)), dtype=np.int64)
    for i in range(shards):
        need = total * (i + 1) // shards - total * i // shards
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[i] += got
            left -= got
            need -= int(got.sum())
    return out


def hash_longs(*values: int) -> int:
    """Spark's ``xxhash64`` of bigints, in plain Python."""
    import xxhash

    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - 2**64 if h >= 2**63 else h


def slot_of(index: int, n: int, key: int) -> int:
    """``_inverse_fold`` in plain Python."""
    x = index
    for r in reversed(range(ROUNDS)):
        other = (hash_longs(key, r) % n - x) % n
        if hash_longs(key, r + ROUNDS, max(x, other)) & 1:
            x = other
    return x


@dataclass(frozen=True)
class Plan:
    """One source: its size, target, blocks and slots, and where its slots go."""

    source: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last: int  # words that the last slot takes; 0: all of its block
    key: int  # of its permutations
    shards: list[int]  # output shards that take slots of this source
    ends: list[int]  # slots of this source up to each of those shards' ends
    bases: list[int]  # what is added to a slot for its number in each of those shards


def plan(sizes: dict[str | None, int], *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, shards: int = OUT_SHARDS, seed: int = 20) -> list[Plan]:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))  # by code point, null last
    sized = [sizes[s] for s in names]
    found = []
    for name, size, target in zip(names, sized, target_sizes(sized, weights, share, cap), strict=True):
        blocks = -(-size // block_words)
        key = zlib.crc32(f"{seed}/{name!r}".encode())
        want = min(round(target), int(cap * size))
        passes, rest = divmod(want, size) if size else (0, 0)
        more = last = 0
        if rest:  # the last pass takes its first slots, one of which may hold the short block
            short = slot_of(blocks - 1, blocks, hash_longs(key, passes))
            words = lambda k: k * block_words - (short < k) * (blocks * block_words - size)
            more = -(-rest // block_words)
            more += words(more) < rest
            last = rest - words(more - 1)
        found.append((name, size, target, blocks, passes * blocks + more, last, key))
    counts = draw_counts([f[4] for f in found], shards, seed) if found else np.zeros((shards, 0), np.int64)
    ends, first = counts.cumsum(axis=0), counts.cumsum(axis=1) - counts
    out = []
    for i, f in enumerate(found):
        used = np.flatnonzero(counts[:, i])
        out.append(Plan(*f, used.tolist(), ends[used, i].tolist(), (first - ends + counts)[used, i].tolist()))
    return out


def _inverse_fold(index: Column, n: Column, key: Column) -> Column:
    """The slot that the permutation of 0..n-1 under ``key`` maps to ``index``.

    A swap-or-not shuffle (Hoang, Morris and Rogaway): each round pairs x with
    (k - x) mod n and swaps the two if a bit of the larger one's hash is set. Each
    round undoes itself, so the inverse is the rounds in reverse order.
    """
    rounds = F.array(*[F.lit(r).cast("long") for r in reversed(range(ROUNDS))])

    def step(x: Column, r: Column) -> Column:
        swapped = lambda other: F.when(F.xxhash64(key, r + F.lit(ROUNDS).cast("long"), F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)
        return let(F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n), swapped)

    return F.aggregate(rounds, index, step)


_SPAN = "struct<shard:int,place:bigint,pass:int,block:bigint,offset:int,start:bigint,length:bigint>"


def _with_spans(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, shards: int = OUT_SHARDS, seed: int = 20) -> DataFrame:
    """``docs`` plus, under the prefix P: size, ssize, target, and spans in the row's order."""
    c = lambda name: F.col(f"{P}{name}")
    # The hash orders a source's rows: rows that tie are alike in id and text.
    sized = docs.withColumns({f"{P}size": word_count(F.col(text_col)), f"{P}hash": F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), f"{P}source": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))})
    sized = sized.withColumn(f"{P}part", F.pmod(c("hash"), F.lit(PARTS)).cast("int"))
    parts = materialize(sized.groupBy(c("source").alias("s"), c("part").alias("p")).agg(F.sum(c("size")).alias("n")), "parts", files=PART_FILES)
    totals = parts.groupBy("s").agg(F.sum("n").alias("n")).collect()  # a row for each source
    plans = plan({r["s"][1:] if r["s"] else None: r["n"] for r in totals}, weights=weights, share=share, cap=cap, block_words=block_words, shards=shards, seed=seed)
    rows = [("" if p.source is None else "=" + p.source, p.size, p.target, p.blocks, p.slots, p.last, p.key, p.shards, p.ends, p.bases) for p in plans]
    known = docs.sparkSession.createDataFrame(rows, f"{P}s string, {P}ssize long, {P}target double, {P}blocks long, {P}slots long, {P}last long, {P}key long, {P}shards array<int>, {P}ends array<long>, {P}bases array<long>").coalesce(1)
    # Where each part starts among the source's words.
    before = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select(F.col("s").alias(f"{P}fs"), F.col("p").alias(f"{P}fp"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{P}first"))
    order = Window.partitionBy(c("source"), c("part")).orderBy(c("hash")).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn(f"{P}within", F.coalesce(F.sum(c("size")).over(order), F.lit(0)))
    both = placed.join(firsts, (c("source") == c("fs")) & (c("part") == c("fp")))
    both = both.join(F.broadcast(known) if len(rows) <= BROADCAST_SOURCES else known, c("source") == c("s"))
    both = both.withColumn(f"{P}begin", c("first") + c("within"))
    total, words = sum(p.slots for p in plans), F.lit(block_words).cast("long")

    def spans_of(block: Column) -> Column:
        lo, hi = F.greatest(block * words, c("begin")), F.least((block + 1) * words, c("begin") + c("size"))

        def in_pass(e: Column) -> Column:
            # Bound to a variable: the permutation is worked out once for each block and pass.
            keyed = lambda key: e * c("blocks") + _inverse_fold(block, c("blocks"), key)
            return let(let(F.xxhash64(c("key"), e), keyed), lambda slot: F.when(slot < c("slots"), let(F.size(F.filter(c("ends"), lambda x: x <= slot)) + 1, lambda i: taken_by(slot, e, i))))

        def taken_by(slot: Column, e: Column, i: Column) -> Column:
            # Only the last slot of all takes less than its block, from the block's start on.
            end = F.when((slot == c("slots") - 1) & (c("last") > 0), F.least(hi, block * words + c("last"))).otherwise(hi)
            shard = F.element_at(c("shards"), i)
            # Places of the shard: the total is dealt evenly.
            edge = lambda s: F.floor(F.lit(total).cast("decimal(20,0)") * s / F.lit(shards)).cast("long")
            place = _inverse_fold(slot + F.element_at(c("bases"), i), edge(shard + 1) - edge(shard), F.xxhash64(F.lit(seed).cast("long"), shard.cast("long")))
            return F.struct(shard.alias("shard"), place.alias("place"), e.cast("int").alias("pass"), block.alias("block"), (lo - block * words).cast("int").alias("offset"), (lo - c("begin")).alias("start"), (end - lo).alias("length"))

        return F.transform(passes, in_pass)

    passes = F.array(*[F.lit(e).cast("long") for e in range(int(-(-cap // 1)))])
    own = F.expr(f"sequence({P}begin div {block_words}, ({P}begin + {P}size - 1) div {block_words})")
    spans = F.filter(F.flatten(F.transform(own, spans_of)), lambda x: x["length"] > 0)  # null lengths go, too
    both = both.withColumn(f"{P}spans", F.when(c("size") > 0, spans).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)")))
    return both.select(*[F.col(f"`{x}`") for x in docs.columns], c("size"), c("ssize"), c("target"), c("spans"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """(id, size, source_size, target, taken, shards, spans) for every row.

    A span is (shard, place, pass, block, offset, start, length): the block at that
    place of the output shard holds, from its word ``offset`` on, ``length`` words of
    the row from the row's word ``start`` on. ``taken`` is the sum of the lengths, and
    ``shards`` lists the output shards. Null texts have size 0 and no span; a null
    source is a source of its own, last in order. Rows that repeat are rows of
    their own. An empty table gives an empty mix. Other columns are ignored. A row's
    words are taken ``cap`` times at most.
    """
    spans = F.col(f"{P}spans")
    taken = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["length"])
    shards = F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["shard"])))
    mixed = _with_spans(docs, id_col=id_col, **how)
    return mixed.select(F.col(f"`{id_col}`"), F.col(f"{P}size").alias("size"), F.col(f"{P}ssize").alias("source_size"), F.col(f"{P}target").alias("target"), taken.alias("taken"), shards.alias("shards"), spans.alias("spans"))


def _pieces(docs: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """A row for each span: the columns of ``docs``, P + "span", and P + "text" with its words.

    A span of a whole row has the text as it is, others the words with the white
    space before each.
    """
    mixed = _with_spans(docs, text_col=text_col, **how)
    whole = lambda x: x["length"] == F.col(f"{P}size")
    parts = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    # The words are found once a row, and only for rows that are cut.
    words = F.when(F.exists(f"{P}spans", lambda x: ~whole(x)), parts)

    def cut(words: Column) -> Column:
        text = lambda x: F.when(whole(x), F.col(f"`{text_col}`")).otherwise(F.array_join(F.slice(words, x["start"].cast("int") + 1, x["length"].cast("int")), ""))
        return F.transform(f"{P}spans", lambda x: F.struct(x.alias("span"), text(x).alias("text")))

    rows = mixed.select(*[F.col(f"`{x}`") for x in docs.columns], F.explode(let(words, cut)).alias(f"{P}x"))
    return rows.select(*[F.col(f"`{x}`") for x in docs.columns], F.col(f"{P}x.span").alias(f"{P}span"), F.col(f"{P}x.text").alias(f"{P}text"))


def mix_blocks(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The output shards: (shard, place, source, pass, block, words, pieces), a row for each slot.

    ``pieces`` has (offset, id, start, length, text) in the block's order; their
    lengths add up to ``words``, the block length but for a source's last block and
    last slot. The places of a shard are 0, 1, 2 and so on.
    """
    rows = _pieces(docs, id_col=id_col, source_col=source_col, **how)
    span = lambda name: F.col(f"{P}span.{name}")
    piece = F.struct(span("offset").alias("offset"), F.col(f"`{id_col}`").alias("id"), span("start").alias("start"), span("length").alias("length"), F.col(f"{P}text").alias("text"))
    # A block has as many pieces as words at most.
    found = rows.groupBy(span("shard").alias("shard"), span("place").alias("place")).agg(F.first(f"`{source_col}`").alias("source"), F.first(span("pass")).alias("pass"), F.first(span("block")).alias("block"), F.sum(span("length")).alias("words"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    return found.select("shard", "place", "source", "pass", "block", "words", "pieces")


def mixed_documents(docs: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The mix as documents: the pieces of the output shards' blocks, in order.

    A row for each piece, with the columns of ``docs``: the text is the piece's, and
    n_chars, if there, is counted anew. Pieces stand in the order of the mix: some
    places of an output shard go to one partition together, sorted.
    """
    rows = _pieces(docs, text_col=text_col, **how)
    span = lambda name: F.col(f"{P}span.{name}")
    rows = rows.repartition(span("shard"), F.floor(span("place") / CHUNK_PLACES)).sortWithinPartitions(span("shard"), span("place"), span("offset"))
    new = {text_col: F.col(f"{P}text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(f"{P}text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new[x].alias(x) if x in new else F.col(f"`{x}`") for x in docs.columns])
