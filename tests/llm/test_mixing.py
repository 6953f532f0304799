import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import mixing


def test_targets():
    t = mixing.target_sizes([100, 100, 100])
    assert t == pytest.approx([200, 166.6666667, 83.3333333])
    assert sum(mixing.target_sizes([10, 1000, 5, 70])) == pytest.approx(1.5 * 1085)
    t = mixing.target_sizes([1, 1, 1000, 2])
    assert t[0] == 2 and t[1] == 2 and t[3] == 4 and t[2] == pytest.approx(1.5 * 1004 - 8)
    assert mixing.target_sizes([]) == [] and mixing.target_sizes([0, 0]) == [0, 0]


def test_draws_keep_totals_and_shard_sizes():
    counts = mixing.draw_counts([1000, 10, 0, 333], 7, seed=1)
    assert counts.sum(axis=0).tolist() == [1000, 10, 0, 333]
    assert set(counts.sum(axis=1)) <= {191, 192}
    assert (counts == mixing.draw_counts([1000, 10, 0, 333], 7, seed=1)).all()
    assert not (counts == mixing.draw_counts([1000, 10, 0, 333], 7, seed=2)).all()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation_is_a_bijection(spark, n):
    df = spark.range(n).withColumn("slot", mixing._inverse_fold(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long")))
    slots = [r.slot for r in df.orderBy("id").collect()]
    assert sorted(slots) == list(range(n))
    assert slots == [mixing.slot_of(i, n, 99) for i in range(n)]
    assert [permuted(s, n, 99) for s in slots] == list(range(n))
    if n > 3:
        assert slots != list(range(n))


def permuted(slot, n, key):
    """The swap-or-not shuffle, forward."""
    x = slot
    for r in range(12):
        other = (mixing.hash_longs(key, r) % n - x) % n
        if mixing.hash_longs(key, r + 12, max(x, other)) & 1:
            x = other
    return x


def row_hash(doc_id, text, seed):
    h = 42
    for b in (None if doc_id is None else struct.pack("<q", doc_id), None if text is None else text.encode(), struct.pack("<i", seed)):
        h = h if b is None else xxhash.xxh64_intdigest(b, h)
    return h - 2**64 if h >= 2**63 else h


def targets(sizes):
    """Weights 5, 2, 1 share 150 %, 200 % at most: the common factor by bisection."""
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    lo, hi = 0.0, 3.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * s, mid * x) for s, x in zip(sizes, w, strict=True)) < 1.5 * sum(sizes) else (lo, mid)
    return [min(2.0 * s, hi * x) for s, x in zip(sizes, w, strict=True)]


def brute(rows, length, shards, seed=20):
    """{(shard, place): words} and each source's target, slot by slot."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    laid = []
    for s in names:
        hashes = sorted((h % 1024, h, (r.text or "").encode().split()) for r in by[s] for h in [row_hash(r.doc_id, r.text, seed)])
        laid.append([w for *_, ws in hashes for w in ws])
    want = targets([len(x) for x in laid])
    filled = []
    for s, words, target in zip(names, laid, want, strict=True):
        blocks = [words[i : i + length] for i in range(0, len(words), length)]
        left, taken, e = min(round(target), 2 * len(words)), [], 0
        key = mixing.zlib.crc32(f"{seed}/{s!r}".encode())
        while left:
            for j in range(len(blocks)):
                block = blocks[permuted(j, len(blocks), mixing.hash_longs(key, e))][:left]
                left -= len(block)
                taken += [block] if block else []
            e += 1
        filled.append(taken)
    counts = mixing.draw_counts([len(x) for x in filled], shards, seed)
    out, at = {}, [0] * len(names)
    for shard in range(shards):
        own = []
        for i, n in enumerate(counts[shard]):
            own += filled[i][at[i] : at[i] + n]
            at[i] += n
        for place in range(len(own)):
            out[shard, place] = own[permuted(place, len(own), mixing.hash_longs(seed, shard))]
    assert at == [len(x) for x in filled]
    return out, dict(zip(names, want, strict=True))


def check(df, length, shards=5):
    """All that the operator says, against the plain version."""
    rows = df.select("doc_id", "text", "source").collect()
    want, target = brute(rows, length, shards)
    blocks = mixing.mix_blocks(df, block_words=length, shards=shards).collect()
    got = {(b.shard, b.place): [w for p in b.pieces for w in p.text.encode().split()] for b in blocks}
    assert len(got) == len(blocks) and got == want
    for b in blocks:
        at = 0
        for p in b.pieces:
            assert p.offset == at and p.length == len(p.text.encode().split())
            at += p.length
        assert at == b.words <= length
    taken = {}
    for b in blocks:
        for p in b.pieces:
            taken[p.id, b.source] = taken.get((p.id, b.source), 0) + p.length
    mixed = mixing.mix_sources(df, block_words=length, shards=shards).collect()
    assert len(mixed) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    known = {}
    for m in mixed:
        assert 0 <= m.taken <= 2 * m.size and m.taken == sum(s.length for s in m.spans)
        assert m.shards == sorted({s.shard for s in m.spans})
        known.setdefault(m.doc_id, []).append(m)
    sums = {}
    for r in rows:
        m = known[r.doc_id].pop() if len(known[r.doc_id]) == 1 else next(m for m in known[r.doc_id] if m.size == len((r.text or "").encode().split()))
        if m in known[r.doc_id]:
            known[r.doc_id].remove(m)
        assert m.source_size == sizes[r.source] and m.target == pytest.approx(target[r.source])
        sums[r.doc_id, r.source] = sums.get((r.doc_id, r.source), 0) + m.taken
    assert {k: v for k, v in sums.items() if v} == taken
    for s in sizes:
        assert sum(v for (_, x), v in sums.items() if x == s) == round(target[s])


def test_odd_rows(odd_docs):
    check(odd_docs, 16)
    rows = mixing.mix_sources(odd_docs, block_words=16, shards=5).collect()
    again = mixing.mix_sources(odd_docs.repartition(3), block_words=16, shards=5).collect()
    key = lambda rs: sorted((str(r.doc_id), r.taken, r.shards) for r in rs)
    assert key(rows) == key(again)


def test_many_sources(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(int(rng.integers(0, 200)))), f"s{int(rng.integers(0, 9))}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(df, 64)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # the plan is joined, not broadcast
    check(df, 7)


def test_thousands_of_sources(spark):
    df = spark.range(12_000).selectExpr("id as doc_id", "concat('a b c ', id) as text", "concat('s', id) as source")
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == 12_000 and sum(r.taken for r in rows) == pytest.approx(1.5 * 48_000, rel=0.05)


def test_draws_decide_the_shards(spark, monkeypatch):
    df = spark.range(60).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 50), x -> concat('w', x, '_', id))) as text", "concat('s', id % 3) as source")
    place = lambda: {(b.shard, b.place): (b.source, b.block, b["pass"]) for b in mixing.mix_blocks(df, block_words=32, shards=4).collect()}
    first, drawn = place(), mixing.draw_counts
    monkeypatch.setattr(mixing, "draw_counts", lambda slots, shards, seed: drawn(slots, shards, seed + 1))
    other = place()
    assert first != other and sorted(first.values()) == sorted(other.values())


def test_documents_are_the_blocks_pieces(odd_docs):
    kept = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    blocks = mixing.mix_blocks(kept, block_words=16).orderBy("shard", "place").collect()
    rows = mixing.mixed_documents(kept, block_words=16).collect()
    assert sorted((str(p.id), p.text) for b in blocks for p in b.pieces) == sorted((str(r.doc_id), r.text) for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows)
    one = mixing.mixed_documents(kept.coalesce(1), block_words=16).coalesce(1).collect()
    assert len(one) == len(rows)


def test_nulls_and_repeats_keep_their_texts(spark):
    """Rows of one id and size differ in text alone; many null ids do not share a part."""
    rows = [(None, f"a{i} b{i} c{i}", "s") for i in range(60)] + [(7, f"x{i} y{i}", "s") for i in range(40)] + [(8, "same words", "t")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted((str(r.doc_id), r.text) for r in mixing.mixed_documents(df, block_words=8).collect())
    two = sorted((str(r.doc_id), r.text) for r in mixing.mixed_documents(df.repartition(5), block_words=8).collect())
    assert one == two
    assert df.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(20)), F.lit(mixing.PARTS))).distinct().count() > 80


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b c", "s", "keep", "me", 9)], "doc_id long, text string, source string, mix_size string, shards string, size int")
    assert {(r.mix_size, r.shards, r["size"]) for r in mixing.mixed_documents(df).collect()} == {("keep", "me", 9)}
    assert mixing.mix_sources(df).first().size == 3


def test_empty(no_docs):
    assert mixing.mix_sources(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0 and mixing.mix_blocks(no_docs).count() == 0


def test_plan_is_native(odd_docs):
    for df in (mixing.mix_sources(odd_docs), mixing.mixed_documents(odd_docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_spark_hash_of_strings_is_xxh64(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)
