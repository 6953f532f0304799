import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import minhash, simhash
from millrace.llm.components import connected_components


def fingerprint(text):
    """By the definition, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_masks_cover_every_pair():
    masks = simhash.covering_masks()
    assert len(masks) == 7 and all(30 <= m.bit_count() <= 40 for m in masks)
    for i, j in itertools.product(range(64), repeat=2):
        assert any(not m & (1 << i | 1 << j) for m in masks)


def test_odd_rows(odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    got = sorted((str(r.doc_id), r.fingerprint) for r in rows)
    assert got == sorted((str(t.doc_id), f"{fingerprint(t.text):016x}") for t in texts)
    fps = {int(r.fingerprint, 16) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    of = components(links, fps)
    for r in rows:
        same = [x.doc_id for x in rows if of[int(x.fingerprint, 16)] == of[int(r.fingerprint, 16)] and x.doc_id is not None]
        assert r.component_id == min(same, default=None)
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}  # no words: linked like any other


def test_links_against_brute_force(spark, monkeypatch):
    """Chains, hubs and buckets on both sides of the limit give the components of all links."""
    r = random.Random(5)
    for limit in (2, 16):
        monkeypatch.setattr(simhash, "SMALL_BUCKET", limit)
        fps = {r.getrandbits(64) for _ in range(30)}
        hub = r.getrandbits(64)
        fps |= {hub ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(80)}
        chain = r.getrandbits(64)
        for i in range(0, 40, 2):
            fps.add(chain := chain ^ (1 << i) ^ (1 << (i + 1)))
        df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
        found = [(x.a % 2**64, x.b % 2**64) for x in simhash.links(df, len(fps)).collect()]
        true = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2]
        assert components(found, fps) == components(true, fps)


def test_drop(odd_docs, no_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id and r.doc_id < 6) == [1, 3]
    assert simhash.drop_near_duplicates(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0


def test_drop_tells_rows_apart(spark):
    """Null and repeated ids hide no row: one stays of each group of texts."""
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(7, t) for t in texts[6:10]] + [(8, texts[10]), (8, texts[0]), (9, texts[11]), (None, texts[11]), (None, texts[1])]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(k.text for k in kept) == sorted(texts)
    assert {k.text: k.doc_id for k in kept} == {t: 8 if i in (0, 10) else 9 if i == 11 else 7 if i > 5 else None for i, t in enumerate(texts)}


def test_drop_reaches_similarity(spark):
    """Pairs at a Jaccard similarity of 0.8 and more of five words lose one text, those below none."""
    r = random.Random(3)
    rows, gone = [], set()
    for i in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        other = list(words)
        for at in r.sample(range(200), r.randrange(1, 12)):
            other[at] = "x"
        a, b = ({tuple(w[j : j + 5]) for j in range(196)} for w in (words, other))
        if len(a & b) >= 0.8 * len(a | b):
            gone.add(2 * i + 1)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert 30 < len(gone) < 120
    kept = {k.doc_id for k in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    dropped = set(range(300)) - kept
    assert dropped <= gone and len(dropped) >= 0.98 * len(gone)


@pytest.mark.parametrize("group", [128, 4])
def test_drop_goes_through_simhash(spark, monkeypatch, group):
    """Without any MinHash key in common, texts within 2 bits are still found, and checked by their shingles."""
    r = random.Random(11)
    real = minhash.shingle_sets

    def no_keys_in_common(*args, **kwargs):
        sets = real(*args, **kwargs)
        return sets.withColumn("keys", F.transform("keys", lambda k, t: F.xxhash64("row", t)))

    monkeypatch.setattr(minhash, "shingle_sets", no_keys_in_common)
    monkeypatch.setattr(minhash, "GROUP", group)
    monkeypatch.setattr(minhash, "BLOCK", 2 * group)
    texts = []
    for i in range(12):
        words = [f"w{r.randrange(10**6)}" for _ in range(500)]
        texts += [" ".join(words[:-1] + [f"end{j}"]) for j in range(30 if i == 0 else 2)]
    # One shingle makes the fingerprint, but the sets differ.
    texts += [" ".join(["spam"] * 900 + [f"v{r.randrange(10**6)}" for _ in range(30)]) for _ in range(6)]
    texts += [None, "", "one"]
    fps = [fingerprint(t) for t in texts]
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    true = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) >= len(true) + 15 and len(true) > 300
    want = set(components(true, range(len(texts))).values())
    kept = {k.doc_id for k in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == want


def test_near_copies_of_large_groups(spark, monkeypatch):
    """Sets that are similar to very few of a large group are found, whatever the size of its blocks."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]

    def changed(words, n):
        out = list(words)
        for at in r.sample(range(len(words)), n):
            out[at] = f"x{r.randrange(10**6)}"
        return out

    group = [changed(base, r.randrange(2, 7)) for _ in range(150)]
    # Near one of the group, or near one that is, and far from most.
    group += [changed(r.choice(group[:150]), 7) for _ in range(30)] + [changed(base, r.randrange(12, 30)) for _ in range(30)]
    sets = [{tuple(w[j : j + 5]) for j in range(396)} for w in group]
    true = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = components(true, range(len(sets)))
    assert len(set(want.values())) > 10
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(group)], "row long, text string")
    for group_size, block in ((128, 256), (8, 16), (8, 8)):
        monkeypatch.setattr(minhash, "GROUP", group_size)
        monkeypatch.setattr(minhash, "BLOCK", block)
        found = {x.row: x.root for x in minhash.near_copies(docs, "row").collect()}
        assert {i: min(j for j in found if found[j] == found[i]) for i in found} == {i: min(j for j in want if want[j] == want[i]) for i in want}


@pytest.mark.parametrize("shape", ["path", "star", "random", "strings", "none"])
def test_connected_components(spark, shape):
    r = random.Random(1)
    edges = {"path": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)], "random": [(r.randrange(150), r.randrange(150)) for _ in range(120)], "strings": [("a", "b"), ("c", "b"), ("x", "y"), ("x", "x")], "none": []}[shape]
    kind = "string" if shape == "strings" else "long"
    rows = connected_components(spark.createDataFrame([*edges, (None, edges[0][0] if edges else None)], f"a {kind}, b {kind}")).collect()
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    want = components([e for e in edges if e[0] != e[1]], nodes)
    assert {x.v for x in rows} == nodes and len(rows) == len(nodes)
    same = lambda of: {frozenset(n for n in nodes if of[n] == of[m]) for m in nodes}
    assert same({x.v: x.root for x in rows}) == same(want)
