"""Embeddings, language identification, text search and the pipeline."""

import collections
import gc
import math
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from millrace.llm import bm25, hnsw, langid


def vectors():
    r = np.random.default_rng(8)
    rows = [r.normal(size=16) for _ in range(1500)]
    for size in (2, 30, 300):
        centre = r.normal(size=16)
        rows += [centre + 0.12 * r.normal(size=16) for _ in range(size)]
    rows += [rows[0]] * 40 + [rows[1] * 3.5] * 2
    return [(int(i), v.tolist()) for i, v in zip(r.permutation(len(rows)), rows, strict=True)]


ODD = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0, None] + [0.0] * 14), (5004, [math.nan] * 16), (5005, [math.inf] + [0.0] * 15), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (5008, [1e-200] + [0.0] * 15), (5009, [1e200] + [0.0] * 15), (None, [0.0, 1.0]), (5010, [0.0, 1.0]), (5010, [0.0, 1.0])]
SCHEMA = "vec_id long, embedding array<double>"


def test_vectors_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows + ODD, SCHEMA).selectExpr("*", "'x' as n", "'y' as node", "0 as links", "'z' as id")
    got = hnsw.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows) + len(ODD)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in rows])
    found = {g.vec_id: g for g in got if g.vec_id is not None and g.vec_id < 5000}
    true, hits = int(near.sum()), sum(found[i].n_links for i in ids.tolist())
    assert 0.98 * true <= hits <= true
    component = np.arange(len(ids))
    while True:  # labels by repeated minimum
        least = np.array([min(component[i], component[near[i]].min(initial=len(ids))) for i in range(len(ids))])
        if (least == component).all():
            break
        component = least
    for c in np.unique(component):
        members = ids[component == c]
        assert {found[i].component_id for i in members.tolist()} == {int(members.min())}
    odd = collections.defaultdict(list)
    for g in got:
        if g.vec_id is None or g.vec_id >= 5000:
            odd[g.vec_id].append((g.n_links, g.component_id, g.kept))
    assert all(odd[i] == [(0, i, True)] for i in range(5000, 5006))
    assert odd[5006] == [(1, 5006, True)] and odd[5007] == [(1, 5006, False)]
    assert odd[5008] == [(1, 5008, True)] and odd[5009] == [(1, 5008, False)]
    assert odd[None] == [(2, 5010, False)] and odd[5010] == [(2, 5010, True)] * 2
    assert hnsw.near_duplicate_vectors(df.where("false")).count() == 0


def test_graph_recall_and_audit():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 24))
    x[1000:1200] = x[0] + 0.1 * r.normal(size=(200, 24))  # a tight group far wider than the beam
    x = hnsw._unit(x).astype(np.float32)
    g = hnsw.Graph.build(x, links=8, beam=24)
    g.width = 1
    g.audit(0.9)
    found = {p for rows, nodes in g.near(x, 0.9) for p in zip(rows.tolist(), nodes.tolist(), strict=True)}
    true = set(zip(*np.nonzero(x @ x.T >= 0.9), strict=True))
    assert len(found & true) >= 0.97 * len(true) and found <= true


def test_audit_counts_rows_not_links():
    """A large group's links do not hide lost pairs; nodes out of reach are found by brute force."""
    r = np.random.default_rng(4)
    base = r.normal(size=(200, 24))
    x = np.concatenate([r.normal(size=24) + 0.02 * r.normal(size=(1600, 24)), base, base + 0.02 * r.normal(size=(200, 24))])
    x = hnsw._unit(x).astype(np.float32)
    g = hnsw.Graph.build(x)
    bottom = g.layers[0]
    bottom[(bottom >= 1600)] = -1  # no way to the pairs
    g.audit(0.95)
    found = {p for rows, nodes in g.near(x, 0.95) for p in zip(rows.tolist(), nodes.tolist(), strict=True)}
    assert all((1600 + i, 1800 + i) in found for i in range(200))
    one = hnsw.Graph.build(x[1600:])
    one.layers[0][:] = -1
    one.audit(1.5)  # no node has such neighbours
    assert one.width == hnsw.FIRST_BEAM


@pytest.mark.parametrize("cut", [0, 1])
def test_links_from_either_end(monkeypatch, cut):
    """A link that only one end's search finds counts, once, whichever end it is."""
    real = hnsw.Graph.near

    def near(self, q, least):
        for r, at in real(self, q, least):
            one_way = (q[r, 0] > self.x[at, 0]) == bool(cut)
            keep = one_way | (np.abs(q[r] - self.x[at]).max(axis=1) == 0)
            yield r[keep], at[keep]

    monkeypatch.setattr(hnsw.Graph, "near", near)
    r = np.random.default_rng(6)
    base = r.normal(size=(60, 16))
    vecs = np.concatenate([base, base + 0.02 * r.normal(size=(60, 16))])
    row = lambda v, at: hnsw._build(pd.DataFrame({"dim": 16, "shard": 0, "node": at, "n": 1, "vec": list(v)}), 2.0)
    a, b, both = row(vecs[:60], np.arange(60)), row(vecs[60:], np.arange(60, 120)), row(vecs, np.arange(120))
    for key, g, asked in [((16, 0, 1), a, b), ((16, 0, 0), both, both)]:
        found = hnsw._search(key, g, asked, 0.95)
        assert sorted(found["node"]) == list(range(120)) and set(found["links"]) == {1}


def test_merge_labels():
    label = np.arange(10)
    hnsw._merge(label, np.array([9, 8, 1, 3, 5]), np.array([8, 7, 2, 1, 5]))
    assert label.tolist() == [0, 1, 1, 1, 4, 5, 6, 7, 7, 7]


EN = "the of and to in is that for with this from have they which would there been were their when"
DE = "der die und das nicht ist ein ich mit auch für eine auf werden sich über schön wird haben größe"
RU = "и в не на что он как это она был для они все так но его только быть меня было"


def labelled(spark, n=400):
    r = np.random.default_rng(5)
    rows = []
    for i in range(n):
        lang, words = [("en", EN), ("de", DE), ("ru", RU)][i % 3]
        rows.append((i, " ".join(r.choice(words.split(), int(r.integers(5, 60)))) + ".", lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id(spark, odd_docs):
    docs = labelled(spark)
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "ru"]
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and all(r.lang_pred == r.lang and r.score > 0.9 for r in held)
    odd = langid.identify(odd_docs, model, keep=odd_docs.columns).collect()
    assert len(odd) == odd_docs.count()
    for r in odd:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (r.score > 0) == letters
    assert langid.identify(docs.where("false"), model).count() == 0


def test_spans_of_mixed_text(spark):
    model = langid.fit(labelled(spark))
    words = EN.split() + DE.split() + RU.split()
    lang, score, spans = langid.label_texts([" ".join(words)], model)[0]
    assert [s[2] for s in spans] == ["en", "de", "ru"] and [s[1] for s in spans] == pytest.approx([20, 20, 20], abs=2)
    assert sum(s[1] for s in spans) == len(words) and score < 0.6
    # a single foreign word is no switch
    assert len(langid.label_texts([EN + " und " + EN], model)[0][2]) == 1
    # a script narrows the candidates; one that no language has leaves them open
    assert langid.label_texts(["привет"], model)[0][0] == "ru"
    assert langid.label_texts(["漢字"], model)[0][0] in model.langs


def test_fit_learns_from_nothing_it_should_not(spark):
    docs = labelled(spark)
    held = docs.where(langid.is_held_out("doc_id"))
    none = langid.fit(held)
    assert none.langs == [] and langid.label_texts(["the"], none)[0][0] == "und"
    model = langid.fit(docs, rows=100)
    assert langid.label_texts([EN, DE, RU], model)[1][0] == "de"
    renamed = docs.selectExpr("doc_id", "text", "case when doc_id % 5 = 0 then null else lang end as lang")
    assert langid.fit(renamed).langs == ["de", "en", "ru"]


def best_path(scores, penalty):
    """All paths, by dynamic programming over one text."""
    v = scores[0].astype(float)
    for s in scores[1:]:
        v = np.maximum(v, v.max() - penalty) + s
    return v.max()


def value(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 10**6)), min_size=1, max_size=6), st.sampled_from([0.0, 0.5, 3.0]))
def test_viterbi_is_optimal(texts, penalty):
    many = [np.random.default_rng(seed).normal(size=(n, 3)) * 2 for n, seed in texts]
    for s, path in zip(many, langid.viterbi_batch(many, penalty), strict=True):
        assert value(s, path, penalty) == pytest.approx(best_path(s, penalty))


@pytest.mark.parametrize("langs", [1, 2, 3, 150])
def test_viterbi_in_segments(monkeypatch, langs):
    """Segments and bounded batches change nothing."""
    r = np.random.default_rng(langs)
    many = [r.normal(size=(int(n), langs)).round(1) * 3 for n in r.integers(1, 400, 30)]
    whole = langid.viterbi_batch(many, 2.0)
    monkeypatch.setattr(langid, "_CELLS", 100 * langs)
    monkeypatch.setattr(langid, "_SEGMENT", 37 * langs)
    for a, b, s in zip(whole, langid.viterbi_batch(many, 2.0), many, strict=True):
        assert (a == b).all() and value(s, a.astype(int), 2.0) == pytest.approx(best_path(s, 2.0))


def test_long_text_in_bounded_memory(spark):
    """A long text among short ones, in three languages by turns (300,000 words took under 200 MB)."""
    import tracemalloc

    model = langid.fit(labelled(spark))
    words = [f"{w}{i}" if i % 7 == 0 else w for i in range(2500) for part in [(EN, DE, RU)[i // 100 % 3]] for w in part.split()]
    texts = [" ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words), *[EN, DE + " " + RU] * 31]
    tracemalloc.start()
    held = tracemalloc.get_traced_memory()[0]
    found = langid.label_texts(texts, model)
    peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert len(words) > 49_000 and peak < 50e6
    assert 20 <= len(found[0][2]) <= 30 and sum(s[1] for s in found[0][2]) == len(words)
    rows = {w: i for i, w in enumerate(dict.fromkeys(langid.words_of(texts[0])))}
    own = model.score(list(rows))[[rows[w] for w in langid.words_of(texts[0])]]
    spans = [(a, n, model.langs.index(x)) for a, n, x in found[0][2]]
    path = np.repeat([x for *_, x in spans], [n for _, n, _ in spans])
    assert value(own, path, langid.SWITCH_PENALTY) == pytest.approx(best_path(own, langid.SWITCH_PENALTY))


def test_ngrams_of_parts(monkeypatch):
    words = ["a", "bcd", "x" * 500, "é日", "yz"]
    joined = lambda: sorted(zip(*(np.concatenate(x).tolist() for x in zip(*langid.ngram_buckets(words), strict=True)), strict=True))
    whole = joined()
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(langid, "_NGRAM_CHARS", size)
        assert joined() == whole


def test_sample_by_language(spark):
    """A rare language is learned though far fewer rows are read; very many languages share buckets."""
    docs = labelled(spark, 3000).where("lang <> 'ru' or doc_id % 60 = 2").cache()
    model = langid.fit(docs, rows=150)
    assert model.langs == ["de", "en", "ru"] and langid.label_texts([RU], model)[0][0] == "ru"
    assert langid._quotas({"a": 10, "b": 1000, "c": 5000}, 300) == {"a": 10, "b": 145, "c": 145}
    many = spark.range(1600).selectExpr("id as doc_id", "concat('word', id % 400, ' text') as text", "concat('l', id % 400) as lang")
    model = langid.fit(many)
    assert 390 < len(model.langs) <= 400 and len(model.table) * 400 <= langid.BUCKETS * langid.FULL_LANGS


def test_keep_identified(spark, odd_docs, no_docs):
    docs = labelled(spark)
    mixed = spark.createDataFrame([(9000, " ".join(EN.split()[:7] + DE.split()[:7] + RU.split()[:7]), "en"), (9001, "123 !!", "en"), (9002, None, None), (9003, "漢字 日本語", None)], docs.schema)
    kept = langid.keep_identified(docs.union(mixed))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*range(400), 9000}  # several languages are no reason to go
    one = docs.where("lang = 'en'")
    assert langid.keep_identified(one).count() == one.count()
    assert langid.keep_identified(odd_docs).columns == odd_docs.columns and langid.keep_identified(no_docs).count() == 0


def ranking(docs, queries, k=10):
    """BM25 of everything against everything, with the operator's rounding and ties."""
    tokens = [bm25.terms_of(t or "") for _, t in docs]
    n, mean = len(docs), sum(map(len, tokens)) / max(1, len(docs))
    df = collections.Counter(t for ts in tokens for t in set(ts))
    out = []
    for q, text in queries:
        asked = collections.Counter(bm25.terms_of(text or ""))
        found = []
        for (d, _), ts in zip(docs, tokens, strict=True):
            tf = collections.Counter(ts)
            s = sum(c * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for t, c in asked.items() if tf[t])
            if s > 0:
                found.append((-round(s, 6), d is None, d or 0, d))
        out += [(q, i + 1, d, pytest.approx(-s, abs=3e-6)) for i, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=lambda x: (x[0], x[1]))


@pytest.fixture
def small_shards(monkeypatch):
    for name, n in (("SHARD_DOCS", 7), ("GROUP_SHARDS", 2), ("QUERY_BLOCK", 3), ("BLOCK", 2), ("DENSE", 4)):
        monkeypatch.setattr(bm25, name, n)


@pytest.mark.usefixtures("small_shards")
def test_top_k(spark, odd_docs):
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    more = [(1000 + i, " ".join(r.choice(words, int(r.zipf(1.6)) % 50 + 1))) for i in range(120)]
    docs = [(d.doc_id, d.text) for d in odd_docs.collect()] + more
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as ids", "'y' as terms", "0 as w", "1 as q", "2 as g", "3 as block", "4 as shard", "5 as term")
    queries = df.where("doc_id % 100 = 0 or doc_id in (1, 3, 4, 5, 1001, 1002, 1003, 1004)")
    got = sorted(((r.query_id, r["rank"], r.doc_id, r.score) for r in bm25.top_k(df, queries).collect()), key=lambda x: (x[0], x[1]))
    want = ranking(docs, [(q.doc_id, q.text) for q in queries.collect()])
    assert got == want
    assert not any(q in (3, 4, 5) for q, *_ in got)
    # repeated queries and small k
    twice = bm25.top_k(df, queries.where("doc_id = 1001").union(queries.where("doc_id = 1001")), k=3).collect()
    assert len(twice) == 6
    assert bm25.top_k(df.where("false"), queries).count() == 0 and bm25.top_k(df, queries.where("false")).count() == 0


@pytest.mark.usefixtures("small_shards")
def test_top_k_sql(spark, odd_docs):
    docs = [(d.doc_id, d.text) for d in odd_docs.collect()]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())}))
    df = spark.createDataFrame(docs, "doc_id long, text string").where("doc_id is null or doc_id = doc_id")
    got = sorted(tuple(r) for r in bm25.top_k(df, df.where("doc_id % 100 = 0")).select("query_id", "rank", "doc_id", "score").collect())
    want = sorted(con.sql(bm25.oracle()).fetchall())
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=3e-6)


def exchanged(plan):
    """The columns of all shuffles in a physical plan."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return exchanged(plan.initialPlan())
    own = {plan.output().apply(i).name() for i in range(plan.output().size())} if plan.nodeName() == "Exchange" else set()
    return own.union(*(exchanged(plan.children().apply(i)) for i in range(plan.children().size())))


@pytest.mark.usefixtures("small_shards")
def test_shuffles_grow_with_results_only(spark, monkeypatch):
    """However many blocks of queries there are, neither the index nor whole queries are shuffled for a search."""
    real, plans = bm25.materialize, []

    def materialize(df, name, *args, **kwargs):
        plans.append((name, exchanged(df._jdf.queryExecution().executedPlan())))
        return real(df, name, *args, **kwargs)

    monkeypatch.setattr(bm25, "materialize", materialize)
    monkeypatch.setattr(bm25, "TASKS", 3)
    df = spark.range(200).selectExpr("id as doc_id", "concat('w', id % 7, ' w', id % 11, ' common') as text")
    found = bm25.top_k(df, df.where("doc_id % 10 = 0"))
    plans.append(("result", exchanged(found._jdf.queryExecution().executedPlan())))
    assert not any({"ids", "postings", "tfs", "text", "lengths"} & c for _, c in plans)
    searches = [c for name, c in plans if name == "found"]
    assert len(searches) == 7 and set().union(*searches) <= {"q", "id", "score"}
    got = sorted(((r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=lambda x: (x[0], x[1]))
    docs = [(d.doc_id, d.text) for d in df.collect()]
    assert got == ranking(docs, [d for d in docs if d[0] % 10 == 0])


def test_coarse_blocks_agree(monkeypatch):
    """Queries with many postings take coarse blocks, with the same result."""
    r = np.random.default_rng(2)
    docs = [(i, " ".join(f"w{x % 300}" for x in r.zipf(1.3, 40))) for i in range(500)]
    monkeypatch.setattr(bm25, "DENSE", 5)
    b = bm25._Builder()
    for d in docs:
        b.add(*d)
    shard = bm25.Shard(b.row(), 40.0)
    queries = [(i, sorted(set(bm25.terms_of(t))), np.ones(len(set(bm25.terms_of(t))))) for i, t in docs[:20]]
    found = []
    for coarse in (1, 3, 8):
        monkeypatch.setattr(bm25, "COARSE", coarse)
        best = {}
        bm25.Shard(b.row(), 40.0).search_all(queries, 5, best)
        found.append({q: (s.tolist(), i.tolist()) for q, (s, i) in best.items()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 20
    longest = max(queries, key=lambda q: len(q[1]))
    assert shard.df[[shard.index[t] for t in longest[1] if shard.column[shard.index[t]] < 0]].sum() > 500


def test_blocks_are_pruned():
    """With short queries, blocks whose bound is too low are never scored."""
    b = bm25._Builder()
    for i in range(2000):
        b.add(i, "common common " + ("rare " * (9 if i == 1307 else 1) if i % 50 == 7 else "filler ") + f"own{i}")
    shard = bm25.Shard(b.row(), 4.0)
    counted, best = [0], {}
    shard.search_all([(0, [b"rare"], np.array([5.0]))], 1, best, counted)
    assert best[0][1].tolist() == [1307] and counted[0] <= 8  # of 40 postings


def test_pipeline(spark, odd_docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    for docs in (labelled(spark).selectExpr("*", "'s' as source", "cast(length(text) as long) as n_chars").union(odd_docs.select("doc_id", "text", "lang", "source", "n_chars")), no_docs.select("doc_id", "text", "lang", "source", "n_chars")):
        rows, columns = docs, docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = corpus_pipeline.materialize(stage(spark, rows, ""), "stage")
            assert rows.columns == columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, rows, "").collect()
        assert sum(p.length for p in pieces) > 0 or not rows.count()
        assert {p.doc_id for p in pieces} == {r.doc_id for r in rows.collect()}


def test_pipeline_of_files(spark, tmp_path):
    labelled(spark).selectExpr("*", "concat('s', doc_id % 3) as source", "cast(length(text) as long) as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("stage", ["language_id", "simhash_near_dedup", "mixing", "packing"])
def test_a_pipeline_stage_begins_with_the_heap_given_back(spark, odd_docs, monkeypatch, stage):
    garbage = spark.sparkContext._jvm.java.lang.ref.WeakReference("held by nothing else")
    # What the stage itself does is left out: the heap is collected as it begins.
    begun = dict(corpus_pipeline.STAGES)[stage]
    for module, name in ((corpus_pipeline.langid, "keep_identified"), (corpus_pipeline.simhash, "drop_near_duplicates"), (corpus_pipeline.mixing, "mixed_documents"), (corpus_pipeline.packing, "pack")):
        monkeypatch.setattr(module, name, lambda docs, *_: docs)
    assert garbage.get() is not None
    assert begun(spark, odd_docs, "") is odd_docs
    assert garbage.get() is None
