"""Language identification with spans.

Each word is scored for every language by its character n-grams; ranges of code
points give a word's script, and only languages written in that script are
candidates for it. Viterbi over the words, with a penalty for every switch, labels
the spans of a text in several languages. A text's language is the one with most
letters.

The classifier is fitted on a bounded sample of labelled rows (TRAIN_ROWS, dealt
evenly to the languages) and is of bounded size: a row of languages for each of
BUCKETS hashed n-grams, of fewer if there are very many languages. It is all that
is broadcast. Texts are labelled a bounded number of cells (words times languages)
at a time; a longer one goes through the recursion in segments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import claim

#: Labelled rows that the classifier is fitted on, at most (in expectation).
TRAIN_ROWS = 6000
#: Hashed n-grams and their lengths. More languages than FULL_LANGS share fewer buckets.
BUCKETS, ORDERS, FULL_LANGS = 1 << 16, (1, 2, 3, 4), 200
#: Characters whose n-grams are held at a time, cells that are labelled at a time, and
#: cells of a long text's segment.
_NGRAM_CHARS, _CELLS, _SEGMENT = 200_000, 1_000_000, 1 << 17
SWITCH_PENALTY = 12.0
UNDETERMINED = "und"

#: First code points of script ranges, in order, and their scripts.
#: Code points before the first range, and those in a range called "", are neutral.
SCRIPT_STARTS = (0x41, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB1D, 0xFB50, 0xFE00, 0xFE70, 0xFF00, 0xFF66, 0xFFA0, 0x10000, 0x20000, 0x32000)
SCRIPTS = ("latin", "", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "", "thai", "", "georgian", "hangul", "", "latin", "greek", "", "kana", "", "han", "", "hangul", "", "han", "latin", "hebrew", "arabic", "", "arabic", "latin", "kana", "hangul", "", "han", "")
_STARTS = np.array(SCRIPT_STARTS)
_NAMES = sorted(set(SCRIPTS))
_CODES = np.array([_NAMES.index("")] + [_NAMES.index(s) for s in SCRIPTS])

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none if the text has no letter."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if found and not any(w.isalpha() for w in found):  # numerals such as superscripts only
        found = [w for w in found if any(c.isalpha() for c in w)]
    return found


def scripts_of(words: list[str]) -> np.ndarray:
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _CODES[np.searchsorted(_STARTS, first, side="right")]


def ngram_buckets(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, index of the word) for all n-grams of ``^word$``, some characters at a time."""
    text = "".join(f"\1{w}\2" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    for at in range(0, len(codes), _NGRAM_CHARS):
        # N-grams that begin here may end in the next part.
        some, own = codes[at : at + _NGRAM_CHARS + max(ORDERS) - 1].astype(np.uint64), owner[at : at + _NGRAM_CHARS + max(ORDERS) - 1]
        buckets, owners, h = [], [], np.zeros(len(some), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            # h[i] becomes the hash of the n characters from i on.
            h = h[: len(some) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + some[n - 1 :] + np.uint64(n)
            if n in ORDERS and len(h):
                mine = h[:_NGRAM_CHARS]
                inside = own[: len(mine)] == own[n - 1 : n - 1 + len(mine)]
                mixed = (mine[inside] ^ (mine[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                buckets.append((mixed >> np.uint64(48)).astype(np.int64))
                owners.append(own[: len(mine)][inside])
        yield np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # [buckets, languages], centred log probabilities
    allowed: np.ndarray  # [scripts, languages]

    def score(self, words: list[str]) -> np.ndarray:
        """[words, languages]: evidence of each word."""
        out = np.zeros((len(words), len(self.langs)))
        for buckets, owner in ngram_buckets(words):
            first = int(owner[0])
            to, buckets = owner - first, buckets % len(self.table)
            for i in range(len(self.langs)):
                got = np.bincount(to, weights=self.table[buckets, i])
                out[first : first + len(got), i] += got
        out /= len(ORDERS)
        ok = self.allowed[scripts_of(words)]
        out[~ok] = -50.0
        out[~ok.any(axis=1)] = 0.0  # a script that no language is written in leaves all as likely
        return out


def is_held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def _quotas(counts: dict[str, int], rows: int) -> dict[str, float]:
    """Rows to learn from for each language: an even share; what some lack goes to the others."""
    left, out = float(rows), {}
    order = sorted(counts, key=lambda x: (counts[x], x))
    for i, lang in enumerate(order):
        out[lang] = min(counts[lang], max(1.0, left / (len(order) - i)))
        left -= out[lang]
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled rows that are not held out: all of them, or about ``rows`` picked by a hash,
    as many of each language as far as there are.

    Rows without text, label or id are not learned from. No usable rows give a
    model without languages, for which every text is undetermined.
    """
    own = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    own = own.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) > rows:
        spark = docs.sparkSession
        least = [(lang, int((1 << 30) * quota / counts[lang])) for lang, quota in _quotas(counts, rows).items()]
        shares = spark.createDataFrame(least, "lang string, least long").coalesce(1)  # a row for each language
        own = own.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64(F.col("id"), F.lit("fit")), F.lit(1 << 30)) < F.col("least"))
    size = BUCKETS
    while size > 256 and size * len(counts) > BUCKETS * FULL_LANGS:
        size //= 2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, some in b.groupby("lang")["text"]:
                found: Counter[str] = Counter()
                for text in some:
                    found.update(words_of(text))
                if not found:
                    continue
                words, n = list(found), np.fromiter(found.values(), np.float64, len(found))
                sums = np.zeros(size)
                for buckets, owner in ngram_buckets(words):
                    sums += np.bincount(buckets % size, weights=n[owner], minlength=size)
                written = np.bincount(scripts_of(words), weights=n, minlength=len(_NAMES))
                key = np.concatenate([np.flatnonzero(sums), -1 - np.flatnonzero(written)])
                yield pd.DataFrame({"lang": lang, "k": key, "n": np.concatenate([sums[sums > 0], written[written > 0]])})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        k, n = pdf["k"].to_numpy(np.int64), pdf["n"].to_numpy()
        sums, written = np.zeros(size), np.zeros(len(_NAMES))
        sums[k[k >= 0]], written[-1 - k[k < 0]] = n[k >= 0], n[k < 0]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "sums": [sums.tobytes()], "written": [written.tobytes()]})

    parts = own.select("lang", "text").mapInPandas(count, "lang string, k long, n double")
    # One array for each language: BUCKETS * FULL_LANGS numbers in all, or 256 a language.
    sums = parts.groupBy("lang", "k").agg(F.sum("n").alias("n")).groupBy("lang").applyInPandas(pack, "lang string, sums binary, written binary").collect()
    sums.sort(key=lambda r: r["lang"])
    if not sums:
        return Model([], np.zeros((size, 0)), np.zeros((len(_NAMES), 0), bool))
    table = np.stack([np.frombuffer(r["sums"]) for r in sums], axis=1) + 0.5
    written = np.stack([np.frombuffer(r["written"]) for r in sums], axis=1)
    logs = np.log(table / table.sum(axis=0))
    share = written / np.maximum(written.sum(axis=0), 1)
    return Model([r["lang"] for r in sums], logs - logs.mean(axis=1, keepdims=True), share >= 0.005)


def viterbi(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of each row of ``scores`` [words, languages]; of equals the lowest."""
    return viterbi_batch([scores], penalty)[0]


def viterbi_batch(many: list[np.ndarray], penalty: float = SWITCH_PENALTY) -> list[np.ndarray]:
    """``viterbi`` of several texts."""
    ends = np.cumsum([len(s) for s in many])
    return viterbi_texts(np.concatenate(many), [np.arange(e - len(s), e) for s, e in zip(many, ends, strict=True)], penalty)


def viterbi_texts(scores: np.ndarray, rows: list[np.ndarray], penalty: float = SWITCH_PENALTY) -> list[np.ndarray]:
    """``viterbi`` of several texts, given as rows of ``scores``, a step of all of them at a time.

    Any path but a constant one pays the penalty once at least. If all words' best
    scores together exceed the best constant label's by no more than that, the
    constant path is the answer; only other texts go through the recursion. It holds
    _CELLS cells at most; a text with more goes through it by itself, in segments.
    """
    out: list[np.ndarray | None] = [None] * len(rows)
    rest, langs = [], scores.shape[1]
    every = np.arange(langs)
    for i, r in enumerate(rows):
        sums, most = np.zeros(langs), 0.0
        for at in range(0, len(r), 1 << 14):
            s = scores[r[at : at + (1 << 14)]]
            sums += s.sum(axis=0)
            most += s.max(axis=1).sum()
        best = int(sums.argmax())
        if most - sums[best] <= penalty:
            out[i] = np.full(len(r), best, np.int16)
        else:
            rest.append(i)
    rest.sort(key=lambda i: -len(rows[i]))  # similar lengths together
    while rest:
        steps = len(rows[rest[0]])
        if steps * langs > _CELLS:
            i = rest.pop(0)
            out[i] = _viterbi_long(scores, rows[i], penalty)
            continue
        width = max(1, min(64, _CELLS // (steps * langs)))
        some, rest = rest[:width], rest[width:]
        lengths = np.array([len(rows[i]) for i in some])
        padded = np.zeros((steps, len(some), langs))
        for j, i in enumerate(some):
            padded[: lengths[j], j] = scores[rows[i]]
        back = np.zeros((steps, len(some), langs), np.int16)
        v = padded[0].copy()
        last = v.copy()
        for t in range(1, steps):
            live = int((lengths > t).sum())  # longest first
            now = v[:live]
            top = now.argmax(axis=1)[:, None]
            jump = np.take_along_axis(now, top, 1) - penalty
            stay = now >= jump
            back[t, :live] = np.where(stay, every, top)
            v[:live] = np.where(stay, now, jump) + padded[t, :live]
            last[:live] = v[:live]
        label = last.argmax(axis=1)
        paths = np.zeros((steps, len(some)), np.int16)
        for t in range(steps - 1, -1, -1):
            live = int((lengths > t).sum())
            paths[t, :live] = label[:live]
            label[:live] = back[t, np.arange(live), label[:live]]
        for j, i in enumerate(some):
            out[i] = paths[: lengths[j], j]
    return out


def _viterbi_long(scores: np.ndarray, r: np.ndarray, penalty: float) -> np.ndarray:
    """The same for one text, in segments: first only the scores before each segment are
    kept; then, from the last segment to the first, each is run again for its way back."""
    langs = scores.shape[1]
    every, size = np.arange(langs), max(1, _SEGMENT // langs)

    def run(at: int, v: np.ndarray | None, back: np.ndarray | None) -> np.ndarray:
        for t, s in enumerate(scores[r[at : at + size]]):
            if v is None:
                v = s.copy()
                continue
            top = int(v.argmax())
            jump = v[top] - penalty
            stay = v >= jump
            if back is not None:
                back[t] = np.where(stay, every, top)
            v = np.where(stay, v, jump) + s
        return v

    before: list[np.ndarray | None] = []
    v = None
    for at in range(0, len(r), size):
        before.append(v)
        v = run(at, v, None)
    label, path = int(v.argmax()), np.zeros(len(r), np.int16)
    for k in range(len(before) - 1, -1, -1):
        some = path[k * size : (k + 1) * size]
        back = np.zeros((len(some), langs), np.int16)
        run(k * size, before[k], back)
        for t in range(len(some) - 1, -1, -1):
            some[t] = label
            label = int(back[t, label])
    return path


def label_texts(texts: list[str | None], model: Model, penalty: float = SWITCH_PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, its share of letters, spans) of each text; a span is (first word, words, language)."""
    return [x[:3] for x in _labelled(texts, model, penalty)]


def _labelled(texts: list[str | None], model: Model, penalty: float) -> list[tuple[str, float, list[tuple[int, int, str]], float]]:
    """The same with the evidence for the labels: the words' scores for them together."""
    split = [words_of(t) for t in texts]
    index: dict[str, int] = {}
    rows = [np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int32, len(ws)) for ws in split]
    none = (UNDETERMINED, 0.0, [], 0.0)
    if not index or not model.langs:
        return [none] * len(texts)
    scores = model.score(list(index))
    sizes = np.fromiter(map(len, index), np.int64, len(index))
    live = [i for i, r in enumerate(rows) if len(r)]
    paths = dict(zip(live, viterbi_texts(scores, [rows[i] for i in live], penalty), strict=True))
    out = []
    for i, r in enumerate(rows):
        if not len(r):
            out.append(none)
            continue
        path = paths[i]
        letters = np.bincount(path, weights=sizes[r], minlength=len(model.langs))
        best = int(letters.argmax())
        edges = np.flatnonzero(np.diff(path, prepend=np.int16(-1)))
        spans = [(int(a), int(b - a), model.langs[path[a]]) for a, b in zip(edges, [*edges[1:], len(path)], strict=True)]
        out.append((model.langs[best], float(letters[best] / letters.sum()), spans, float(scores[r, path].sum())))
    return out


#: Texts and characters that are labelled at a time (of few languages; of many fewer).
_TEXTS, _CHARS = 512, 2_000_000


def _runs(sizes: list[int], langs: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded number and length; a longer text is a run of its own."""
    at, most = 0, _CHARS * 8 // max(8, langs)
    while at < len(sizes):
        to, size = at, 0
        while to < len(sizes) and to - at < _TEXTS and (to == at or size + sizes[to] <= most):
            size += sizes[to]
            to += 1
        yield at, to
        at = to


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, keep: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score, spans) for every row, or the columns ``keep`` in the id's place.

    lang_pred is "und", with score 0 and no spans, for a null text or one without a
    letter; otherwise a learned language, and score is its share of the text's
    letters. Of equals the language first by code point; among labels of one word, and
    paths, too. Repeated rows stay and are labelled alike. Whole texts are labelled
    however long they are, in bounded memory beside the text's words. There is no
    shuffle.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    keep = [id_col] if keep is None else keep
    fields = ", ".join(f"`{c}` string" for c in keep)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b.pop("__mr_text"))
            for at, to in _runs([len(t or "") for t in texts], len(known.value.langs)):
                some = label_texts(texts[at:to], known.value, penalty)
                yield b.iloc[at:to].assign(__mr_lang=[x[0] for x in some], __mr_score=[x[1] for x in some], __mr_spans=[[dict(zip(("word", "words", "lang"), s, strict=True)) for s in x[2]] for x in some])

    src = docs.select(*[F.col(f"`{c}`").cast("string") for c in keep], F.col(text_col).alias("__mr_text"))
    out = src.mapInPandas(label, f"{fields}, __mr_lang string, __mr_score double, __mr_spans array<struct<word:int,words:int,lang:string>>")
    return out.select(*[F.col(f"`{c}`").cast(docs.schema[c].dataType) for c in keep], F.col("__mr_lang").alias("lang_pred"), F.col("__mr_score").alias("score"), F.col("__mr_spans").alias("spans"))


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The rows of ``docs`` with a language: texts that are undetermined go, and those in
    whose words nothing speaks for their labels, such as texts in scripts that were not
    learned. A text in several languages stays. With fewer than two languages there is
    no evidence, and only undetermined texts go. Columns stay as they are."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    known = docs.sparkSession.sparkContext.broadcast(model)
    single = len(model.langs) < 2

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        # Whole rows pass through as they are; nothing is queued for them in the JVM.
        for b in batches:
            texts = b.column(text_col).to_pylist()
            for at, to in _runs([len(t or "") for t in texts], len(known.value.langs)):
                keep = [x[0] != UNDETERMINED and (single or x[3] > 0) for x in _labelled(texts[at:to], known.value, penalty)]
                yield b.slice(at, to - at).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
