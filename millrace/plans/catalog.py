"""The query catalogue: every operator bound to the driver's tables, with its SQL.

The tables hold no logits or logs, so the bindings are stand-ins: pairs of embeddings
for student and teacher logits, conversation turns for tokens, events for log lines.
No result is a model's.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import WS, exact_match, normalize_answer
from ..operators.align import align_tokens
from ..operators.chunks import expand_chunk_weights_to_tokens, pool_token_scores_to_chunks
from ..operators.losses import EPS, dual_track_loss, kl_divergence_from_logits, masked_weighted_kl
from ..operators.weights import build_visual_anchor_weights, combine_weights, normalize_token_weights
from ..sources.jsonl import count_keys, non_blank, parse_lines, summarize, summarize_jsonl
from ..sources.metadata import env_report, git_state
from ..sources.records import build_manifest, count_runs, examples, identity_collate, keep_all, read_manifest, read_registry, responses
from .experiments import EXPERIMENTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Sample files of the scans, line by line; the queries write them where all executors can read.
_MANIFEST = (
    '{"id":"q-1","dataset":"shapes","image_path":"${DATA_ROOT}/images/q-1.jpg","question":"How many circles?","answer":"3"}',
    '{"id":"q-2","dataset":"shapes","question":"Which colour?","answer":null}',
    "",
)
_REGISTRY = (
    "experiment_id,name,status,git_commit,backend_commit,manifest_hash,summary_path,notes",
    "000,smoke,planned,,,,,First run",
    '007,anchor,done,abc123,def456,0011,out/007.json,"Two parts, one quote"',
)


def _sample(spark: SparkSession, name: str, lines: tuple[str, ...]) -> str:
    """The path of a folder with one file of these lines, in the shared folder or, on a local master, a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    path = f"{shared.rstrip('/')}/millrace-samples-{uuid.uuid4().hex}/{name}"
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(path)
    return path


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Token rows with logits ----------------------------------------------------

_PAIRS = """
pairs AS (
  SELECT s.vec_id // 2 AS pair, s.embedding AS student, t.embedding AS teacher
  FROM embeddings s JOIN embeddings t ON t.vec_id = s.vec_id + 1 WHERE s.vec_id % 2 = 0),
tok AS (
  SELECT pair // 8 AS batch_id, CAST(pair % 8 AS INTEGER) AS pos, student, teacher,
         CASE WHEN pair % 4 = 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS mask,
         CASE pair % 4 WHEN 3 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS soft_mask,
         (1 + pair % 5)::DOUBLE AS text_weight, (0.5 + pair % 3)::DOUBLE AS vision_weight,
         ((pair * 37) % 101)::DOUBLE AS score, CASE WHEN pair % 7 = 6 THEN -1 ELSE (pair % 8) // 2 END AS chunk_id
  FROM pairs)"""


def _kl_sql(t: float = 1.0) -> str:
    return f"""{_PAIRS},
el AS (SELECT batch_id, pos, unnest(student)::DOUBLE / {t!r}::DOUBLE AS s, unnest(teacher)::DOUBLE / {t!r}::DOUBLE AS t FROM tok),
top AS (SELECT batch_id, pos, max(s) AS ms, max(t) AS mt FROM el GROUP BY batch_id, pos),
lse AS (SELECT el.batch_id, el.pos, any_value(ms) + ln(sum(exp(s - ms))) AS zs, any_value(mt) + ln(sum(exp(t - mt))) AS zt
        FROM el JOIN top USING (batch_id, pos) GROUP BY el.batch_id, el.pos),
kl AS (SELECT el.batch_id, el.pos, {t * t!r}::DOUBLE * sum(exp(t - zt) * ((t - zt) - (s - zs))) AS kl
       FROM el JOIN lse USING (batch_id, pos) GROUP BY el.batch_id, el.pos),
k AS (SELECT tok.*, kl.kl FROM tok JOIN kl USING (batch_id, pos))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows: even vectors are student, the next odd ones teacher logits."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pair = F.expr("vec_id div 2")
    students = vectors.where("vec_id % 2 = 0").select(pair.alias("pair"), F.col("embedding").alias("student"))
    teachers = vectors.where("vec_id % 2 = 1").select(pair.alias("pair"), F.col("embedding").alias("teacher"))
    p = F.col("pair")
    return students.join(teachers, "pair").select(
        F.expr("pair div 8").alias("batch_id"),
        (p % 8).cast("int").alias("pos"),
        "student",
        "teacher",
        F.when(p % 4 == 3, 0.0).otherwise(1.0).alias("mask"),
        F.when(p % 4 == 3, 0.0).when(p % 4 == 1, 0.5).otherwise(1.0).alias("soft_mask"),
        (1 + p % 5).cast("double").alias("text_weight"),
        (F.lit(0.5) + p % 3).alias("vision_weight"),
        ((p * 37) % 101).cast("double").alias("score"),
        F.when(p % 7 == 6, -1).otherwise(F.expr("(pair % 8) div 2")).cast("long").alias("chunk_id"),
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _kl_rows(t: float = 1.0, engine: str = "native") -> Query:
    return lambda spark, d: _rounded(kl_divergence_from_logits(tokens(spark, d), temperature=t, engine=engine).select("batch_id", "pos", "kl"), "kl")


for _name, _t, _engine in (("kl_token", 1.0, "native"), ("kl_token_t2", 2.0, "native"), ("kl_token_arrow", 1.0, "arrow")):
    _add(_name, f"WITH {_kl_sql(_t)} SELECT batch_id, pos, round(kl, 6) AS kl FROM k")(_kl_rows(_t, _engine))
for _how, _agg in (("mean", "avg"), ("sum", "sum")):
    _add(f"kl_{_how}", f"WITH {_kl_sql()} SELECT round({_agg}(kl), 6) AS kl FROM k")(lambda spark, d, how=_how: _rounded(kl_divergence_from_logits(tokens(spark, d), reduction=how), "kl"))


@_add("aligned_tokens", f"WITH {_kl_sql()} SELECT batch_id, pos, text_weight, round(kl, 6) AS kl FROM k")
def aligned_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Logits and weights as two frames, aligned by position."""
    t = tokens(spark, d)
    aligned = align_tokens(t.select("batch_id", "pos", "student", "teacher"), t.select("batch_id", "pos", "text_weight"))
    return _rounded(kl_divergence_from_logits(aligned).select("batch_id", "pos", "text_weight", "kl"), "kl")


def _loss(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: _rounded(f(tokens(spark, d)), "loss")


def _loss_sql(top: str, bottom: str) -> str:
    return f"WITH {_kl_sql()} SELECT round({top} / {bottom}, 6) AS loss FROM k"


def _eff_sql(eff: str) -> str:
    return _loss_sql(f"sum(kl * ({eff}))", f"greatest(sum({eff}), {EPS!r})")


_add("wkl_norm", _eff_sql("soft_mask * text_weight"))(_loss(lambda t: masked_weighted_kl(t, mask="soft_mask", weights="text_weight")))
_add("wkl_mask_denom", _loss_sql("sum(kl * soft_mask * text_weight)", f"greatest(sum(soft_mask), {EPS!r})"))(_loss(lambda t: masked_weighted_kl(t, mask="soft_mask", weights="text_weight", normalize_weights=False)))
_add("wkl_numel_denom", _loss_sql("sum(kl * text_weight)", "count(*)"))(_loss(lambda t: masked_weighted_kl(t, weights="text_weight", normalize_weights=False)))
_add("wkl_by_batch", f"WITH {_kl_sql()} SELECT batch_id, round(sum(kl * mask * text_weight) / greatest(sum(mask * text_weight), {EPS!r}), 6) AS loss FROM k GROUP BY batch_id")(_loss(lambda t: masked_weighted_kl(t, mask="mask", weights="text_weight", group_cols=["batch_id"])))
_add("dual_none", _eff_sql("mask"))(_loss(lambda t: dual_track_loss(t, mask="mask", alpha_text=3.0)))
_add("dual_text", _eff_sql("mask * text_weight"))(_loss(lambda t: dual_track_loss(t, text_weights="text_weight", mask="mask")))
_add("dual_vision", _eff_sql("mask * vision_weight"))(_loss(lambda t: dual_track_loss(t, vision_weights="vision_weight", mask="mask")))
_BOTH = "(text_weight + 0.5 * vision_weight)"
_add("dual_both", _eff_sql(f"mask * {_BOTH}"))(_loss(lambda t: dual_track_loss(t, text_weights="text_weight", vision_weights="vision_weight", mask="mask", alpha_vision=0.5)))
_add("dual_both_fractional_mask", _eff_sql(f"soft_mask * soft_mask * {_BOTH}"))(_loss(lambda t: dual_track_loss(t, text_weights="text_weight", vision_weights="vision_weight", mask="soft_mask", alpha_vision=0.5)))

_add("exp_000", _eff_sql(f"mask * {_BOTH}"))(_loss(EXPERIMENTS["000"]))
_add("exp_010", _eff_sql("mask"))(_loss(EXPERIMENTS["010"]))
_add("exp_030", _eff_sql("mask * (text_weight + vision_weight)"))(_loss(EXPERIMENTS["030"]))
_add(
    "exp_020",
    f"""WITH {_kl_sql()},
ranked AS (SELECT *, row_number() OVER (PARTITION BY batch_id, mask <> 0 ORDER BY score DESC, pos) AS rn, count(*) OVER (PARTITION BY batch_id, mask <> 0) AS n FROM k),
w AS (SELECT *, CASE WHEN mask = 0 THEN 0.0 WHEN rn <= greatest(1, ceil(n * CAST(0.1 AS DOUBLE))) THEN 2.0 ELSE 1.0 END::DOUBLE AS v FROM ranked)
SELECT round(sum(kl * mask * mask * v) / greatest(sum(mask * mask * v), {EPS!r}), 6) AS loss FROM w""",
)(_loss(EXPERIMENTS["020"]))
_add(
    "exp_040",
    f"""WITH {_kl_sql()},
pooled AS (SELECT batch_id, chunk_id, avg(score) AS s FROM k WHERE chunk_id >= 0 GROUP BY batch_id, chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY CAST(s AS FLOAT) DESC, chunk_id) AS rn, count(*) OVER (PARTITION BY batch_id) AS n FROM pooled),
cw AS (SELECT batch_id, chunk_id, CASE WHEN rn <= greatest(1, ceil(n * CAST(0.1 AS DOUBLE))) THEN 2.0 ELSE 1.0 END::DOUBLE AS v FROM ranked),
w AS (SELECT k.*, coalesce(cw.v, 0.0) AS v FROM k LEFT JOIN cw USING (batch_id, chunk_id))
SELECT round(sum(kl * mask * mask * v) / greatest(sum(mask * mask * v), {EPS!r}), 6) AS loss FROM w""",
)(_loss(EXPERIMENTS["040"]))

# Conversation turns as tokens ----------------------------------------------

_TURNS = """turns AS (
  SELECT conv_id AS batch_id, CAST(turn AS INTEGER) AS pos, length(text)::DOUBLE AS score, length(text)::DOUBLE AS weight,
         CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END::DOUBLE AS mask, CASE WHEN role = 'system' THEN -1 ELSE turn // 2 END AS chunk_id
  FROM conversations)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text").cast("double")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("batch_id"),
        F.col("turn").cast("int").alias("pos"),
        size.alias("score"),
        size.alias("weight"),
        F.when(F.col("role") == "assistant", 1.0).otherwise(0.0).alias("mask"),
        F.when(F.col("role") == "system", -1).otherwise(F.expr("turn div 2")).cast("long").alias("chunk_id"),
    )


@_add("weights_normalized", f"""WITH {_TURNS}, s AS (SELECT *, sum(mask) OVER (PARTITION BY batch_id) AS n, sum(weight * mask) OVER (PARTITION BY batch_id) AS total FROM turns)
SELECT batch_id, pos, round(CASE WHEN n > 0 THEN weight * mask * (n / greatest(total, 1e-8)) ELSE 0.0 END, 6) AS weight_norm FROM s""")  # fmt: skip
def weights_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(normalize_token_weights(turns(spark, d), mask="mask").select("batch_id", "pos", "weight_norm"), "weight_norm")


for _mode, _op in (("sum", "+"), ("product", "*")):
    _add(f"weights_{_mode}", f"WITH {_TURNS} SELECT batch_id, pos, (weight {_op} (pos + 1)) * mask AS combined FROM turns")(
        lambda spark, d, mode=_mode: turns(spark, d).select("batch_id", "pos", combine_weights("weight", None, F.col("pos") + 1, mode=mode, mask="mask").alias("combined"))
    )


def _anchor(ratio: float, mask: str | None) -> Query:
    return lambda spark, d: build_visual_anchor_weights(turns(spark, d), mask=mask, topk_ratio=ratio).select("batch_id", "pos", "anchor_weight")


for _name, _ratio, _mask in (("anchor_topk_10", 0.1, None), ("anchor_topk_50", 0.5, None), ("anchor_topk_07", 0.07, None), ("anchor_topk_masked", 0.5, "mask")):
    _valid = "mask <> 0" if _mask else "true"
    _add(_name, f"""WITH {_TURNS}, r AS (SELECT *, {_valid} AS valid, row_number() OVER (PARTITION BY batch_id, {_valid} ORDER BY CAST(score AS FLOAT) DESC, pos) AS rn, count(*) OVER (PARTITION BY batch_id, {_valid}) AS n FROM turns)
SELECT batch_id, pos, CASE WHEN NOT valid THEN 0.0 WHEN rn <= greatest(1, ceil(n * CAST({_ratio} AS DOUBLE))) THEN 2.0 ELSE 1.0 END::DOUBLE AS anchor_weight FROM r""")(_anchor(_ratio, _mask))  # fmt: skip

for _how, _agg in (("mean", "avg"), ("max", "max")):
    _add(f"pool_{_how}", f"""WITH {_TURNS}, p AS (SELECT batch_id, chunk_id, {_agg}(score) AS v FROM turns WHERE chunk_id >= 0 GROUP BY batch_id, chunk_id),
w AS (SELECT max(chunk_id) AS last FROM turns), g AS (SELECT batch_id, unnest(generate_series(0, last)) AS chunk_id FROM (SELECT DISTINCT batch_id FROM turns), w WHERE last >= 0)
SELECT g.batch_id, g.chunk_id, round(coalesce(v, 0.0), 6) AS chunk_score FROM g LEFT JOIN p USING (batch_id, chunk_id)""")(  # fmt: skip
        lambda spark, d, how=_how: _rounded(pool_token_scores_to_chunks(turns(spark, d), reduce=how), "chunk_score")
    )


@_add("expand_chunks", f"""WITH {_TURNS}, c AS (SELECT DISTINCT batch_id, chunk_id, (chunk_id + 1.5)::DOUBLE AS w FROM turns WHERE chunk_id IN (0, 1))
SELECT batch_id, pos, coalesce(w, 0.0) AS token_weight FROM turns LEFT JOIN c USING (batch_id, chunk_id)""")  # fmt: skip
def expand_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Only the first two chunks have weights, so later ids are out of range."""
    rows = turns(spark, d)
    chunks = rows.where(F.col("chunk_id").isin(0, 1)).select("batch_id", "chunk_id").distinct().withColumn("weight", (F.col("chunk_id") + 1.5).cast("double"))
    return expand_chunk_weights_to_tokens(rows, chunks).select("batch_id", "pos", "token_weight")


# Texts -----------------------------------------------------------------------

_NORMAL = rf"regexp_replace(lower(regexp_replace(text, '\A{WS}+|{WS}+\z', '', 'g')), '{WS}+', ' ', 'g')"


@_add("normalize_docs", f"SELECT doc_id, length({_NORMAL}) AS n, md5({_NORMAL}) AS digest FROM documents")
def normalize_docs(spark: SparkSession, d: str) -> DataFrame:
    normal = normalize_answer("text")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.length(normal).cast("long").alias("n"), F.md5(normal).alias("digest"))


@_add("exact_match_docs", "SELECT doc_id, (doc_id % 3 <> 0) AS matched FROM documents")
def exact_match_docs(spark: SparkSession, d: str) -> DataFrame:
    """Texts against themselves in lower case between wide spaces; every third has a word more."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    answer = F.concat(F.lit("　"), F.lower("text"), F.when(F.col("doc_id") % 3 == 0, " x").otherwise(""), F.lit("\t\n"))
    return docs.select("doc_id", exact_match(F.col("text"), answer).alias("matched"))


# Logs -------------------------------------------------------------------------

_LINE = """CASE WHEN event_id % 13 = 5 THEN '   '
       WHEN event_id % 11 = 3 THEN 'not-json'
       ELSE '{"dataset": "' || event_type || '"' ||
            CASE event_id % 7 WHEN 0 THEN ', "finish_reason": null' WHEN 1 THEN ', "finish_reason": true' WHEN 2 THEN '' ELSE ', "finish_reason": "stop"' END ||
            CASE event_id % 6 WHEN 0 THEN ', "error": "timeout"' WHEN 1 THEN ', "error": 0' WHEN 2 THEN ', "error": []' WHEN 3 THEN ', "error": "false"' WHEN 4 THEN ', "error": null' ELSE '' END || '}' END"""

_PARSED = f"""WITH lines AS (SELECT trim({_LINE}) AS v FROM events), kept AS (SELECT v, json_valid(v) AS ok FROM lines WHERE v <> ''),
parsed AS (SELECT ok, CASE WHEN ok THEN v END::JSON AS j FROM kept),
fields AS (SELECT ok,
  CASE WHEN NOT ok THEN NULL WHEN json_type(j, '$.finish_reason') IS NULL THEN 'unknown' WHEN json_type(j, '$.finish_reason') = 'NULL' THEN 'None'
       WHEN json_type(j, '$.finish_reason') = 'BOOLEAN' THEN 'True' ELSE json_extract_string(j, '$.finish_reason') END AS finish_reason,
  CASE WHEN NOT ok THEN NULL ELSE json_extract_string(j, '$.dataset') END AS dataset,
  CASE WHEN NOT ok THEN true WHEN json_type(j, '$.error') = 'VARCHAR' THEN json_extract_string(j, '$.error') <> '' ELSE false END AS error
  FROM parsed)"""


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.expr(_LINE).alias("value"))


@_add("jsonl_counts", f"""{_PARSED} SELECT kind, key, count(*) AS n FROM (
  SELECT 'finish_reason' AS kind, finish_reason AS key FROM fields WHERE ok UNION ALL SELECT 'datasets', dataset FROM fields WHERE ok) GROUP BY kind, key""")  # fmt: skip
def jsonl_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_keys(parse_lines(non_blank(log_lines(spark, d))))


_SUMMARY_SQL = f"""{_PARSED} SELECT count(*) AS rows, count(*) FILTER (error) AS errors,
  (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT finish_reason AS k, count(*) AS n FROM fields WHERE ok GROUP BY 1)) AS finish_reason,
  (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT dataset AS k, count(*) AS n FROM fields WHERE ok GROUP BY 1)) AS datasets FROM fields"""


def _flat(df: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return df.select("rows", "errors", text("finish_reason").alias("finish_reason"), text("datasets").alias("datasets"))


_add("jsonl_summary", _SUMMARY_SQL)(lambda spark, d: _flat(summarize(log_lines(spark, d))))
_add("jsonl_summary_exact", _SUMMARY_SQL)(lambda spark, d: _flat(summarize(log_lines(spark, d), exact=True)))

# Records and metadata ----------------------------------------------------------

_add("runs_count", "SELECT count(*) AS runs FROM events")(lambda spark, d: count_runs(spark.read.parquet(f"{d}/events.parquet")))
_add("keep_all", "SELECT event_id, event_type FROM events")(lambda spark, d: identity_collate(keep_all(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type"))))
_add("responses", "SELECT text, CASE WHEN turn % 2 = 0 THEN 'stop' ELSE 'unknown' END AS finish_reason, CAST(NULL AS VARCHAR) AS error FROM conversations")(
    lambda spark, d: responses(spark.read.parquet(f"{d}/conversations.parquet").select("text", F.when(F.col("turn") % 2 == 0, "stop").alias("finish_reason"), F.lit(None).cast("string").alias("error")))
)
_RECORDS = "SELECT * FROM (VALUES ('q-1', 'shapes', '${DATA_ROOT}/images/q-1.jpg', 'How many circles?', '3'), ('q-2', 'shapes', NULL, 'Which colour?', NULL)) v(id, dataset, image_path, question, answer)"
_RUNS = "SELECT * FROM (VALUES ('000', 'smoke', 'planned', NULL, NULL, NULL, NULL, 'First run'), ('007', 'anchor', 'done', 'abc123', 'def456', '0011', 'out/007.json', 'Two parts, one quote')) v(experiment_id, name, status, git_commit, backend_commit, manifest_hash, summary_path, notes)"
_add("registry_scan", _RUNS)(lambda spark, d: read_registry(spark, _sample(spark, "registry.csv", _REGISTRY)))
_add("manifest_scan", _RECORDS)(lambda spark, d: read_manifest(spark, _sample(spark, "manifest.jsonl", _MANIFEST)))
_add("manifest_examples", f"SELECT dataset, question, image_path, answer FROM ({_RECORDS})")(lambda spark, d: examples(read_manifest(spark, _sample(spark, "manifest.jsonl", _MANIFEST))))
_add("manifest_build", f"{_RECORDS} WHERE false")(lambda spark, d: build_manifest(spark))
# Of the host's own values only their form is the same everywhere.
_add("env_report", "SELECT true AS python, true AS hostname, true AS platform, true AS torch, true AS cuda_available, true AS spark")(
    lambda spark, d: env_report(spark).select(
        F.col("python").rlike(r"^3\.\d+\.").alias("python"), (F.length("hostname") > 0).alias("hostname"), (F.length("platform") > 0).alias("platform"),
        F.col("torch").rlike(r"^(not_installed|\d+\.)").alias("torch"), F.col("cuda_available").isNotNull().alias("cuda_available"), (F.col("spark") == spark.version).alias("spark"),
    )
)
_add("git_state", "SELECT true AS commit, true AS branch, true AS dirty")(
    lambda spark, d: git_state(spark).select(
        F.col("commit").rlike("^([0-9a-f]{40}|unknown)$").alias("commit"), (F.length("branch") > 0).alias("branch"), (F.col("dirty").isNotNull() | F.expr("'unknown' IN (commit, branch)")).alias("dirty")
    )
)

_LOG = ('{"dataset":"a","finish_reason":"stop"}', "", '{"dataset":"a","finish_reason":"length","error":"timeout"}', '{"dataset":"b"}', "not-json")
_add("jsonl_file_summary", "SELECT 4 AS rows, 2 AS errors, 'length=1,stop=1,unknown=1' AS finish_reason, 'a=2,b=1' AS datasets")(lambda spark, d: _flat(summarize_jsonl(spark, _sample(spark, "log.jsonl", _LOG))))
