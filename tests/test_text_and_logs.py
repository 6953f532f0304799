import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import exact_match, normalize_answer, py_strip
from millrace.plans import summarize as cli
from millrace.sources.jsonl import summarize, summarize_jsonl, to_sorted_json

SPACES = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())


def run(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_strip_and_normalize_as_python(spark):
    texts = ["", " a ", SPACES + "x" + SPACES, "a" + SPACES + "b", "A\t\nB", "İ ẞ Σ", "a\n", "​a​", *(f"{c}a{c}b{c}" for c in SPACES)]
    assert run(spark, py_strip, *texts) == [t.strip() for t in texts]
    assert run(spark, normalize_answer, *texts) == [" ".join(t.strip().lower().split()) for t in texts]
    assert run(spark, normalize_answer, " A\t b ", None) == ["a b", None]


def test_exact_match(spark):
    match = lambda a, b: run(spark, lambda t: exact_match(t, F.lit(b)), a)[0]
    assert match("　A\n", "a") is True
    assert match("a  b", "a b") is False
    assert match(None, "a") is None


def log(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


@pytest.mark.parametrize("exact", [False, True])
def test_summary(spark, tmp_path, exact):
    path = tmp_path / "log.jsonl"
    path.write_text('{"dataset":"a","finish_reason":"stop"}\n\n  \n{"dataset":"a","finish_reason":"length","error":"x"}\nnot-json\n{"dataset":"b"}\n', encoding="utf-8")
    row = summarize_jsonl(spark, str(path), exact=exact).first().asDict()
    assert row == {"path": str(path), "rows": 4, "errors": 2, "finish_reason": {"length": 1, "stop": 1, "unknown": 1}, "datasets": {"a": 2, "b": 1}}


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize(
    ("error", "truth"),
    [("null", 0), ("false", 0), ("0", 0), ("0.0", 0), ('""', 0), ("[]", 0), ("{}", 0), ("true", 1), ("2", 1), ("0.5", 1), ('"0"', 1), ('"false"', 1), ("[0]", 1), ('{"a":0}', 1), ("1e300", 1)],
)
def test_error_truth(spark, error, truth, exact):
    row = summarize(log(spark, '{"error":%s,"dataset":null}' % error), exact=exact).first()
    assert (row.rows, row.errors) == (1, truth)
    assert row.datasets == {"None": 1} and row.finish_reason == {"unknown": 1}


@pytest.mark.parametrize("exact", [False, True])
def test_keys_and_non_objects(spark, exact):
    assert summarize(log(spark, '{"dataset":true}', '{"dataset":7}'), exact=exact).first().datasets == {"7": 1, "True": 1}
    with pytest.raises(Exception, match="not an object"):
        summarize(log(spark, "[1]"), exact=exact).collect()
    row = summarize(log(spark, "[1]", "{}"), exact=exact, on_non_object="count_error").first()
    assert (row.rows, row.errors, row.datasets) == (2, 1, {"unknown": 1})
    with pytest.raises(ValueError):
        summarize(log(spark, "{}"), on_non_object="skip")


def test_exact_differs_where_documented(spark):
    lines = log(spark, '{"dataset":1.0}', '{"dataset":"x"} y', '{"dataset":NaN}')
    assert summarize(lines, exact=True).first().datasets == {"1.0": 1, "nan": 1}
    assert summarize(log(spark, '{"dataset":[1, "a"]}'), exact=True).first().datasets == {"[1, 'a']": 1}


def test_empty_log(spark):
    row = summarize(log(spark).where("false")).first()
    assert (row.rows, row.errors, row.finish_reason, row.datasets) == (0, 0, {}, {})


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "log.jsonl"
    path.write_text('{"dataset":"z"}\n{"dataset":"a"}\n')
    cli.main([str(path)])
    said = capsys.readouterr().out
    assert json.loads(said)["datasets"] == {"a": 1, "z": 1}
    assert said.strip() == json.dumps(json.loads(said), indent=2, sort_keys=True)
    assert to_sorted_json(summarize_jsonl(spark, str(path))) == said.strip()
