import logging
import subprocess
from pathlib import Path

import pytest

from millrace import __version__
from millrace.plans import serving
from millrace.sources import metadata, records
from millrace.streaming.logs import for_each_batch, stream_counts

FIXTURES = Path(__file__).parent / "fixtures"


def test_registry_keeps_ids(spark):
    rows = records.read_registry(spark, str(FIXTURES / "registry.csv")).collect()
    assert [r.experiment_id for r in rows] == ["000", "007"]
    assert rows[1].notes == "Two parts, one quote" and rows[0].git_commit is None


def test_manifest(spark):
    df = records.read_manifest(spark, str(FIXTURES))
    assert df.columns == ["id", "dataset", "image_path", "question", "answer"]
    rows = {r.id: r for r in records.expand_paths(df, {"DATA_ROOT": "/d"}).collect()}
    assert rows["q-1"].image_path == "/d/images/q-1.jpg" and rows["q-2"].image_path is None
    assert records.examples(df).columns == ["dataset", "question", "image_path", "answer"]
    assert records.build_manifest(spark).count() == 0
    assert records.count_runs(df).first().runs == 2
    assert records.identity_collate(records.keep_all(df)).count() == 2


def test_responses_and_runs(spark, tmp_path):
    df = spark.createDataFrame([("a", None, None), ("b", "stop", "e")], "text string, finish_reason string, error string")
    assert [r.finish_reason for r in records.responses(df).orderBy("text").collect()] == ["unknown", "stop"]
    assert records.Response("x").finish_reason == "unknown" and records.Example("d", "q").answer is None
    run = spark.createDataFrame([("c", "main", None, "", "cfg", "h", "", "", {"loss": 0.5}, "")], records.RUN)
    for _ in range(2):
        records.append_run(run, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_paths_and_configs(monkeypatch, tmp_path):
    monkeypatch.setenv("SOME_ROOT", "~/x")
    assert records.env_path("SOME_ROOT") == Path("~/x").expanduser()
    assert records.env_path("NO_SUCH_NAME", "/y") == Path("/y")
    with pytest.raises(KeyError, match="NO_SUCH_NAME"):
        records.env_path("NO_SUCH_NAME")
    assert records.expand_env({"a": ["${R}/b", 1]}, {"R": "/r"}) == {"a": ["/r/b", 1]}
    with pytest.raises(KeyError):
        records.expand_env("${NO}", {})
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("paths:\n  root: ${R}\n")
    assert records.load_config(tmp_path / "c.yaml", {"R": "/r"}) == {"paths": {"root": "/r"}}


def test_metadata(spark, tmp_path):
    report = metadata.env_report(spark).first()
    assert report.spark == spark.version and report.python
    assert metadata.get_git_state(tmp_path) == {"commit": "unknown", "branch": "unknown", "dirty": "unknown"}
    assert metadata.git_state(spark, tmp_path).first().dirty is None
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-b", "trunk")
    git("commit", "--allow-empty", "-m", "x")
    state = metadata.get_git_state(tmp_path)
    assert len(state["commit"]) == 40 and state["branch"] == "trunk" and state["dirty"] is False
    (tmp_path / "f").write_text("x")
    assert metadata.get_git_state(tmp_path)["dirty"] is True
    assert isinstance(metadata.get_logger("x"), logging.Logger)
    metadata.seed_python(1)


def test_entry_points():
    assert serving.build_vllm_command("m", 9) == ["vllm", "serve", "m", "--port", "9"]
    assert serving.InferenceClient("http://x").base_url == "http://x"
    assert __version__ == "0.1.0"


def test_streaming(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text('{"dataset":"a"}\n{"dataset":"a","finish_reason":"stop"}\nbad\n')
    q = stream_counts(spark, str(logs)).writeStream.outputMode("complete").format("memory").queryName("log_counts").start()
    q.processAllAvailable()
    (logs / "b.jsonl").write_text('{"dataset":"a"}\n')
    q.processAllAvailable()
    q.stop()
    got = {(r.finish_reason, r.dataset, r.malformed): r.n for r in spark.table("log_counts").collect()}
    assert got == {("unknown", "a", False): 2, ("stop", "a", False): 1, (None, None, True): 1}
    seen = []
    w = for_each_batch(spark.readStream.text(str(logs)), lambda b: b.where("value like '%stop%'"), lambda b, n: seen.append(b.count()))
    q = w.option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 1
