"""Give the Python workers this package where their own path lacks it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def on_worker_path() -> bool:
    """Whether workers started from here find the package by PYTHONPATH or the working folder."""
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    return any(p and Path(p).resolve() == _ROOT for p in known)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors with Spark's own files, once for a context."""
    sc = spark.sparkContext
    if on_worker_path() or getattr(sc, "_millrace_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((_ROOT / "millrace").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(path))
    sc._millrace_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
