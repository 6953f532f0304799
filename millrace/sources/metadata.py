"""Where and from what a run was made: environment and Git state as one-row frames."""

from __future__ import annotations

import importlib
import logging
import platform
import random
import socket
import subprocess
import sys
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession

ENV = "python string, python_executable string, hostname string, platform string, torch string, cuda_available boolean, spark string"
GIT = "commit string, branch string, dirty boolean"


def get_env_report() -> dict[str, object]:
    """Versions and host; torch is ``not_installed`` and cuda false where it cannot be imported."""
    torch, cuda = "not_installed", False
    try:
        found = importlib.import_module("torch")
        torch, cuda = found.__version__, bool(found.cuda.is_available())
    except Exception:
        pass
    return {"python": sys.version, "python_executable": sys.executable, "hostname": socket.gethostname(), "platform": platform.platform(), "torch": torch, "cuda_available": cuda, "spark": pyspark.__version__}


def get_git_state(cwd: str | Path | None = None) -> dict[str, str | bool]:
    """Commit, branch and whether there are changes; what cannot be found is ``unknown``."""
    state: dict[str, str | bool] = dict.fromkeys(("commit", "branch", "dirty"), "unknown")
    asked = {"commit": ("rev-parse", "HEAD"), "branch": ("rev-parse", "--abbrev-ref", "HEAD"), "dirty": ("status", "--porcelain")}
    for key, args in asked.items():
        try:
            said = subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, check=True).stdout.strip()
        except Exception:
            break
        state[key] = bool(said) if key == "dirty" else said
    return state


def env_report(spark: SparkSession) -> DataFrame:
    report = get_env_report()
    return spark.createDataFrame([tuple(report.values())], ENV)


def git_state(spark: SparkSession, cwd: str | Path | None = None) -> DataFrame:
    """One row; null ``dirty`` is unknown."""
    s = get_git_state(cwd)
    return spark.createDataFrame([(s["commit"], s["branch"], None if s["dirty"] == "unknown" else s["dirty"])], GIT)


def seed_python(seed: int) -> None:
    """Seed the standard library's generator on the driver; no operator draws from it."""
    random.seed(seed)


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(name)
