"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a longest run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Prefix of internal columns, so that they cannot clash with a caller's own.
P = "__mr_"

_written: dict[str, SparkSession] = {}  # folders that are still there
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Only a local master may do without: there
    a temporary folder is set once and reused, as in tests.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return spark.conf.get("spark.checkpoint.dir")


#: Rows of a written table for each of its files, and files at least, where the rows are known.
FILE_ROWS, MIN_FILES = 200_000, 8


def materialize(df: DataFrame, name: str, rows: int | None = None, files: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Lost executors cannot take the rows with them. The files go with the ``scratch``
    they are written in, or at exit. ``rows``
    bounds the number of rows: small tables are then written in few files, however
    many partitions they come from. ``files`` gives their number.
    """
    spark = df.sparkSession
    if rows is not None:
        files = max(MIN_FILES, -(-rows // FILE_ROWS))
    if files is not None:
        df = df.coalesce(files)
    path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(_remove)
    folder = path.rpartition("/")[0]
    _written[folder] = spark
    if (scope := _scope.get()) is not None:
        scope.append(folder)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_folder = folder
    return out


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialized inside are deleted at its end, also after an error.

    ``keep(table)`` keeps one, for the enclosing scope if there is one. What is
    returned from inside may depend on kept tables only.
    """
    outer, own = _scope.get(), []
    token = _scope.set(own)

    def keep(table: DataFrame) -> DataFrame:
        own.remove(table._millrace_folder)
        if outer is not None:
            outer.append(table._millrace_folder)
        return table

    try:
        yield keep
    finally:
        _scope.reset(token)
        for folder in own:
            _delete(folder)


def _delete(folder: str) -> None:
    spark = _written.pop(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove() -> None:
    for folder in list(_written):
        try:
            _delete(folder)
        except Exception:  # the session has ended; nothing is left to clean with
            return


_clear: list[Callable[[], None]] = []


def claim(clear: Callable[[], None] | None = None) -> None:
    """Called by a task in a Python worker: caches that another operator left there go.

    Workers are used again, and their memory counts as the executor's, freed or not, until
    it is given back to the system. ``clear`` is what empties the caches that this task fills.
    """
    for other in [c for c in _clear if c != clear]:
        other()
        _clear.remove(other)
    if clear is not None and clear not in _clear:
        _clear.append(clear)
    _give_back()


def _give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release_heaps(spark: SparkSession) -> None:
    """Have the executors' JVMs collect garbage and return unused heap to the system.

    A heap that one stage has grown stays so, and counts as the executor's memory beside the
    Python workers of the next. With as many tasks as cores, each idle executor gets some.
    Only memory depends on it: where a cluster forbids the call, the heaps stay as they are.
    """
    sc = spark.sparkContext
    tasks = 1 if sc.master.startswith("local[") else sc.defaultParallelism
    with contextlib.suppress(PySparkException):
        spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
