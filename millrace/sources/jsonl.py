"""Evaluation logs: one JSON object in each line, bad lines tolerated and counted.

The native way parses with Spark's variant type. ``exact=True`` parses with
Python's json module in a pandas UDF: it differs on NaN and Infinity (accepted),
text after the object (rejected) and how containers and numbers print as keys.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import py_strip

FIELDS = ("finish_reason", "dataset")
PARSED = "malformed boolean, object boolean, error boolean, finish_reason string, dataset string"
SUMMARY = "path string, rows bigint, errors bigint, finish_reason map<string,bigint>, datasets map<string,bigint>"


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a text file or folder, stripped, blank ones left out."""
    return non_blank(spark.read.text(path))


def non_blank(lines: DataFrame) -> DataFrame:
    return lines.select(py_strip("value").alias("value")).where("value <> ''")


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _truthy(f: Column) -> Column:
    """Python's truth of a JSON value; missing and null are false."""
    kind = F.schema_of_variant(f)
    return (
        F.when(f.isNull() | F.is_variant_null(f), False)
        .when(kind == "BOOLEAN", F.try_variant_get(f, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(f, "$", "string") != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~f.cast("string").isin("[]", "{}"))
        .otherwise(F.coalesce(F.try_variant_get(f, "$", "double") != 0, F.lit(True)))
    )


def _key(f: Column) -> Column:
    """The key that a value counts under: missing is unknown, null None, booleans capitalised."""
    text = f.cast("string")
    return F.when(f.isNull(), "unknown").when(F.is_variant_null(f), "None").when(F.schema_of_variant(f) == "BOOLEAN", F.initcap(text)).otherwise(text)


def _parse_exact(lines: pd.Series) -> pd.DataFrame:
    rows = []
    for line in lines:
        try:
            item = json.loads(line)
        except json.JSONDecodeError:
            rows.append((True, False, False, None, None))
            continue
        if not isinstance(item, dict):
            rows.append((False, False, False, None, None))
            continue
        rows.append((False, True, bool(item.get("error")), *(str(item.get(k, "unknown")) for k in FIELDS)))
    return pd.DataFrame(rows, columns=["malformed", "object", "error", *FIELDS])


def parse_lines(lines: DataFrame, *, exact: bool = False, on_non_object: str = "raise") -> DataFrame:
    """(malformed, error, finish_reason, dataset) of each stripped, non-blank line.

    A malformed line is an error and has no keys. Valid JSON that is no object fails
    the query, or with ``on_non_object`` "count_error" counts like a malformed line.
    """
    if on_non_object not in ("raise", "count_error"):
        raise ValueError("on_non_object must be 'raise' or 'count_error'")
    if exact:
        rows = lines.select(F.pandas_udf(_parse_exact, PARSED)("value").alias("p")).select("p.*")
    else:
        v = F.col("v")
        rows = lines.select(F.try_parse_json("value").alias("v")).select(
            v.isNull().alias("malformed"),
            F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("object"),
            F.when(v.isNotNull(), _truthy(_field(v, "error"))).alias("error"),
            *[F.when(v.isNotNull(), _key(_field(v, k))).alias(k) for k in FIELDS],
        )
    other = ~F.col("malformed") & ~F.col("object")
    if on_non_object == "raise":
        bad = F.when(other, F.raise_error(F.lit("a line holds JSON that is not an object")).cast("boolean")).otherwise(F.col("malformed"))
    else:
        bad = F.col("malformed") | other
    rows = rows.withColumn("bad", bad)
    return rows.select(F.col("bad").alias("malformed"), (F.col("bad") | F.coalesce("error", F.lit(False))).alias("error"), *[F.when(~F.col("bad"), F.col(k)).alias(k) for k in FIELDS])


def count_keys(parsed: DataFrame) -> DataFrame:
    """(kind, key, n): rows by finish_reason and by dataset; well-formed rows only."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(k).alias("key")) for kind, k in (("finish_reason", "finish_reason"), ("datasets", "dataset"))])
    small = parsed.where(~F.col("malformed")).groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n"))
    return small.select(F.explode(pairs).alias("p"), "n").groupBy("p.kind", "p.key").agg(F.sum("n").alias("n"))


def summarize(lines: DataFrame, *, path: str = "", exact: bool = False, on_non_object: str = "raise") -> DataFrame:
    """One row: path, rows, errors, and maps of counts by finish_reason and dataset.

    The lines are read once; they shrink to a row for each pair of keys before
    anything is gathered. Map entries are in order of their keys.
    """
    parsed = parse_lines(non_blank(lines), exact=exact, on_non_object=on_non_object)
    small = parsed.groupBy(*FIELDS, "malformed").agg(F.count(F.lit(1)).alias("n"), F.count_if("error").alias("e"))
    part = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.when(~F.col("malformed"), F.col("n")).alias("n"))
    total = F.struct(F.lit("rows").alias("kind"), F.lit(None).cast("string").alias("key"), F.col("n").alias("n"))
    wrong = F.struct(F.lit("errors").alias("kind"), F.lit(None).cast("string").alias("key"), F.col("e").alias("n"))
    each = small.select(F.explode(F.array(total, wrong, part("finish_reason", "finish_reason"), part("datasets", "dataset"))).alias("x")).select("x.*").where("n is not null")
    sums = each.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    of = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))))
    one = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("long")
    return sums.agg(one("rows").alias("rows"), one("errors").alias("errors"), of("finish_reason").alias("finish_reason"), of("datasets").alias("datasets")).select(F.lit(path).alias("path"), "rows", "errors", "finish_reason", "datasets")


def summarize_jsonl(spark: SparkSession, path: str, *, exact: bool = False, on_non_object: str = "raise") -> DataFrame:
    """``summarize`` of a file, folder or pattern that Spark can read."""
    return summarize(spark.read.text(path), path=path, exact=exact, on_non_object=on_non_object)


def to_sorted_json(summary: DataFrame) -> str:
    """The one row of ``summarize`` as JSON text with sorted keys."""
    return json.dumps(summary.first().asDict(recursive=True), indent=2, sort_keys=True)
