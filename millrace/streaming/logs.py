"""Extras: the log counts and stateless operators on streams.

Ranks within a sequence are not windows over time, so a stream runs them batch by
batch with ``for_each_batch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..sources.jsonl import count_keys, non_blank, parse_lines


def stream_counts(spark: SparkSession, folder: str, *, exact: bool = False, on_non_object: str = "raise") -> DataFrame:
    """(finish_reason, dataset, malformed, n): running counts of a growing folder of logs.

    For output mode ``complete`` or ``update``; the state is a row for each set of keys.
    """
    parsed = parse_lines(non_blank(spark.readStream.text(folder)), exact=exact, on_non_object=on_non_object)
    return parsed.groupBy("finish_reason", "dataset", "malformed").count().withColumnRenamed("count", "n")


def for_each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that applies a batch operator to each micro-batch and hands the result on."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink(operator(batch), number))


__all__ = ["count_keys", "for_each_batch", "stream_counts"]
