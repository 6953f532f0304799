"""The corpus pipeline: four of the training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept. All but the last return the columns of ``documents``. Each begins with
executors whose heaps are no larger than what they hold.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import langid, mixing, packing, simhash
from millrace.llm.common import materialize, release_heaps, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _fresh(stage: Stage) -> Stage:
    """``stage``, begun when the heap that the one before it used has gone back to the system."""

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_heaps(spark)
        return stage(spark, docs, sf_dir)

    return begun


@_fresh
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, and those for whose labels nothing speaks."""
    return langid.keep_identified(docs)


@_fresh
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, found by SimHash and MinHash and checked by their shingles, the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


@_fresh
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row and pass of which words are taken, with the words taken."""
    return mixing.mixed_documents(docs)


@_fresh
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Fingerprint links, permutations and tokens are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:  # a stage's own tables go when its rows are written
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
