"""Alignment of token frames that arrive apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.checks import require_columns


def align_tokens(left: DataFrame, right: DataFrame, *, on: Sequence[str] = ("batch_id", "pos")) -> DataFrame:
    """The columns of both frames, row by row; each position must be in both.

    The join is a full outer one, so that a position missing on either side fails
    the query instead of dropping out. Frames that are bucketed by ``on`` alike are
    joined without a shuffle. Other columns must have different names.
    """
    require_columns(left, *on)
    require_columns(right, *on)
    both = (set(left.columns) & set(right.columns)) - set(on)
    if both:
        raise ValueError(f"both frames have columns named {', '.join(sorted(both))}")
    joined = left.withColumn("__left", F.lit(True)).join(right.withColumn("__right", F.lit(True)), list(on), "full_outer")
    place = F.concat_ws(", ", *[F.col(f"`{c}`").cast("string") for c in on])
    error = F.raise_error(F.concat(F.lit("student and teacher tokens must have the same shape; one has no token at "), place)).cast("boolean")
    return joined.where(F.when(F.col("__left") & F.col("__right"), True).otherwise(error)).drop("__left", "__right")
