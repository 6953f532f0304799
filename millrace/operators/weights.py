"""Token weights: combination, normalisation, and top-k anchoring within a sequence."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.checks import number, require_columns, require_numbers


def combine_weights(*weights: Column | str | None, mode: str = "sum", mask: Column | str | None = None) -> Column:
    """Sum or product of the weights that are given, times the mask. Nulls in them stay null."""
    column = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    given = [column(w) for w in weights if w is not None]
    if not given:
        raise ValueError("at least one weights column is required")
    if mode not in ("sum", "product"):
        raise ValueError("mode must be 'sum' or 'product'")
    out = functools.reduce(operator.add if mode == "sum" else operator.mul, given)
    return out if mask is None else out * column(mask)


def normalize_token_weights(tokens: DataFrame, weights: str = "weight", *, mask: str | None = None, eps: float = 1e-8, by: Sequence[str] = ("batch_id",), out: str = "weight_norm") -> DataFrame:
    """``tokens`` plus ``out``: weights scaled so that the valid ones of a sequence have mean 1.

    Masked-out positions come out 0, and so does a sequence without a valid one. The
    sum of weights counts as ``eps`` at least.
    """
    require_columns(tokens, *by)
    require_numbers(tokens, weights, mask)
    valid = F.lit(1.0) if mask is None else number(tokens, mask)
    masked = number(tokens, weights) * valid
    rows = Window.partitionBy(*by)
    count, total = F.sum(valid).over(rows), F.sum(masked).over(rows)
    scaled = masked * (count / F.greatest(total, F.lit(float(eps))))
    return tokens.withColumn(out, F.when(count > 0, scaled).otherwise(0.0))


def build_visual_anchor_weights(tokens: DataFrame, scores: str = "score", *, mask: str | None = None, topk_ratio: float = 0.1, high_weight: float = 2.0, low_weight: float = 1.0, by: Sequence[str] = ("batch_id",), pos: str = "pos", out: str = "anchor_weight") -> DataFrame:
    """``tokens`` plus ``out``: the high weight for a sequence's best-scored valid tokens.

    k is the ceiling of the number of valid tokens times the ratio, 1 at least, in
    double arithmetic. A token is valid if its mask is not 0. Scores are compared in
    single precision; of equals the smaller position comes first, and NaN ranks
    highest. Other valid tokens get the low weight, invalid ones 0. The ranks and the
    count share one shuffle.
    """
    require_columns(tokens, *by, pos)
    require_numbers(tokens, scores, mask)
    if not 0 < topk_ratio <= 1:
        raise ValueError("topk_ratio must be in (0, 1]")
    valid = F.lit(True) if mask is None else number(tokens, mask) != 0
    rows = tokens.withColumn("__valid", valid).withColumn("__score", number(tokens, scores).cast("float"))
    part = Window.partitionBy(*by, "__valid")
    k = F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.lit(1)).over(part).cast("double") * F.lit(float(topk_ratio))))
    rank = F.row_number().over(part.orderBy(F.desc("__score"), pos))
    weight = F.when(~F.col("__valid"), 0.0).when(rank <= k, float(high_weight)).otherwise(float(low_weight))
    return rows.withColumn(out, weight).drop("__valid", "__score")
