"""Distillation losses over token rows: one row for each (batch_id, pos).

Each function has the whole frame as one call, or one call for each value of
``group_cols``. Columns are given by name. Arithmetic is in double precision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checks import number, require_arrays, require_columns, require_numbers
from ..functions.logits import token_kl, token_kl_arrow
from .weights import combine_weights

#: Machine epsilon of single precision, below which no denominator falls.
EPS = 1.1920928955078125e-07


def _kl(student: str, teacher: str, temperature: float, engine: str) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    if engine not in ("native", "arrow"):
        raise ValueError("engine must be 'native' or 'arrow'")
    return (token_kl if engine == "native" else token_kl_arrow)(F.col(f"`{student}`"), F.col(f"`{teacher}`"), temperature)


def kl_divergence_from_logits(tokens: DataFrame, student: str = "student", teacher: str = "teacher", *, temperature: float = 1.0, reduction: str = "none", group_cols: Sequence[str] = (), out: str = "kl", engine: str = "native") -> DataFrame:
    """Teacher-to-student KL of each token: ``tokens`` plus ``out``, or its mean or sum.

    The mean is over all token rows; of no rows it is NaN, and the sum 0.
    """
    require_arrays(tokens, student, teacher)
    kl = _kl(student, teacher, temperature, engine)
    if reduction not in ("none", "mean", "sum"):
        raise ValueError("reduction must be one of: none, mean, sum")
    if reduction == "none":
        return tokens.withColumn(out, kl)
    require_columns(tokens, *group_cols)
    total = F.coalesce(F.sum("__kl"), F.lit(0.0)) if reduction == "sum" else F.coalesce(F.avg("__kl"), F.lit(float("nan")))
    return tokens.select(*group_cols, kl.alias("__kl")).groupBy(*group_cols).agg(total.alias(out))


def masked_weighted_kl(tokens: DataFrame, student: str = "student", teacher: str = "teacher", *, mask: str | None = None, weights: str | Column | None = None, temperature: float = 1.0, normalize_weights: bool = True, group_cols: Sequence[str] = (), out: str = "loss", eps: float = EPS, engine: str = "native") -> DataFrame:
    """The mean KL of the tokens under mask times weights.

    Masks multiply, they do not filter: a NaN at a masked token makes the loss NaN.
    The denominator is the sum of mask times weights; with ``normalize_weights``
    off it is the sum of the mask, or the number of token rows without a mask. The
    first two are ``eps`` at least.
    """
    require_arrays(tokens, student, teacher)
    require_columns(tokens, *group_cols)
    kl = _kl(student, teacher, temperature, engine)
    require_numbers(tokens, mask)
    effective, m = F.lit(1.0), F.lit(1.0)
    if mask is not None:
        m = number(tokens, mask)
        effective = effective * m
    if isinstance(weights, str):
        require_numbers(tokens, weights)
        weights = number(tokens, weights)
    if weights is not None:
        effective = effective * weights
    rows = tokens.select(*group_cols, kl.alias("__kl"), effective.alias("__eff"), m.alias("__mask"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    n = F.count(F.lit(1))
    sums = rows.groupBy(*group_cols).agg(total(F.col("__kl") * F.col("__eff")).alias("__sum"), total("__eff").alias("__eff"), total("__mask").alias("__mask"), n.alias("__n"))
    if normalize_weights:
        loss = F.col("__sum") / F.greatest("__eff", F.lit(eps))
    elif mask is not None:
        loss = F.col("__sum") / F.greatest("__mask", F.lit(eps))
    else:
        loss = F.when(F.col("__n") == 0, float("nan")).otherwise(F.col("__sum") / F.greatest("__n", F.lit(1)))
    return sums.select(*group_cols, loss.alias(out))


def dual_track_loss(tokens: DataFrame, student: str = "student", teacher: str = "teacher", *, text_weights: str | None = None, vision_weights: str | None = None, mask: str | None = None, alpha_text: float = 1.0, alpha_vision: float = 1.0, temperature: float = 1.0, group_cols: Sequence[str] = (), out: str = "loss", engine: str = "native") -> DataFrame:
    """The masked KL under the scaled sum of text and vision weights.

    With weights the mask enters twice, once when they are combined and once in the
    loss, so a fractional mask counts squared. Without weights it enters once and
    the alphas have no effect.
    """
    require_numbers(tokens, text_weights, vision_weights)
    tracks = [number(tokens, w) * F.lit(float(a)) for w, a in ((text_weights, alpha_text), (vision_weights, alpha_vision)) if w is not None]
    combined = None
    if tracks:
        require_numbers(tokens, mask)
        combined = combine_weights(*tracks, mode="sum", mask=None if mask is None else number(tokens, mask))
    return masked_weighted_kl(tokens, student, teacher, mask=mask, weights=combined, temperature=temperature, normalize_weights=True, group_cols=group_cols, out=out, engine=engine)
