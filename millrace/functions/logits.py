"""Array mathematics over logits, evaluated once for each row inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column that a lambda captures may be inlined by the optimizer and then run
    for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _doubles(logits: Column) -> Column:
    return logits.cast("array<double>")


def log_sum_exp(logits: Column, temperature: float = 1.0) -> Column:
    """ln of the sum of exp(x / temperature), in the stable form."""
    t = F.lit(float(temperature))
    return let(F.array_max(_doubles(logits)) / t, lambda m: m + F.ln(F.aggregate(_doubles(logits), F.lit(0.0), lambda a, x: a + F.exp(x / t - m))))


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    t = F.lit(float(temperature))
    return let(log_sum_exp(logits, temperature), lambda z: F.transform(_doubles(logits), lambda x: x / t - z))


def same_length(student: Column, teacher: Column) -> Column:
    """``student``, or a run-time error unless both are non-empty and equally long."""
    bad = F.coalesce(F.size(student) != F.size(teacher), F.lit(True)) | (F.size(student) < 1)
    message = F.concat(F.lit("student_logits and teacher_logits must have the same shape and not be empty; got "), F.coalesce(F.size(student).cast("string"), F.lit("null")), F.lit(" and "), F.coalesce(F.size(teacher).cast("string"), F.lit("null")))
    return F.when(bad, F.raise_error(message).cast("array<double>")).otherwise(_doubles(student))


def token_kl(student: Column, teacher: Column, temperature: float = 1.0) -> Column:
    """KL(teacher || student) of a token's logits over the vocabulary, times temperature squared.

    Infinite logits give what the sum gives: +inf where only the student has
    -inf, NaN where the teacher has it. Nothing is clamped at 0.
    """
    t = float(temperature)
    pairs = lambda s: F.arrays_zip(log_softmax(s, t).alias("s"), log_softmax(teacher, t).alias("t"))
    term = lambda a, x: a + F.exp(x["t"]) * (x["t"] - x["s"])
    return let(same_length(student, teacher), lambda s: F.aggregate(pairs(s), F.lit(0.0), term)) * F.lit(t * t)


def token_kl_arrow(student: Column, teacher: Column, temperature: float = 1.0) -> Column:
    """``token_kl`` on Arrow batches with numpy, for wide vocabularies."""
    t = float(temperature)

    @F.pandas_udf("double")
    def kl(s: pd.Series, q: pd.Series) -> pd.Series:
        import numpy as np

        out = np.empty(len(s))
        with np.errstate(all="ignore"):
            for i, (a, b) in enumerate(zip(s, q, strict=True)):
                a, b = np.asarray(a, float) / t, np.asarray(b, float) / t
                a, b = a - a.max(), b - b.max()
                a, b = a - np.log(np.exp(a).sum()), b - np.log(np.exp(b).sum())
                out[i] = (np.exp(b) * (b - a)).sum() * t * t
        return pd.Series(out)

    return kl(same_length(student, teacher), _doubles(teacher))
