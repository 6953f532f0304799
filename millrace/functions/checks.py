"""Checks: at plan time where the schema tells, in the rows where only data can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def require_columns(df: DataFrame, *names: str | None) -> None:
    missing = [n for n in names if n is not None and n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}; there are {', '.join(df.columns)}")


def require_arrays(df: DataFrame, *names: str) -> None:
    """The columns must be arrays of numbers: a token's logits."""
    require_columns(df, *names)
    for n in names:
        kind = df.schema[n].dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)):
            raise ValueError(f"logits must have shape [batch, seq, vocab]: {n} must be an array of numbers in each token row; got {kind.simpleString()}")


def require_numbers(df: DataFrame, *names: str | None) -> None:
    """The columns must be scalars of a number or boolean type."""
    require_columns(df, *names)
    for n in names:
        if n is not None and not isinstance(df.schema[n].dataType, (T.NumericType, T.BooleanType)):
            raise ValueError(f"{n} must have shape [batch, seq]: one number in each row; got {df.schema[n].dataType.simpleString()}")


def present(value: Column, name: str) -> Column:
    """``value``, or a run-time error where it is null: absence is never a null here."""
    return F.coalesce(value, F.raise_error(F.lit(f"{name} is null; use mask 0 or a negative chunk id instead")).cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """A required scalar column as double."""
    return present(F.col(f"`{name}`").cast("double"), name)
