"""Chunks of a sequence: pooling token scores into them, and giving their weights to tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.checks import number, require_columns, require_numbers


def pool_token_scores_to_chunks(tokens: DataFrame, scores: str = "score", chunk_ids: str = "chunk_id", *, reduce: str = "mean", batch: str = "batch_id", group_cols: Sequence[str] = (), out: str = "chunk_score", count: str | None = None) -> DataFrame:
    """(group_cols, batch, chunk_id, out): dense chunk scores of every sequence.

    Every sequence has the chunks 0 to the greatest id of its call (the whole frame,
    or the group); those without tokens score 0. Negative ids are ignored, but their
    sequences still appear. If no id is valid there are no rows. ``count`` names a
    further column: the number of a chunk's tokens.
    """
    require_numbers(tokens, scores, chunk_ids)
    require_columns(tokens, batch, *group_cols)
    if reduce not in ("mean", "max"):
        raise ValueError("reduce must be 'mean' or 'max'")
    keys = [*group_cols, batch]
    ids = F.greatest(number(tokens, chunk_ids).cast("long"), F.lit(-1).cast("long"))
    value = F.avg("__score") if reduce == "mean" else F.max("__score")
    pooled = tokens.select(*keys, ids.alias("chunk_id"), number(tokens, scores).alias("__score")).groupBy(*keys, "chunk_id").agg(value.alias("__value"), F.count(F.lit(1)).alias("__n"))
    # A row for each sequence, read again for the width: both uses need the same list, so they share one exchange.
    lists = pooled.groupBy(*keys).agg(F.collect_list(F.struct("chunk_id", F.col("__value").alias("value"), F.col("__n").alias("n"))).alias("__chunks"))
    in_list = F.transform("__chunks", lambda x: x["chunk_id"])
    # One row, or one for each call.
    width = lists.groupBy(*[F.col(f"`{c}`").alias(f"__call_{c}") for c in group_cols]).agg(F.max(F.array_max(in_list)).alias("__last"))
    if group_cols:
        wide = lists.join(width, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__call_{c}`")) for c in group_cols])
    else:
        wide = lists.crossJoin(F.broadcast(width))
    grid = F.sequence(F.lit(0).cast("long"), F.greatest("__last", F.lit(0).cast("long")))
    empty = F.transform(F.array_except(grid, in_list), lambda i: F.struct(i.alias("chunk_id"), F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("n")))
    dense = wide.where(F.col("__last") >= 0).select(*keys, F.explode(F.concat(F.filter("__chunks", lambda x: x["chunk_id"] >= 0), empty)).alias("__chunk"))
    columns = [F.col("__chunk.value").alias(out)]
    if count:
        columns.append(F.col("__chunk.n").alias(count))
    return dense.select(*keys, F.col("__chunk.chunk_id").alias("chunk_id"), *columns)


def expand_chunk_weights_to_tokens(tokens: DataFrame, chunks: DataFrame, *, chunk_ids: str = "chunk_id", weight: str = "weight", batch: Sequence[str] = ("batch_id",), out: str = "token_weight", on_out_of_range: str = "zero", strict: bool = False) -> DataFrame:
    """``tokens`` plus ``out``: the weight of each token's chunk; 0 for a negative id.

    An id that the sequence has no chunk for gives 0, or with ``on_out_of_range``
    "error" a run-time error. ``strict`` also demands chunks for every sequence.
    ``chunks`` has one row for each (batch, chunk_id).
    """
    require_numbers(tokens, chunk_ids)
    require_columns(tokens, *batch)
    require_columns(chunks, *batch)
    require_numbers(chunks, "chunk_id", weight)
    if on_out_of_range not in ("zero", "error"):
        raise ValueError("on_out_of_range must be 'zero' or 'error'")
    keys = [f"__{c}" for c in batch]
    right = chunks.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(batch, keys, strict=True)], F.col("chunk_id").cast("long").alias("__chunk"), number(chunks, weight).alias(out))
    rows = tokens.withColumn("__id", number(tokens, chunk_ids).cast("long"))
    on = [F.col(f"`{c}`") == F.col(k) for c, k in zip(batch, keys, strict=True)]
    joined = rows.join(right, [*on, F.col("__id") == F.col("__chunk")], "left")
    missing = F.lit(0.0)
    if on_out_of_range == "error":
        missing = F.when(F.col("__id") >= 0, F.raise_error(F.concat(F.lit("no such chunk: "), F.col("__id").cast("string"))).cast("double")).otherwise(0.0)
    found = joined.withColumn(out, F.coalesce(out, missing)).drop("__id", "__chunk", *keys)
    if not strict:
        return found
    known = chunks.select(*batch).distinct().withColumn("__known", F.lit(True))
    checked = found.join(known, list(batch), "left")
    return checked.withColumn(out, F.when(F.col("__known").isNull(), F.raise_error(F.lit("chunk weights and chunk ids must share batches")).cast("double")).otherwise(F.col(out))).drop("__known")
