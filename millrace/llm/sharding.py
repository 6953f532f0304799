"""Sharding by jump consistent hashing, in built-in functions only.

A row's shard depends on its key and on the shard count alone, without a ring
table. Appending shard n moves about 1/(n+1) of the rows, all of them into the
new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import P, let

#: The generator of the published algorithm: key * MULTIPLIER + 1 modulo 2^64.
MULTIPLIER = 2862933555777941757
#: Rows of a shard are numbered in this many parts, so that no task sorts a whole shard.
PARTS = 256


#: Jumps worked out for every row. The published loop makes about ln(shards) + 1 jumps;
#: only rows that need more go on.
STEPS = 24


def _jumps(key: Column, shards: int) -> Column:
    """(state, shard, next) where the published loop (Lamping and Veach) ends: ``next``,
    the next shard jumped to, is the first beyond the last shard.

    The 64-bit state is kept as a non-negative decimal, as bigint arithmetic must
    not wrap. Steps after the loop's end leave the state as it is. Every step jumps
    by one shard at least, so ``shards`` steps are enough.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    two64 = F.lit(str(2**64)).cast("decimal(20,0)")
    start = F.struct(
        F.pmod(key.cast("decimal(20,0)") + two64, two64).cast("decimal(20,0)").alias("state"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(at: Column, _: Column) -> Column:
        # state mod 2^64 of a product below 10^38
        state = F.pmod(at["state"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)"), two64).cast("decimal(20,0)")
        top = F.floor(state / F.lit(str(2**33)).cast("decimal(10,0)")).cast("double") + F.lit(1.0)
        jumped = F.floor((at["next"] + 1).cast("double") * (F.lit(float(2**31)) / top)).cast("long")
        return F.when(at["next"] >= F.lit(shards), at).otherwise(F.struct(state.alias("state"), at["next"].alias("shard"), jumped.alias("next")))

    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, STEPS))), start, step)
    if shards <= STEPS:
        return first
    rest = F.sequence(F.lit(STEPS + 1), F.lit(shards))
    return let(first, lambda at: F.when(at["next"] >= F.lit(shards), at).otherwise(F.aggregate(rest, at, step)))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key, 0 to ``shards`` - 1."""
    return _jumps(key, shards)["shard"].cast("int")


def shard_by_key(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard by the hash of its id.

    Returns id, size (UTF-8 bytes of the text, none for null, plus 16), text_crc32
    (of the empty text for null), law, shard, slot (gapless from 0 in each shard)
    and grown_shard (the shard with one more shard). A null id is hashed like a
    value of its own. Repeated rows share a shard and have slots of their own.
    Other columns are ignored. Only ids, sizes and checksums are shuffled, once.
    """
    key = F.xxhash64(F.col(id_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("part")), F.lit(PARTS)).cast("int")
    ids = docs.select(jump_hash(key, shards).alias(f"{P}shard"), part.alias(f"{P}part"))
    counts = ids.groupBy(f"{P}shard", f"{P}part").agg(F.count(F.lit(1)).alias(f"{P}n"))
    before = Window.partitionBy(f"{P}shard").orderBy(f"{P}part").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * PARTS rows whatever the input's size, so it is broadcast.
    starts = F.broadcast(counts.select(F.col(f"{P}shard").alias("s"), F.col(f"{P}part").alias("p"), F.coalesce(F.sum(f"{P}n").over(before), F.lit(0)).alias("first")))
    # With one more shard the loop goes on only where its next jump reaches just that shard.
    both = let(_jumps(key, shards), lambda at: F.struct(at["shard"].cast("int").alias("shard"), F.when(at["next"] == shards, F.lit(shards)).otherwise(at["shard"].cast("int")).alias("grown")))
    rows = docs.select(
        F.col(id_col).alias(f"{P}id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        both.alias(f"{P}both"),
        part.alias(f"{P}part"),
    ).select(f"{P}id", "size", "text_crc32", F.col(f"{P}both.shard").alias("shard"), F.col(f"{P}both.grown").alias("grown_shard"), f"{P}part")
    order = Window.partitionBy("shard", f"{P}part").orderBy(f"{P}id", "size", "text_crc32")
    numbered = rows.withColumn(f"{P}at", F.row_number().over(order) - 1)
    return numbered.join(starts, (F.col("shard") == F.col("s")) & (F.col(f"{P}part") == F.col("p"))).select(
        F.col(f"{P}id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col(f"{P}at")).cast("long").alias("slot"), "grown_shard"
    )
