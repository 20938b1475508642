"""Sharding by minimax contiguous partition; DataFrame functions only.

Groups of equal texts are atomic and lie in the order of their content hash.  The smallest capacity
at which greedily filled contiguous shards suffice is found by binary search, and the order is cut
there.  Prefix sums come from one window per hash bucket plus the (bounded) bucket totals.  The
greedy check needs, per shard, the last prefix sum within reach: the first rounds ask the cluster
for many capacities at once; as soon as few enough prefix sums lie where cuts can still fall
(``LOCAL_SUMS``), the rest of the search uses those alone, which changes nothing in its result.

Nulls: a null text has size 1 and checksum 0 and is equal to other null texts only; null ids are
placed like others.  Repeated rows each get a slot.  With fewer groups than shards, shards stay
empty; an empty table gives no rows.  One group larger than a fair share makes the largest shard.
Texts of any length are measured and hashed whole.  Columns besides ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haloframe.llm.common import cut, text_key

SHARDS = 8
BUCKETS = 4096
SALTS = 32
PROBES = 24
LOCAL_SUMS = 100_000


def greedy_cuts(sums: list[int], capacity: int, shards: int, total: int) -> list[int] | None:
    """Greedy ends of shards (as prefix sums) at ``capacity``; None if a group or the rest doesn't fit."""
    cuts, at = [], 0
    for _ in range(shards):
        if at < total:
            i = bisect_right(sums, at + capacity)
            if not i or sums[i - 1] <= at:
                return None
            at = sums[i - 1]
        cuts.append(at)
    return cuts if at >= total else None


def _probe(ends: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """Greedy cuts for each capacity, all capacities together, a pass for each shard."""
    cuts: list[list[int]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(shards):
        row = ends.agg(
            *[F.max(F.when(F.col("bytes_end") <= a + c, F.col("bytes_end"))) for a, c in zip(at, capacities, strict=True)]
        ).first()
        at = [max(a, v or 0) for a, v in zip(at, row, strict=True)]
        for seen, a in zip(cuts, at, strict=True):
            seen.append(a)
    return cuts


def minimax_cuts(ends: DataFrame, shards: int, local_sums: int = LOCAL_SUMS) -> list[int]:
    """Ends of the shards at the smallest feasible capacity; ``ends`` has a row for each group."""
    total, largest = ends.agg(F.max("bytes_end"), F.max("bytes")).first()
    if not total:
        return [0] * shards
    low = max(-(-total // shards), largest) - 1  # below every feasible capacity, or just infeasible
    high = -(-total // shards) + largest
    low_cuts, high_cuts = [0] * shards, [total] * shards
    while True:
        near = F.lit(False)
        for a, b in zip(low_cuts, high_cuts, strict=True):
            near = near | F.col("bytes_end").between(a, b)
        if ends.where(near).limit(local_sums + 1).count() <= local_sums:
            break
        step = max(1, (high - low) // (PROBES + 1))
        capacities = sorted({min(high, low + step * (k + 1)) for k in range(PROBES)} | {high})
        found = _probe(ends, capacities, shards)
        best = next(i for i, c in enumerate(found) if c[-1] >= total)
        high, high_cuts = capacities[best], found[best]
        if best:
            low, low_cuts = capacities[best - 1], found[best - 1]
        if high - low <= 1:
            return high_cuts
    sums = sorted(r[0] for r in ends.where(near).select("bytes_end").collect())
    while high - low > 1:
        middle = (low + high) // 2
        if greedy_cuts(sums, middle, shards, total) is None:
            low = middle
        else:
            high = middle
    return greedy_cuts(sums, high, shards, total)


def shard(rows: DataFrame, shards: int = SHARDS, salts: int = SALTS, local_sums: int = LOCAL_SUMS) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows ``(key, size, salt, ...)``; ``key`` names a row's group.

    ``salt`` splits large groups, so that neither counting nor numbering gathers one in a task.
    """
    head = F.coalesce(F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int"), F.lit(0))  # null texts come first
    bucket = F.floor(head * BUCKETS / F.lit(1 << 16)).cast("int")
    parts = cut(
        rows.groupBy("key", "salt").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket)
    )
    totals = parts.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.sum("n").alias("c"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    base = totals.select(
        "bucket",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("rows_before"),
    )
    running = Window.partitionBy("bucket").orderBy("key", "salt").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("bucket", "key")
    placed = cut(
        parts.withColumn("bytes_to", F.sum("bytes").over(running))
        .withColumn("n_to", F.sum("n").over(running))
        .withColumn("group_end", F.max("bytes_to").over(group))
        .withColumn("group_bytes", F.sum("bytes").over(group))
        .join(F.broadcast(base), "bucket")
        .select(
            "key",
            "salt",
            (F.col("bytes_before") + F.col("group_end")).alias("bytes_end"),
            F.col("group_bytes").alias("bytes"),
            (F.col("rows_before") + F.col("n_to") - F.col("n")).alias("first_row"),
        )
    )
    cuts = minimax_cuts(placed, shards, local_sums)
    number = sum((F.when(F.col("bytes_end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    numbered = placed.select("key", "salt", "first_row", number.cast("int").alias("shard"))
    starts = numbered.groupBy("shard").agg(F.min("first_row").alias("shard_row"))  # a row per shard
    numbered = numbered.join(F.broadcast(starts), "shard").select(
        "key", "salt", "shard", (F.col("first_row") - F.col("shard_row")).alias("first_slot")
    )
    within = Window.partitionBy("key", "salt").orderBy("doc_id")
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(numbered, ["key", "salt"])
        .withColumn("slot", F.col("first_slot") + F.col("place"))
        .drop("first_slot", "place")
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint"), "text")
    rows = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            text_key(F.col("text")).alias("key"),
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        )
    )
    return shard(rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard")
    )
