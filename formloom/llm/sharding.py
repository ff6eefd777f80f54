"""Longest-processing-time sharding of groups that must stay together.

Rows with equal text form a group. Groups larger than a fixed share of all bytes are items of their
own, and there are at most ``1 / share`` of those. All other groups are dealt by their hash into a
fixed number of blocks, and each block is an item. So the schedule has a bounded number of items at
any input size: the driver sorts them by size and gives each, through a heap, to the shard that is
least loaded. Shards end up within one item of each other.

Positions inside a shard are counted per (shard, bucket), where the bucket comes from a hash of the
row, and added up over a table of fixed size, so no shard is ever gathered.

Defined results: a null text is as large as an empty one and stays with the empty ones. Repeated rows
are rows of their own and get slots of their own; so are rows without an id. An empty table gives an empty
table. Only a text's length and checksums are kept, however long it is; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.session import cut, local_table

ROW_BYTES = 8


@dataclass(frozen=True)
class Plan:
    """Bounds of the schedule: at most ``blocks + large_groups`` items whatever the input."""

    shards: int = 24
    blocks: int = 16_384
    large_groups: int = 16_384
    buckets: int = 2_048


def schedule(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Item to shard: the largest first, each to the shard with the least load so far."""
    loads = [(0, shard) for shard in range(shards)]
    heapq.heapify(loads)
    placed = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        placed[item] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def text_group(text: Column) -> Column:
    """Group key: equal for equal texts. Two texts of one hash would only share a shard."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def assign_shards(docs: DataFrame, plan: Plan = Plan(), text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, size, text_crc32, shard, slot for every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).alias("id"),
        (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
        text_group(F.col(text)).alias("grp"),
    )
    # Narrow: the texts are read once. Rows without an id are spread by their number.
    rows = cut(rows.withColumn("row", F.when(F.col("id").isNull(), F.monotonically_increasing_id())), "shard-rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"))
    groups = groups.withColumn("block", F.pmod(F.col("grp"), F.lit(plan.blocks)).cast("int"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = max(1, -(-total // plan.large_groups))

    # At most large_groups rows, as each has that share of all bytes, and at most blocks rows.
    large = [(r["grp"], r["size"]) for r in groups.filter(F.col("size") >= least).select("grp", "size").collect()]
    small = groups.filter(F.col("size") < least).groupBy("block").agg(F.sum("size").alias("size")).collect()
    items = [(("block", r["block"]), r["size"]) for r in small] + [(("group", grp), size) for grp, size in large]
    placed = schedule([(i, size) for i, (_, size) in enumerate(items)], plan.shards)
    shard_of = {key: placed[i] for i, (key, _) in enumerate(items)}

    spark = docs.sparkSession
    own = local_table(spark, [(grp, shard_of["group", grp]) for grp, _ in large], "grp bigint, own int")
    shared = local_table(spark, [(b, s) for (kind, b), s in shard_of.items() if kind == "block"], "block int, shared int")
    placed_rows = (
        rows.withColumn("block", F.pmod(F.col("grp"), F.lit(plan.blocks)).cast("int"))
        .join(F.broadcast(own), "grp", "left")
        .join(F.broadcast(shared), "block", "left")
        .select(
            "id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"),
            F.pmod(F.xxhash64("id", "text_crc32", "row"), F.lit(plan.buckets)).cast("int").alias("bucket"),
        )
    )
    counted = placed_rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    # shards x buckets rows at most
    return placed_rows.join(F.broadcast(starts), ["shard", "bucket"]).select(
        F.col("id").alias(id), "size", "text_crc32", "shard",
        (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
    )
