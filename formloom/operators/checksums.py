"""Checksums of datasets and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.identity import multiset_digest
from formloom.operators.ordering import global_index

CHUNK = 1024


def dataset_checksum(members: DataFrame, name: str, digest: str, chunk: int = CHUNK) -> DataFrame:
    """One row: ``checksum`` over the members in name order, and ``members``.

    A dataset of up to ``chunk`` members hashes to SHA-256 of name, NUL and raw digest of each in
    turn. A larger one is hashed chunk by chunk, and the chunk digests level by level, so no task
    ever holds more than ``chunk`` of them.
    """
    total = members.count()
    piece = F.concat(F.encode(F.col(name), "UTF-8"), F.unhex(F.lit("00")), F.unhex(F.col(digest)))
    level = global_index(members.select(name, digest), name, name="_i").select(
        F.col("_i"), piece.alias("_piece")
    )
    while True:
        grouped = level.groupBy(F.call_function("div", F.col("_i"), F.lit(chunk)).alias("_i")).agg(
            F.array_sort(F.collect_list(F.struct("_i", "_piece"))).alias("_list")
        )
        joined = F.aggregate(
            "_list", F.unhex(F.lit("")), lambda acc, item: F.concat(acc, item["_piece"])
        )
        hashed = grouped.select("_i", F.sha2(joined, 256).alias("checksum"))
        if total <= chunk:
            return hashed.select("checksum").withColumn("members", F.lit(members.count()))
        level = hashed.select("_i", F.unhex("checksum").alias("_piece"))
        total = -(-total // chunk)


def row_hash(*columns: str) -> Column:
    """SHA-256 of a row's columns as text; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def stage_checksums(stages: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(stage, rows, checksum) of each stage; row order and partitioning do not matter."""
    parts = [
        df.select(row_hash(*columns).alias("_h")).agg(
            F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("rows"), multiset_digest("_h").alias("checksum")
        )
        for stage, (df, columns) in stages.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def combined_checksum(stages: DataFrame) -> DataFrame:
    """One checksum over the stage checksums in name order; a handful of rows."""
    listed = F.array_sort(F.collect_list(F.concat_ws("=", "stage", "checksum")))
    return stages.agg(F.sha2(F.array_join(listed, ";"), 256).alias("combined"))


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Stage checksums of two runs side by side; a missing stage is not equal."""
    a, b = first.alias("a"), second.alias("b")
    return a.join(b, F.col("a.stage") == F.col("b.stage"), "full_outer").select(
        F.coalesce("a.stage", "b.stage").alias("stage"),
        F.col("a.checksum").alias("first_checksum"),
        F.col("b.checksum").alias("second_checksum"),
        F.coalesce(F.col("a.checksum") == F.col("b.checksum"), F.lit(False)).alias("equal"),
    )
