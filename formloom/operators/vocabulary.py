"""Vocabulary releases: snapshot report and idempotent loading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.operators.checksums import dataset_checksum


def snapshot(concepts: DataFrame, files: DataFrame, release_id: str, vocabulary_version: str) -> DataFrame:
    """One row: counts and checksum of a snapshot; accepted if it holds a standard concept.

    ``files`` lists ``name`` and SHA-256 ``digest`` of the snapshot's files.
    """
    counts = concepts.agg(
        F.count(F.lit(1)).alias("concept_count"),
        F.count_if(F.col("standard_concept") == "S").alias("standard_concept_count"),
    )
    checksum = dataset_checksum(files, "name", "digest").select("checksum").scalar()
    return counts.select(
        F.lit(release_id).alias("release_id"),
        F.lit(vocabulary_version).alias("vocabulary_version"),
        checksum.alias("source_checksum"),
        "concept_count",
        "standard_concept_count",
        (F.col("standard_concept_count") > 0).alias("accepted"),
    )


def plan_load(offered: DataFrame, ledger: DataFrame) -> DataFrame:
    """What loading each offered snapshot means against the import ledger.

    APPEND for a new release, REPLAY (nothing to do) for the same content, REBOUND (refused) for
    a release id that already stands for other content.
    """
    known = ledger.select("release_id", F.col("source_checksum").alias("_stored"))
    joined = offered.join(known, "release_id", "left")
    action = (
        F.when(F.col("_stored").isNull(), "APPEND")
        .when(F.col("_stored") == F.col("source_checksum"), "REPLAY")
        .otherwise("REBOUND")
    )
    return joined.withColumn("action", action).drop("_stored")


def load(rows: dict[str, DataFrame], offered: DataFrame, ledger: DataFrame, root: str) -> DataFrame:
    """Writes the tables of a new snapshot below ``root``, partitioned by release; returns the plan.

    A replay writes nothing; a rebound release raises before anything is written.
    """
    plan = plan_load(offered, ledger)
    actions = {r["release_id"]: r["action"] for r in plan.select("release_id", "action").take(2)}
    if len(actions) != 1:
        raise ValueError("load takes exactly one offered snapshot")
    release_id, action = next(iter(actions.items()))
    if action == "REBOUND":
        raise ValueError(f"vocabulary release {release_id} already stands for other content")
    if action == "APPEND":
        for name, df in rows.items():
            df.withColumn("release_id", F.lit(release_id)).write.mode("overwrite").partitionBy("release_id").parquet(f"{root}/{name}")
    return plan
