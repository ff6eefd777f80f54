"""Canonical store, stage artifacts, CDM tables and committed releases on a shared file system."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.operators import omop
from formloom.session import broadcast_if_small

ROWS_PER_FILE = 50_000
PARTITIONS = ["establishment_id", "source_period", "batch_id", "source_fingerprint"]
STAGES = ("manifest", "canonical", "quality", "omop", "lineage", "catalog")


def write_canonical(df: DataFrame, root: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Parquet by site, period, batch and fingerprint, at most ``rows_per_file`` rows per file.

    Only the partitions in ``df`` are replaced, so writing a batch again is a replay. Rows of a
    partition are gathered first and split again by size, so a small partition is one file and a large
    one is written by many tasks.
    """
    (
        df.hint("rebalance", *PARTITIONS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "zstd")
        .partitionBy(*PARTITIONS)
        .parquet(root)
    )


def read_canonical(
    spark: SparkSession, root: str, site: str | None = None, period: str | None = None,
    batch: str | None = None, fingerprint: str | None = None, schema: T.StructType | None = None,
) -> DataFrame:
    """The canonical store; each argument prunes partitions.

    With a ``schema`` nothing is inferred from files, and a store nobody has written to yet is empty.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        df = reader.parquet(root)
    except AnalysisException as error:
        if schema is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    for name, value in zip(PARTITIONS, (site, period, batch, fingerprint)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def write_stage_artifacts(stages: dict[str, DataFrame], root: str, batch_id: str) -> None:
    """One Parquet table per stage below the batch's directory."""
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    for stage, df in stages.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/batch_id={batch_id}/{stage}")


def write_omop(tables: dict[str, DataFrame], root: str, release_id: str) -> None:
    """CDM tables of a release; the release is a partition, not a CDM column."""
    for name, df in tables.items():
        shaped = omop.conform(df, name).withColumn("release_id", F.lit(release_id))
        shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("release_id").parquet(f"{root}/{name}")


def commit_release(manifest: DataFrame, findings: DataFrame, root: str) -> None:
    """Append the one manifest row that publishes a release; refuse while there are findings.

    Everything else of the release is written before, so readers see all of it or nothing.
    """
    problem = findings.take(1)
    if problem:
        raise ValueError(f"release not publishable: {problem[0].asDict()}")
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/manifests")


def committed(df: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rows of releases that have a manifest."""
    return df.join(broadcast_if_small(manifests.select("release_id").distinct()), "release_id", "left_semi")


def export_site_bundle(header: DataFrame, metrics: DataFrame, path: str) -> None:
    """Aggregate-only JSON: one header object, one object per metric."""
    options = {"ignoreNullFields": "false"}
    header.coalesce(1).write.mode("errorifexists").options(**options).json(f"{path}/header")
    metrics.write.mode("errorifexists").options(**options).json(f"{path}/metrics")


def read_site_bundles(spark: SparkSession, paths: list[str], header_schema: str, metric_schema: str) -> tuple[DataFrame, DataFrame]:
    """Headers and metrics of exported bundles, with fixed schemas."""
    headers = spark.read.schema(header_schema).json([f"{p}/header" for p in paths])
    return headers, spark.read.schema(metric_schema).json([f"{p}/metrics" for p in paths])


def period_of(day: Column) -> Column:
    """Month partition of a date."""
    return F.date_format(day, "yyyy-MM")
