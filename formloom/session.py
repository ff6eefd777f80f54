"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Runtime settings every job relies on. The two skew settings let adaptive execution split a hot
# join key even where that costs one more exchange; no shuffle width is pinned here because a
# cluster sets its own.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash instead of sort where every shuffled partition of the build side is this small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Rows that are sorted by their group already are gathered in one pass, not hashed, spilled and merged.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # The JVM never compiles methods of more than 8000 bytes; above that, separately generated
    # projections are several times faster than one fused stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, name: str = "formloom", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own machine; on a cluster the
    executors could not see it, so a missing setting is an error there.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    existing = context.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="formloom-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten there."""
    return f"{shared_dir(spark)}/formloom/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut", codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, with the session's Parquet codec or ``codec``.

    Used where a result must be computed once (partition-dependent numbering, loop state). The
    table outlives lost executors, is columnar and keeps the plan of the caller short.
    """
    path = fresh_path(df.sparkSession, label)
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 50_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` is counted to hold at most ``rows`` rows; the count stops there."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to hold at most ``rows`` rows.

    Meant for governance tables (mapping entries, form items, keys). A larger table is returned
    as it is, and Spark shuffles the join, splitting hot keys at run time.
    """
    return F.broadcast(df) if is_small(df, rows) else df


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small literal table as a local relation, so the planner knows how small it is."""
    schema = T.StructType.fromDDL(ddl)
    records = [{f.name: _arrow_value(v, f.dataType) for f, v in zip(schema, row)} for row in rows]
    table = pa.Table.from_pylist(records, schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def _arrow_value(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.MapType):
        return [(k, _arrow_value(v, kind.valueType)) for k, v in value.items()]
    if isinstance(kind, T.ArrayType):
        return [_arrow_value(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: _arrow_value(v, f.dataType) for f, v in zip(kind, value)}
    return value
