"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formloom.session import fresh_path


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files as a stream; the number of files per micro-batch bounds the work unit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> list[dict]:
    """Run a stream over what is there and stop; appended rows go to ``path``. Returns the progress of its batches.

    In complete mode the whole result replaces the table after each micro-batch.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    else:
        writer = writer.format("parquet").option("path", path)
    query = writer.start()
    query.awaitTermination()
    return [dict(p) if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def late_rows(progress: list[dict]) -> int:
    """Rows that came after the watermark had passed their window."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for batch in progress for op in batch.get("stateOperators", []))


def state_rows(progress: list[dict]) -> list[int]:
    """Rows held in state after each batch."""
    return [sum(op.get("numRowsTotal", 0) for op in batch.get("stateOperators", [])) for batch in progress]


def drain_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """``drain`` into a new table of the shared folder, read back as a batch."""
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    drain(stream, path, checkpoint, mode)
    return spark.read.schema(stream.schema).parquet(path)


def stream_canonicalize(
    stream: DataFrame, operators: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> None:
    """Run the batch operators on every micro-batch and store the result under its batch number.

    A micro-batch that is run again after a failure replaces its own partition, so every answer is
    stored once.
    """

    def store(batch: DataFrame, number: int) -> None:
        (
            operators(batch)
            .withColumn("micro_batch", F.lit(number))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("micro_batch")
            .parquet(path)
        )

    (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def stream_dedupe(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each key; replays within the delay are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
