"""Corrections that retract earlier answers across micro-batches.

An answer's arrival and the claims to supersede it are messages to the answer's id. Each
micro-batch is joined with the stored messages of the ids it touches, so the work is set-at-a-time,
no key holds state of its own, and claims may come before or after their target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = "micro_batch"
STORED = "answer_id string, entity string, claimant string, micro_batch int"


def messages(answers: DataFrame) -> DataFrame:
    """Arrivals and claims from answers with ``event_id, entity, lifecycle_status, supersedes_event_id``.

    A correction without a target claims an id that never arrives, and so becomes invalid.
    """
    own = F.col("event_id").cast("string")
    target = F.coalesce(F.col("supersedes_event_id").cast("string"), F.concat(F.lit("none:"), own))
    arrival = F.struct(own.alias("answer_id"), "entity", F.lit(None).cast("string").alias("claimant"))
    claim = F.struct(target.alias("answer_id"), "entity", own.alias("claimant"))
    is_claim = F.col("lifecycle_status").isin("CORRECTED", "VOIDED")
    both = F.array_compact(F.array(arrival, F.when(is_claim, claim)))
    return answers.select(F.explode(both).alias("m")).select("m.*")


def changes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(answer_id, change, claimant) that the new messages bring about.

    CURRENT on arrival without a claim; SUPERSEDED when arrival and the single claim of the same
    entity have met; INVALID_SUPERSESSION for a claim on oneself or across entities;
    AMBIGUOUS_SUPERSESSION for every further claim; DUPLICATE_EVENT_ID for a second arrival.
    """
    touched = new.select("answer_id").distinct()
    known = stored.select("answer_id", "entity", "claimant").join(touched, "answer_id", "left_semi")
    every = new.withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False)))
    arrival = F.col("claimant").isNull()
    on_itself = F.coalesce(F.col("claimant") == F.col("answer_id"), F.lit(False))
    claim = ~arrival & ~on_itself
    fresh = F.col("_new")
    per_answer = every.groupBy("answer_id").agg(
        F.count_if(arrival & fresh).alias("arrived_now"),
        F.count_if(arrival & ~fresh).alias("arrived_before"),
        F.count_if(claim & fresh).alias("claimed_now"),
        F.count_if(claim & ~fresh).alias("claimed_before"),
        F.min(F.when(arrival, F.col("entity"))).alias("entity"),
        F.min(F.when(claim, F.struct("claimant", "entity"))).alias("first"),
    )
    arrivals = F.col("arrived_now") + F.col("arrived_before")
    claims = F.col("claimed_now") + F.col("claimed_before")
    settled_before = (F.col("arrived_before") > 0) & (F.col("claimed_before") > 0)
    met = (claims == 1) & (arrivals > 0) & ~settled_before
    outcome = (
        F.when(met & (F.col("first.entity") == F.col("entity")), "SUPERSEDED")
        .when(met, "INVALID_SUPERSESSION")
        .when((claims == 0) & (F.col("arrived_now") > 0) & (F.col("arrived_before") == 0), "CURRENT")
    )
    settled = per_answer.select("answer_id", outcome.alias("change"), F.when(met, F.col("first.claimant")).alias("claimant"))
    twice = per_answer.filter((arrivals > 1) & (F.col("arrived_now") > 0)).select(
        "answer_id", F.lit("DUPLICATE_EVENT_ID").alias("change"), F.lit(None).cast("string").alias("claimant")
    )
    contested = per_answer.filter(claims > 1).select("answer_id")
    rivals = new.filter(claim).join(contested, "answer_id", "left_semi").select(
        "answer_id", F.lit("AMBIGUOUS_SUPERSESSION").alias("change"), "claimant"
    )
    selfish = new.filter(on_itself).select("answer_id", F.lit("INVALID_SUPERSESSION").alias("change"), "claimant")
    return settled.filter("change IS NOT NULL").unionByName(twice).unionByName(rivals).unionByName(selfish)


def expired(stored: DataFrame, before_batch: int) -> DataFrame:
    """Claims received before a micro-batch whose target has still not arrived."""
    arrived = stored.filter("claimant IS NULL").select("answer_id").distinct()
    waiting = stored.filter((F.col("claimant").isNotNull()) & (F.col(BATCH) < before_batch))
    return waiting.join(arrived, "answer_id", "left_anti").select(
        "answer_id", F.lit("INVALID_SUPERSESSION").alias("change"), "claimant"
    )


def stream_supersession(answers: DataFrame, root: str, checkpoint: str) -> None:
    """Drain a stream of answers into ``root/messages`` and ``root/changes``.

    Both tables are partitioned by micro-batch; running a batch again after a failure replaces its
    partitions and reads only earlier ones, so every change is stored once.
    """
    spark = answers.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        def write(df: DataFrame, name: str) -> None:
            df.withColumn(BATCH, F.lit(number)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy(BATCH).parquet(f"{root}/{name}")

        write(messages(batch), "messages")
        seen = spark.read.schema(STORED).parquet(f"{root}/messages")
        write(changes(seen.filter(F.col(BATCH) == number).drop(BATCH), seen.filter(F.col(BATCH) < number)), "changes")

    (
        answers.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
