"""Reports over the job ledger, the audit log and the source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.functions.identity import canonical_json


def idempotency_conflicts(jobs: DataFrame) -> DataFrame:
    """Idempotency keys used for different requests, with how many."""
    request = F.sha2(canonical_json(job_type="job_type", payload="payload"), 256)
    return (
        jobs.select("idempotency_key", request.alias("_request"))
        .groupBy("idempotency_key")
        .agg(F.countDistinct("_request").alias("requests"), F.count(F.lit(1)).alias("submissions"))
        .filter("requests > 1")
    )


def distinct_jobs(jobs: DataFrame) -> DataFrame:
    """One row per idempotency key: the earliest submission; replays collapse into it."""
    body = [c for c in jobs.columns if c != "idempotency_key"]
    earliest = F.min_by(F.struct(*body), F.struct("created_at", "job_id")).alias("j")
    return jobs.groupBy("idempotency_key").agg(earliest).select("idempotency_key", "j.*")


def run_ledger(jobs: DataFrame) -> DataFrame:
    """Runs newest first, with whether attempts remain."""
    return jobs.withColumn(
        "exhausted", F.col("attempts") >= F.col("maximum_attempts")
    ).orderBy(F.col("created_at").desc(), "job_id")


def run_totals(jobs: DataFrame) -> DataFrame:
    """Runs per job type: succeeded, failed, waiting, attempts used and allowed."""
    def of(*states: str):
        return F.count_if(F.col("status").isin(*states))

    return jobs.groupBy("job_type").agg(
        F.count(F.lit(1)).alias("runs"),
        of("SUCCEEDED").alias("succeeded"),
        of("FAILED").alias("failed"),
        of("QUEUED", "RUNNING").alias("open"),
        F.sum("attempts").alias("attempts"),
        F.sum("maximum_attempts").alias("attempt_budget"),
    )


def audit_search(events: DataFrame, action: str | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """Audit events of an action whose JSON metadata holds the given values, newest first."""
    if action is not None:
        events = events.filter(F.col("action") == action)
    for key, value in (metadata or {}).items():
        events = events.filter(F.get_json_object("metadata_json", f"$.{key}") == value)
    return events.orderBy(F.col("occurred_at").desc(), "event_id")


def sources_by_site(establishments: DataFrame, sources: DataFrame) -> DataFrame:
    """Every establishment with its source systems; one without any is kept."""
    return establishments.join(sources, "establishment_id", "left").orderBy("establishment_id", "source_key")
