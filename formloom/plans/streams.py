"""Streaming operators over the event and order files, drained and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.operators import quality
from formloom.plans.answers import decided_sql, event_canonical, event_entries
from formloom.plans.bridge import VIEWS
from formloom.plans.registry import Source, query
from formloom.session import fresh_path
from formloom.streaming import counters, ingest, supersession


def table_stream(src: Source, name: str) -> DataFrame:
    # A pattern, because a stream takes a folder or a pattern; it matches one file and a folder alike.
    return ingest.file_stream(src.spark, f"{src.folder}/{name}.[p]arquet", src.table(name).schema)


def outcome_stream(src: Source) -> DataFrame:
    return table_stream(src, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("stage-"), (F.col("user_id") % 3).cast("string")).alias("stage"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("outcome"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (F.col("user_id") % 2).cast("string"))).otherwise("none").alias("failure_code"),
        (F.col("event_type") == "error").alias("is_error"),
        F.col("value"),
    ).withWatermark("ts", "1 day")


OUTCOME_SQL = """o AS (SELECT ts, 'stage-' || (user_id % 3) AS stage, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS outcome,
    CASE WHEN event_type = 'error' THEN 'E' || (user_id % 2) ELSE 'none' END AS failure_code, event_type = 'error' AS is_error, value FROM events)"""


@query(
    "q3_outcome_counters",
    sql=f"""WITH {OUTCOME_SQL} SELECT CAST(time_bucket(INTERVAL '15 minutes', ts) AS TIMESTAMP) AS window_start, stage, outcome, failure_code, count(*) AS events FROM o GROUP BY ALL""",
)
def q3_outcome_counters(src: Source) -> DataFrame:
    return ingest.drain_to_table(counters.outcome_counters(outcome_stream(src), "15 minutes"), "counters", "complete")


@query(
    "q3_outcome_counters_hourly",
    sql=f"""WITH {OUTCOME_SQL} SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS window_start, stage, outcome, failure_code, count(*) AS events FROM o GROUP BY ALL""",
)
def q3_outcome_counters_hourly(src: Source) -> DataFrame:
    return ingest.drain_to_table(counters.outcome_counters(outcome_stream(src), "1 hour"), "counters", "complete")


# The watermark after all events: a day before the latest. Windows that end by then are closed.
MARK_SQL = "(SELECT max(ts) - INTERVAL '1 day' FROM events)"


@query(
    "q3_closed_windows",
    sql=f"""WITH {OUTCOME_SQL}, c AS (SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS window_start, stage, outcome, failure_code, count(*) AS events FROM o GROUP BY ALL)
    SELECT * FROM c WHERE window_start + INTERVAL '1 hour' <= {MARK_SQL}""",
)
def q3_closed_windows(src: Source) -> DataFrame:
    """Each window once, when it is closed; its state goes then."""
    return ingest.drain_to_table(counters.outcome_counters(outcome_stream(src), "1 hour"), "closed")


@query(
    "q5_closed_latency",
    sql=f"""WITH {OUTCOME_SQL}, c AS (SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS window_start, stage, quantile_disc(value, 0.95) AS p95, count(*) AS samples FROM o GROUP BY 1, 2)
    SELECT * FROM c WHERE window_start + INTERVAL '1 day' <= {MARK_SQL}""",
)
def q5_closed_latency(src: Source) -> DataFrame:
    return ingest.drain_to_table(counters.latency_p95(outcome_stream(src), "1 day", "stage", "value"), "closed-latency")


RATES_SQL = f"""{OUTCOME_SQL}, s AS (SELECT ts, is_error, unnest(range(0, 6)) AS k FROM o),
    r AS (SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) - to_hours(k) AS w, count(*) FILTER (is_error) AS errors, count(*) AS total FROM s GROUP BY 1),
    rate AS (SELECT w + INTERVAL '6 hours' AS ended, errors, total, errors / greatest(CAST(total AS DOUBLE), 1.0) AS ratio FROM r)"""


@query("q4_error_rates", sql=f"WITH {RATES_SQL} SELECT ended AS window_end, errors, total, ratio FROM rate")
def q4_error_rates(src: Source) -> DataFrame:
    rates = counters.error_rates(outcome_stream(src), "6 hours", "1 hour", 1.0)
    flat = rates.select(F.col("w.end").alias("window_end"), "errors", "total", "ratio")
    return ingest.drain_to_table(flat, "rates", "complete")


@query(
    "q4_error_rate_alert",
    sql=f"""WITH {RATES_SQL}, b AS (SELECT ended, ratio, unnest(range(0, 3)) AS k FROM rate WHERE ratio > 0.25)
    SELECT ended - to_hours(k) + INTERVAL '3 hours' AS fired_at, count(*) AS breaches, max(ratio) AS worst FROM b GROUP BY 1 HAVING count(*) >= 3""",
)
def q4_error_rate_alert(src: Source) -> DataFrame:
    events = src.table("events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("is_error"))
    rates = counters.error_rates(events, "6 hours", "1 hour", 1.0)
    return counters.sustained_alerts(rates, 0.25, "1 hour", "3 hours", 3)


@query(
    "q4_alert_stream",
    sql=f"""WITH {RATES_SQL}, b AS (SELECT ended, ratio, unnest(range(0, 3)) AS k FROM rate WHERE ratio > 0.25 AND ended <= {MARK_SQL})
    SELECT ended + to_hours(k) AS fired_at, count(*) AS breaches, max(ratio) AS worst FROM b WHERE ended + to_hours(k) <= {MARK_SQL}
    GROUP BY 1 HAVING count(*) >= 3""",
)
def q4_alert_stream(src: Source) -> DataFrame:
    """Alerts over the stream itself, in append mode."""
    alerts = counters.alert_stream(outcome_stream(src), "6 hours", "1 hour", "3 hours", 3, 0.25)
    return ingest.drain_to_table(alerts, "alerts")


@query(
    "q5_latency_p95",
    sql=f"""WITH {OUTCOME_SQL} SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS window_start, stage, quantile_disc(value, 0.95) AS p95, count(*) AS samples FROM o GROUP BY 1, 2""",
)
def q5_latency_p95(src: Source) -> DataFrame:
    return ingest.drain_to_table(counters.latency_p95(outcome_stream(src), "1 day", "stage", "value"), "latency", "complete")


@query(
    "q6_freshness",
    sql="""SELECT event_type, max(ts) AS latest, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1""",
)
def q6_freshness(src: Source) -> DataFrame:
    updates = src.table("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return counters.freshness(updates, "event_type", F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query(
    "q1_stream_canonicalize",
    "b_answers",
    sql=f"WITH {decided_sql()} SELECT establishment_id, state, decision, count(*) AS answers FROM decided GROUP BY 1, 2, 3",
)
def q1_stream_canonicalize(src: Source) -> DataFrame:
    entries = event_entries(src)

    def decide(batch: DataFrame) -> DataFrame:
        answers = batch.sparkSession.sql(VIEWS["b_answers"], events=batch)
        decided = quality.judge(event_canonical(answers), entries)
        return decided.select("event_id", "establishment_id", "state", "decision")

    path = fresh_path(src.spark, "decisions")
    ingest.stream_canonicalize(table_stream(src, "events"), decide, path, fresh_path(src.spark, "decisions-state"))
    return src.spark.read.parquet(path).groupBy("establishment_id", "state", "decision").agg(F.count(F.lit(1)).alias("answers"))


@query(
    "q2_stream_dedupe",
    sql="SELECT event_type, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1",
)
def q2_stream_dedupe(src: Source) -> DataFrame:
    # Every event arrives twice.
    once = table_stream(src, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    again = table_stream(src, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    unique = ingest.drain_to_table(ingest.stream_dedupe(once.unionByName(again), "event_id", "ts", "40 days"), "unique")
    return unique.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("id_sum"))


@query(
    "q7_stream_supersession",
    "b_chain",
    sql="""WITH claim AS (SELECT event_id AS claimant, patient_id, supersedes_event_id AS target FROM b_chain WHERE lifecycle_status IN ('CORRECTED', 'VOIDED')
        AND supersedes_event_id IS NOT NULL),
    n AS (SELECT target, count(*) AS n, min(claimant) AS claimant, min(patient_id) AS p FROM claim WHERE target <> claimant GROUP BY 1)
    SELECT CAST(c.event_id AS VARCHAR) AS answer_id, CASE WHEN n.n IS NULL THEN 'CURRENT' WHEN n.p = c.patient_id THEN 'SUPERSEDED' ELSE 'INVALID_SUPERSESSION' END AS change,
      CAST(n.claimant AS VARCHAR) AS claimant FROM b_chain c LEFT JOIN n ON n.target = c.event_id WHERE n.n IS NULL OR n.n = 1
    UNION ALL SELECT CAST(target AS VARCHAR), 'AMBIGUOUS_SUPERSESSION', CAST(claimant AS VARCHAR) FROM claim WHERE target <> claimant AND target IN (SELECT target FROM n WHERE n > 1)
    UNION ALL SELECT CAST(claimant AS VARCHAR), 'INVALID_SUPERSESSION', CAST(claimant AS VARCHAR) FROM claim WHERE target = claimant""",
)
def q7_stream_supersession(src: Source) -> DataFrame:
    chain = src.spark.sql(VIEWS["b_chain"], orders=table_stream(src, "orders"))
    answers = chain.withColumn("entity", F.col("patient_id").cast("string"))
    root = fresh_path(src.spark, "supersession")
    supersession.stream_supersession(answers, root, fresh_path(src.spark, "supersession-state"))
    return src.spark.read.parquet(f"{root}/changes").select("answer_id", "change", "claimant")
