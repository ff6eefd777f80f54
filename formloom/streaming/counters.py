"""Operational counters over event time; each works on a batch and on a watermarked stream.

In append mode a window is given out once, after the watermark has passed it, and its state goes: counters and the
mergeable percentile sketches then take space for the open windows only, however long the stream runs. Events
later than the watermark allows are counted by the query's progress (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome_counters(events: DataFrame, width: str = "15 minutes") -> DataFrame:
    """Events per tumbling window, stage, outcome and failure code.

    ``events``: ``ts, stage, outcome, failure_code``.
    """
    return (
        events.groupBy(F.window("ts", width).alias("w"), "stage", "outcome", "failure_code")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("window_start"), "stage", "outcome", "failure_code", "events")
    )


def error_rates(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute", floor: float = 1.0) -> DataFrame:
    """Share of errors per sliding window; the denominator is at least ``floor``.

    ``events``: ``ts, is_error``. Keeps the window column so that it can be aggregated again.
    """
    counted = events.groupBy(F.window("ts", width, slide).alias("w")).agg(
        F.count_if("is_error").alias("errors"), F.count(F.lit(1)).alias("total")
    )
    return counted.withColumn("ratio", F.col("errors") / F.greatest(F.col("total").cast("double"), F.lit(floor)))


def sustained_alerts(
    rates: DataFrame, threshold: float, slide: str, sustain: str, slides: int
) -> DataFrame:
    """End times at which the ratio has exceeded the threshold for ``slides`` slides on end.

    A second window counts the breaching slides of the last ``sustain``; all of them must breach.
    """
    breaching = rates.filter(F.col("ratio") > threshold).select(F.col("w.end").alias("ended"), "ratio")
    return (
        breaching.groupBy(F.window("ended", sustain, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("breaches"), F.max("ratio").alias("worst"))
        .filter(F.col("breaches") >= slides)
        .select(F.col("w.end").alias("fired_at"), "breaches", "worst")
    )


def alert_stream(
    events: DataFrame, width: str, slide: str, sustain: str, slides: int, threshold: float, floor: float = 1.0
) -> DataFrame:
    """``sustained_alerts`` as two chained windows of one stream, for append mode.

    ``events``: ``ts`` with a watermark, ``is_error``. The rate of a sliding window is known when the watermark
    has passed it; it then counts in the windows of ``sustain`` that hold its end. An alert is given once, when no
    event can change it any more, and both windows' state goes with the watermark.
    """
    rates = error_rates(events, width, slide, floor).filter(F.col("ratio") > threshold)
    return (
        rates.groupBy(F.window("w", sustain, slide).alias("s"))
        .agg(F.count(F.lit(1)).alias("breaches"), F.max("ratio").alias("worst"))
        .filter(F.col("breaches") >= slides)
        .select(F.col("s.end").alias("fired_at"), "breaches", "worst")
    )


def latency_p95(samples: DataFrame, width: str, key: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """95th percentile per window and key, from a mergeable sketch."""
    return (
        samples.groupBy(F.window("ts", width).alias("w"), key)
        .agg(F.percentile_approx(value, 0.95, accuracy).alias("p95"), F.count(F.lit(1)).alias("samples"))
        .select(F.col("w.start").alias("window_start"), key, "p95", "samples")
    )


def freshness(updates: DataFrame, key: str, now: Column) -> DataFrame:
    """Whole seconds since the latest update of each key."""
    latest = updates.groupBy(key).agg(F.max("ts").alias("latest"))
    return latest.withColumn("seconds", F.unix_timestamp(now) - F.unix_timestamp("latest"))
