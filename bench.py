"""Headline timings; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_EVENTS (default
20,000,000 generated answer events) set the size.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from formloom.plans import registry
from formloom.session import fresh_path, local_session
from formloom.sources import synthetic

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
EVENTS = int(os.environ.get("BENCH_EVENTS", "20000000"))
HEADLINE = (
    "e1_answer_state",
    "e13_canonicalize_eav",
    "e14_canonicalize_structured",
    "f1_resolve_mappings",
    "g5_standardize",
    "h2_decide",
    "k5_batch_summary",
    "e11_resolve_lifecycle",
    "k1_coverage",
    "n4_extract_assertions",
    "j1_roll_forward_membership",
    "c6_stage_checksum",
    "i8_check_foreign_keys",
)


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    spark = local_session(CPUS, "formloom-bench")
    every = registry.queries()

    def run(name: str) -> None:
        every[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    def answers():
        return synthetic.synthetic_answers(spark.range(EVENTS))

    def counts() -> None:
        decided = answers().groupBy(synthetic.decision_of(F.col("answer_state")).alias("decision")).count()
        found = {row["decision"]: row["count"] for row in decided.collect()}
        # Three of six states are published; the closed form checks the run.
        full, rest = divmod(EVENTS, 6)
        assert found["PUBLISH"] == 3 * full + min(rest, 3), found

    def write() -> None:
        answers().write.option("compression", "zstd").option("maxRecordsPerFile", 50_000).parquet(fresh_path(spark, "bench"))

    timings = {}
    for name in HEADLINE:
        run(name)
        timings[name] = timed(lambda: run(name))
    timings["a11_generate_and_decide"] = timed(counts)
    timings["a11_generate_and_write"] = timed(write)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "events": EVENTS,
                "decide_events_per_second": round(EVENTS / timings["a11_generate_and_decide"]),
                "write_events_per_second": round(EVENTS / timings["a11_generate_and_write"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
