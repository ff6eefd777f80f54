"""Immutable research releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.identity import content_hash, release_key
from formloom.operators.ordering import previous_row, running
from formloom.session import cut

MEMBER = ["omop_table", "omop_fact_id"]


def roll_forward_membership(parent: DataFrame, facts: DataFrame, release_id: Column) -> DataFrame:
    """Members of a child release: those of its parent and the new facts, each fact once.

    A fact is known by its clinical event and table. Its integer id is carried along and may be
    shared with another fact without either being lost.
    """
    inherited = parent.select("clinical_event_id", *MEMBER)
    added = facts.select("clinical_event_id", *MEMBER)
    members = inherited.unionByName(added).groupBy("clinical_event_id", "omop_table").agg(
        F.min("omop_fact_id").alias("omop_fact_id")
    )
    return members.withColumn("release_id", release_id)


def release_ledger(batches: DataFrame) -> DataFrame:
    """Releases in publication order: content id, parent and cumulative counts.

    ``batches``: ``batch_id, created_at, mapping_release_id, source_manifest_checksum,
    output_checksum, published, quarantined``. The content id covers the batch, not the parent's
    id, so ids need no chain of dependent hashes.
    """
    core = content_hash(
        mapping_release_id="mapping_release_id",
        source_manifest_checksum="source_manifest_checksum",
        output_checksum="output_checksum",
        batch_id="batch_id",
    )
    named = batches.withColumn("release_id", release_key("release", core))
    totals = running(
        named, ["created_at", "batch_id"],
        sums={"published_count": "published", "quarantined_count": "quarantined"}, index="_position",
    )
    totals = cut(totals, "ledger")
    parents = totals.select((F.col("_position") + 1).alias("_position"), F.col("release_id").alias("parent_release_id"))
    return totals.join(parents, "_position", "left").drop("_position")


def verify_releases(releases: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Stored against recomputed checksum of each release, with a reason where they differ."""
    joined = releases.join(artifacts, "release_id", "left")
    same = F.col("artifact_checksum") == F.col("checksum_sha256")
    reason = F.when(F.col("artifact_checksum").isNull(), "No artifact is stored").when(
        ~same, "Stored and computed checksum differ"
    )
    return joined.select(
        "release_id", F.coalesce(same, F.lit(False)).alias("verified"), reason.alias("reason"), "checksum_sha256"
    )


def compare_releases(releases: DataFrame, metrics: DataFrame, concept_key: str) -> DataFrame:
    """Site counts of one concept per release, in release order: the nested report in long form."""
    own = metrics.filter(F.col("concept_key") == concept_key)
    return (
        releases.join(own, F.col("release_id") == F.col("research_release_id"))
        .select(
            "release_id", "parent_release_id", "published_count", "quarantined_count", "created_at",
            "establishment_id", "recorded_count", "usable_count", "positive_count",
        )
        .orderBy("created_at", "establishment_id")
    )


def finalize_check(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Findings that forbid publication: (finding, partition_id, detail); empty when all is well.

    ``expected``: ``partition_id, first_row, end_row`` (half open); ``rows``: ``partition_id,
    event_id``. Partitions must be there, complete and contiguous, and event ids unique.
    """
    counts = rows.groupBy("partition_id").agg(F.count(F.lit(1)).alias("actual"))
    size = F.col("end_row") - F.col("first_row")

    def finding(df: DataFrame, name: str, detail: Column) -> DataFrame:
        return df.select(F.lit(name).alias("finding"), "partition_id", detail.cast("string").alias("detail"))

    none = F.lit(None)
    paired = expected.join(counts, "partition_id", "left")
    missing = finding(paired.filter(F.col("actual").isNull() & (size > 0)), "MISSING_PARTITION", none)
    short = finding(paired.filter(F.col("actual") != size), "COUNT_MISMATCH", F.col("actual"))
    unexpected = finding(counts.join(expected, "partition_id", "left_anti"), "UNEXPECTED_PARTITION", F.col("actual"))
    chained = previous_row(expected, [], ["first_row"], ["end_row"])
    gap = finding(
        chained.filter(F.col("prev_end_row") != F.col("first_row")), "NOT_CONTIGUOUS", F.col("prev_end_row")
    )
    repeated = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("partition_id").alias("partition_id"))
    duplicate = finding(repeated.filter("n > 1"), "DUPLICATE_EVENT_ID", F.col("event_id"))
    return missing.unionByName(short).unionByName(unexpected).unionByName(gap).unionByName(duplicate)


def latest_release(releases: DataFrame) -> DataFrame:
    """The newest release; ties go to the greater id."""
    return releases.orderBy(F.col("created_at").desc(), F.col("release_id").desc()).limit(1)


def release_ancestry(releases: DataFrame, release_id: str) -> DataFrame:
    """The release and all its ancestors with their distance, nearest first.

    By pointer doubling: after k rounds all ancestors within ``2 ** k`` steps are known, so a chain of
    n releases takes about log n rounds, each one join. Rounds end when no release has an ancestor as
    far away as the next step; a cycle of parents ends there too, as no ancestor is counted twice. No join
    broadcasts: over the rounds that would send the history to the driver many times.
    """
    known = releases.filter("parent_release_id IS NOT NULL").select("release_id", "parent_release_id")
    step = cut(known.select("release_id", F.col("parent_release_id").alias("up")).distinct(), "ancestors")
    existing = cut(releases.select("release_id").distinct(), "releases")
    found = cut(existing.filter(F.col("release_id") == release_id).select("release_id", F.lit(0).alias("depth")), "lineage")
    most, length = existing.count(), 1
    while length <= most and not step.isEmpty():
        further = found.join(step.hint("merge"), "release_id").select(F.col("up").alias("release_id"), (F.col("depth") + length).alias("depth"))
        both = found.unionByName(further.join(existing.hint("merge"), "release_id", "left_semi"))
        found = cut(both.groupBy("release_id").agg(F.min("depth").alias("depth")), "lineage")
        onward = step.select(F.col("release_id").alias("up"), F.col("up").alias("next"))
        step = cut(step.join(onward.hint("merge"), "up").select("release_id", F.col("next").alias("up")), "ancestors")
        length *= 2
    return found.orderBy("depth")


def release_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members of two releases with ``change`` ADDED, REMOVED or KEPT, known by clinical event and table.

    The integer id is the new release's where it has the member; members may share one without being lost.
    """
    key = ["clinical_event_id", "omop_table"]
    sides = old.select(*key, F.col("omop_fact_id").alias("o"), F.lit(None).cast("bigint").alias("n"), F.lit(True).alias("was"), F.lit(False).alias("is")).unionByName(
        new.select(*key, F.lit(None).cast("bigint").alias("o"), F.col("omop_fact_id").alias("n"), F.lit(False).alias("was"), F.lit(True).alias("is"))
    )
    merged = sides.groupBy(*key).agg(F.min("o").alias("o"), F.min("n").alias("n"), F.max("was").alias("was"), F.max("is").alias("is"))
    change = F.when(~F.col("was"), "ADDED").when(~F.col("is"), "REMOVED").otherwise("KEPT")
    return merged.select(*key, F.coalesce("n", "o").alias("omop_fact_id"), change.alias("change"))
