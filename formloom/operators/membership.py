"""Release membership kept as deltas.

A release stores only what it adds to or removes from its parent. Now and then the whole membership of a release is
stored as a snapshot. Members are resolved by walking up to the nearest snapshot, by pointer doubling, and letting
the nearest change of each member win, so a child release costs its delta and a long history costs no long joins.
Members are known by clinical event and table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.identity import content_hash, integer_fact_id, release_key
from formloom.operators import catalog, omop, quality
from formloom.operators.releases import release_ancestry
from formloom.session import cut

KEY = ["clinical_event_id", "omop_table"]
ADD, REMOVE = "ADD", "REMOVE"


@dataclass(frozen=True)
class History:
    """``releases``: release_id, parent_release_id; ``deltas``: release_id, member columns, ``change``;
    ``snapshots``: release_id and member columns, all members of that release."""

    releases: DataFrame
    deltas: DataFrame
    snapshots: DataFrame


def members_of(history: History, release_id: str) -> DataFrame:
    """(clinical_event_id, omop_table, omop_fact_id) of a release. Of one release's changes of a member, ADD wins."""
    line = cut(release_ancestry(history.releases, release_id), "ancestry")
    base = history.snapshots.select("release_id").distinct().join(line, "release_id").orderBy("depth").limit(1)
    base = cut(base.select(F.col("release_id").alias("_base"), F.col("depth").alias("_least")), "base")
    since = line.join(base, F.col("depth") >= F.col("_least"), "left_anti")
    changes = history.deltas.join(since, "release_id").select(*KEY, "omop_fact_id", "depth", "change")
    stored = history.snapshots.join(base, F.col("release_id") == F.col("_base")).select(
        *KEY, "omop_fact_id", F.col("_least").alias("depth"), F.lit(ADD).alias("change")
    )
    last = changes.unionByName(stored).groupBy(*KEY).agg(F.min(F.struct("depth", "change", "omop_fact_id")).alias("last"))
    return last.filter(F.col("last.change") == ADD).select(*KEY, "last.omop_fact_id")


def delta(parent: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(member columns, change) that make a child of the parent's members: what is new, and what is there to remove."""
    fresh = added.groupBy(*KEY).agg(F.min("omop_fact_id").alias("omop_fact_id")).join(parent, KEY, "left_anti")
    out = fresh.select(*KEY, "omop_fact_id", F.lit(ADD).alias("change"))
    if removed is not None:
        gone = parent.join(removed.select(*KEY).distinct(), KEY, "left_semi")
        out = out.unionByName(gone.select(*KEY, "omop_fact_id", F.lit(REMOVE).alias("change")))
    return out


def snapshot_due(history: History, release_id: str, every: int) -> bool:
    """Whether ``every`` or more releases lie between a release and its nearest snapshot."""
    line = cut(release_ancestry(history.releases, release_id), "ancestry")
    nearest = history.snapshots.select("release_id").distinct().join(line, "release_id").agg(F.min("depth")).first()[0]
    return (line.count() if nearest is None else nearest) >= every


def with_snapshot(history: History, release_id: str) -> History:
    """The history with all members of a release stored."""
    rows = cut(members_of(history, release_id).withColumn("release_id", F.lit(release_id)), "snapshot")
    return History(history.releases, history.deltas, history.snapshots.unionByName(rows.select(*history.snapshots.columns)))


@dataclass(frozen=True)
class Child:
    """A release made from answers that were judged again: its row, its delta, its metrics, the records after it."""

    release: DataFrame
    delta: DataFrame
    metrics: DataFrame
    records: DataFrame


def replay(parent: DataFrame, parent_members: DataFrame, parent_metrics: DataFrame, metric_keys: list[str],
           canonical: DataFrame, records: DataFrame, entries: DataFrame, mapping_release_id: Column) -> Child:
    """Judge quarantined answers again and put what is published into a child of the parent release.

    ``parent`` is one row (release_id, published_count, quarantined_count). Nothing of the parent changes: the child
    inherits its members, adds the new facts, counts them as recorded at their site in every metric of that site,
    and leaves eligible counts alone.
    """
    again, after = quality.replay_quarantine(canonical, records, entries)
    facts = omop.project_facts(again).select(*KEY, integer_fact_id("fact_id").alias("omop_fact_id"))
    change = cut(delta(parent_members, facts), "delta")
    published = again.filter("decision = 'PUBLISH'")
    sums = change.agg(F.count(F.lit(1)).alias("_added"), F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64(*KEY).cast("decimal(20,0)"))), 256).alias("output_checksum"))
    solved = records.filter("status = 'OPEN'").agg(F.count(F.lit(1)).alias("_open")).crossJoin(
        after.filter("status = 'OPEN'").agg(F.count(F.lit(1)).alias("_left"))
    )
    # One row each.
    row = parent.withColumnRenamed("release_id", "parent_release_id").crossJoin(sums).crossJoin(solved).withColumn("mapping_release_id", mapping_release_id)
    key = content_hash(mapping_release_id="mapping_release_id", output_checksum="output_checksum", parent_release_id="parent_release_id")
    release = row.select(
        release_key("release", key).alias("release_id"), "parent_release_id", "mapping_release_id",
        (F.col("published_count") + F.col("_added")).alias("published_count"),
        F.greatest(F.col("quarantined_count") - F.col("_open") + F.col("_left"), F.lit(0)).alias("quarantined_count"),
    )
    sites = published.groupBy("establishment_id").agg(F.count(F.lit(1)).alias("recorded_count"))
    more = parent_metrics.select(*metric_keys).join(sites, "establishment_id").select(
        *metric_keys, "recorded_count", *[F.lit(0).cast("bigint").alias(n) for n in ("usable_count", "positive_count", "eligible_count")]
    )
    return Child(release, change, catalog.roll_forward(parent_metrics, more, metric_keys), after)
