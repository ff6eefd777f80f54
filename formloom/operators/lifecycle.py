"""Correction and void chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import cut

ENTITY = ["patient_pseudonym", "form_id", "item_path", "group_instance"]
# Order in which a reason wins where several apply to one answer.
REASONS = (
    "DUPLICATE_EVENT_ID",
    "INVALID_SUPERSESSION",
    "AMBIGUOUS_SUPERSESSION",
    "CYCLIC_SUPERSESSION",
)


def supersession_links(canonical: DataFrame) -> DataFrame:
    """(event_id, target, pos, entity) of every correction or void."""
    steps = canonical.select("event_id", *ENTITY, F.posexplode("lifecycle").alias("pos", "step"))
    return steps.filter(F.col("step.status").isin("CORRECTED", "VOIDED")).select(
        "event_id",
        "pos",
        F.col("step.supersedes_event_id").alias("target"),
        F.struct(*ENTITY).alias("entity"),
    )


def classify_links(canonical: DataFrame) -> DataFrame:
    """Links with ``reason`` null where they may be followed.

    A target must exist, differ from its superseder and belong to the same patient, form, item and
    group instance, and only one event may supersede it.
    """
    links = supersession_links(canonical)
    targets = canonical.groupBy(F.col("event_id").alias("target")).agg(
        F.min(F.struct(*ENTITY)).alias("target_entity")
    )
    checked = links.join(targets, "target", "left")
    invalid = (
        F.col("target_entity").isNull()
        | (F.col("target") == F.col("event_id"))
        | ~F.col("entity").eqNullSafe(F.col("target_entity"))
    )
    checked = checked.withColumn("invalid", invalid)
    rivals = checked.filter(~F.col("invalid")).groupBy("target").agg(F.count(F.lit(1)).alias("claims"))
    reason = F.when(F.col("invalid"), "INVALID_SUPERSESSION").when(
        F.col("claims") > 1, "AMBIGUOUS_SUPERSESSION"
    )
    return checked.join(rivals, "target", "left").select(
        "event_id", "target", "pos", reason.alias("reason")
    )


def cyclic_origins(edges: DataFrame) -> DataFrame:
    """``event_id`` of every edge from which following the links never ends.

    ``edges`` has at most one row per ``event_id``. Pointer doubling: after k rounds only origins
    with 2^k further links remain, so chains of length n take log2(n) joins on unique keys.
    """
    start = cut(edges.select("event_id", "target"), "links")
    total = start.count()
    jumps, reach = start, 1
    while reach <= total:
        onward = jumps.select(F.col("event_id").alias("target"), F.col("target").alias("_next"))
        jumps = cut(jumps.join(onward, "target").select("event_id", F.col("_next").alias("target")), "jumps")
        if jumps.isEmpty():
            break
        reach *= 2
    return jumps.select("event_id")


def resolve_lifecycle(canonical: DataFrame, fail_on_error: bool = False) -> DataFrame:
    """Marks superseded answers and clears their value; ``lifecycle_error`` names what is wrong.

    A link with an error is not followed. With ``fail_on_error`` the first error raises instead.
    """
    canonical = cut(canonical, "lifecycle-input")  # read by the links, the duplicates and the result
    links = cut(classify_links(canonical), "classified")
    good = links.filter("reason IS NULL")
    followed = good.groupBy("event_id").agg(F.max_by("target", "pos").alias("target"))
    cyclic = cyclic_origins(followed)
    duplicates = canonical.groupBy("event_id").count().filter("count > 1").select("event_id")
    found = (
        links.filter("reason IS NOT NULL")
        .select("event_id", "reason")
        .unionByName(cyclic.withColumn("reason", F.lit("CYCLIC_SUPERSESSION")))
        .unionByName(duplicates.withColumn("reason", F.lit("DUPLICATE_EVENT_ID")))
    )
    rank = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    errors = found.groupBy("event_id").agg(F.min_by("reason", rank).alias("lifecycle_error"))
    if fail_on_error:
        first = errors.take(1)
        if first:
            raise ValueError(f"{first[0]['lifecycle_error']}: {first[0]['event_id']}")
    superseded = (
        good.join(cyclic, "event_id", "left_anti")
        .select(F.col("target").alias("event_id"), F.lit(True).alias("_superseded"))
        .distinct()
    )
    marked = canonical.join(superseded, "event_id", "left").join(errors, "event_id", "left")
    gone = F.coalesce(F.col("_superseded"), F.lit(False))
    return (
        marked.withColumn("state", F.when(gone, "SUPERSEDED").otherwise(F.col("state")))
        .withColumn("value", F.when(~gone, F.col("value")))
        .drop("_superseded")
    )
