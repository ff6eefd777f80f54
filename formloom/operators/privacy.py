"""Aggregate exports that carry no patient-level data."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.functions.identity import canonical_json, multiset_digest
from formloom.operators.checksums import row_hash
from formloom.operators.releases import latest_release

COUNTS = ("recorded_count", "usable_count", "positive_count")
DEFAULT_THRESHOLD = 10
REDACTED = "[REDACTED]"
# Fragments of field names whose values are withheld from logs.
SENSITIVE_FRAGMENTS = (
    "answer",
    "authorization",
    "clinical_text",
    "cookie",
    "patient",
    "person_source_value",
    "pseudonym",
    "secret",
    "session",
    "token",
)
_METRIC = ["concept_key", "period_start", "eligible_count", *COUNTS, "suppressed"]


def suppress_small_cells(metrics: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Hides a row's counts where any non-zero count lies below the threshold.

    Suppression is primary only: the eligible count is hidden with the rest but not tested, and
    totals are not protected.
    """
    visible = None
    for name in COUNTS:
        fine = (F.col(name) == 0) | (F.col(name) >= threshold)
        visible = fine if visible is None else visible & fine
    shown = {name: F.when(visible, F.col(name)).otherwise(F.lit(0).cast("bigint")) for name in COUNTS}
    return metrics.withColumns(
        {"suppressed": ~visible, "eligible_count": F.when(visible, F.col("eligible_count")), **shown}
    )


def _header_checksum() -> Column:
    return F.sha2(
        canonical_json(
            schema_version=F.lit("1.0"),
            establishment_id="establishment_id",
            mapping_release_id="mapping_release_id",
            research_release_id="research_release_id",
            minimum_cell_threshold="minimum_cell_threshold",
            metrics="_bag",
        ),
        256,
    )


def _bags(metrics: DataFrame) -> DataFrame:
    return (
        metrics.withColumn("_h", row_hash(*_METRIC))
        .groupBy("establishment_id", "research_release_id")
        .agg(multiset_digest("_h").alias("_bag"), F.count(F.lit(1)).alias("metric_count"))
    )


def build_site_bundle(
    releases: DataFrame, metrics: DataFrame, establishment_id: str, threshold: int = DEFAULT_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """Header row and suppressed metrics of one site for the latest release.

    A site without metrics yields no header.
    """
    latest = latest_release(releases).select(
        F.col("release_id").alias("research_release_id"), "mapping_release_id", F.col("created_at").alias("generated_at")
    )
    own = metrics.filter(F.col("establishment_id") == establishment_id).join(
        F.broadcast(latest), "research_release_id"
    )
    shown = suppress_small_cells(own, threshold)
    body = shown.select("establishment_id", "research_release_id", *_METRIC)
    header = (
        _bags(body)
        .join(F.broadcast(latest), "research_release_id")
        .withColumn("minimum_cell_threshold", F.lit(threshold))
        .withColumn("payload_checksum", _header_checksum())
        .drop("_bag")
    )
    return header, guard_aggregate(body)


def import_site_bundles(headers: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics of the bundles whose recomputed checksum matches their header, merged."""
    key = ["establishment_id", "research_release_id"]
    checked = headers.drop("metric_count").join(_bags(metrics), key)
    accepted = checked.filter(_header_checksum() == F.col("payload_checksum")).select(*key)
    return metrics.join(accepted, key, "left_semi")


def _sensitive(name: str) -> bool:
    folded = name.casefold()
    return any(fragment in folded for fragment in SENSITIVE_FRAGMENTS)


def _clean(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = [
            (F.lit(REDACTED) if _sensitive(f.name) else _clean(value[f.name], f.dataType)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(value, lambda item: _clean(item, kind.elementType))
    if isinstance(kind, T.MapType):
        # A value that is no text cannot say that it was removed, so it becomes null.
        removed = F.lit(REDACTED if isinstance(kind.valueType, T.StringType) else None).cast(kind.valueType)

        def cleaned(key: Column, item: Column) -> Column:
            folded = F.lower(key.cast("string"))
            hidden = reduce(or_, [folded.contains(fragment) for fragment in SENSITIVE_FRAGMENTS])
            return F.when(hidden, removed).otherwise(_clean(item, kind.valueType))

        return F.transform_values(value, cleaned)
    return value


def redact(df: DataFrame) -> DataFrame:
    """Replaces every column, struct field, array element field or map value of a sensitive name.

    The schema decides what is rewritten, so the rewriting is a projection.
    """
    columns = [
        (F.lit(REDACTED) if _sensitive(f.name) else _clean(F.col(f.name), f.dataType)).alias(f.name)
        for f in df.schema.fields
    ]
    return df.select(*columns)


def guard_aggregate(df: DataFrame) -> DataFrame:
    """``df`` itself, unless its schema holds a patient or answer column."""

    def names(kind: T.DataType, prefix: str) -> list[str]:
        if isinstance(kind, T.StructType):
            return [n for f in kind.fields for n in [prefix + f.name, *names(f.dataType, f"{prefix}{f.name}.")]]
        if isinstance(kind, T.ArrayType):
            return names(kind.elementType, prefix)
        return []

    forbidden = [n for n in names(df.schema, "") if _sensitive(n.rsplit(".", 1)[-1])]
    if forbidden:
        raise ValueError(f"aggregate output carries patient-level columns: {forbidden}")
    return df
