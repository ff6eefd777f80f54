"""Governed mappings: release checks, exact resolution and test vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.answers import SCALAR, condition_holds
from formloom.functions.identity import canonical_json, multiset_digest, release_key
from formloom.operators.standardize import convert_unit, normalized_source
from formloom.session import broadcast_if_small, is_small

ENTRY_SCHEMA = f"""
    release_id string, vocabulary_release_id string, mapping_id string,
    item_path string, establishment_id string, source_fingerprint string,
    compatibility_fingerprint string, declared_source_type string,
    target_domain string, target_concept_id bigint, target_concept_code string,
    target_concept_name string, target_vocabulary_id string, standard_concept boolean,
    value_map map<string,{SCALAR}>, state_map map<string,string>,
    unit_source string, unit_target string, unit_multiplier decimal(38,18),
    unit_offset decimal(38,18), missing_codes array<string>, negative_codes array<string>
"""
SCOPE = ["item_path", "establishment_id", "source_fingerprint", "compatibility_fingerprint"]
LEVELS = ("SITE_OVERRIDE", "SOURCE_FINGERPRINT", "COMPATIBILITY_FINGERPRINT")


def _scope_table(entries: DataFrame, keys: list[str], level: int) -> DataFrame:
    """One row per scope key: the level, how many entries claim the key, and the body of one of them."""
    claim = F.struct(
        F.lit(level).alias("level"),
        F.count(F.lit(1)).alias("claims"),
        F.min_by(F.struct(*[c for c in entries.columns if c not in SCOPE]), F.struct("release_id", "mapping_id")).alias("entry"),
    )
    return entries.dropna(subset=keys).groupBy(*keys).agg(claim.alias(f"_claim{level}"))


def resolve(canonical: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``mapping`` (entry or null), ``resolution_level`` and ``resolution``.

    Priority: an entry of the answer's site (with its source fingerprint), then the source
    fingerprint, then the compatibility fingerprint, always on the same item path. Several entries
    at the best level are ambiguous, none at all is unknown. Entries are reduced to one row per
    scope key, which carries the entry's body, so the three equi-joins keep one row per answer, also
    where a release uses a mapping id twice. The entry side is broadcast where its counted size
    allows it, so answers stay where they are; otherwise Spark shuffles and splits hot paths.
    """
    hint = F.broadcast if is_small(entries) else lambda df: df
    shared = entries.filter("establishment_id IS NULL")
    sides = [
        (entries, ["item_path", "establishment_id", "source_fingerprint"]),
        (shared, ["item_path", "source_fingerprint"]),
        (shared, ["item_path", "compatibility_fingerprint"]),
    ]
    out = canonical
    for level, (side, keys) in enumerate(sides, start=1):
        out = out.join(hint(_scope_table(side, keys, level)), keys, "left")
    best = F.coalesce("_claim1", "_claim2", "_claim3")
    chosen = F.when(best["claims"] == 1, best["entry"])
    resolution = (
        F.when(best.isNull(), "UNKNOWN_MAPPING")
        .when(best["claims"] > 1, "AMBIGUOUS_MAPPING")
        .otherwise("RESOLVED")
    )
    return out.select(
        *canonical.columns, best["level"].alias("resolution_level"), resolution.alias("resolution"), chosen.alias("mapping")
    )


def release_violations(releases: DataFrame, entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(release, mapping, violation) for every broken governance rule.

    Each entry needs a fingerprint, a positive target concept and a test vector; mapping ids are
    unique in a release; author and approver differ.
    """
    same_people = releases.filter(F.col("authored_by") == F.col("approved_by")).select(
        "release_id", F.lit(None).cast("string").alias("mapping_id"), F.lit("MAKER_CHECKER").alias("violation")
    )
    per_entry = F.array_compact(
        F.array(
            F.when(
                F.col("source_fingerprint").isNull() & F.col("compatibility_fingerprint").isNull(),
                F.lit("FINGERPRINT_REQUIRED"),
            ),
            F.when(F.col("target_concept_id") <= 0, F.lit("CONCEPT_ID_RANGE")),
        )
    )
    shape = entries.select("release_id", "mapping_id", F.explode(per_entry).alias("violation"))
    duplicate = (
        entries.groupBy("release_id", "mapping_id")
        .count()
        .filter("count > 1")
        .select("release_id", "mapping_id", F.lit("DUPLICATE_MAPPING_ID").alias("violation"))
    )
    untested = (
        entries.select("release_id", "mapping_id")
        .distinct()
        .join(vectors.select("release_id", "mapping_id").distinct(), ["release_id", "mapping_id"], "left_anti")
        .withColumn("violation", F.lit("VECTOR_REQUIRED"))
    )
    return same_people.unionByName(shape).unionByName(duplicate).unionByName(untested)


def _same_scalar(left: Column, right: Column) -> Column:
    both_null = left.isNull() & right.isNull()
    return both_null | condition_holds(left, F.lit("eq"), right)


def run_vectors(vectors: DataFrame, entries: DataFrame) -> DataFrame:
    """Every vector with what the mapping makes of it and whether that is expected.

    Vectors follow the rules of the release gate, which differ from the run-time path in two
    points: the value map's result is what is converted, and a unit mismatch yields no value.
    """
    e = entries.select(
        "release_id", "mapping_id", "value_map", "state_map", "unit_source", "unit_target",
        "unit_multiplier", "unit_offset", "missing_codes", "negative_codes",
    )
    joined = vectors.join(broadcast_if_small(e), ["release_id", "mapping_id"])
    state = F.coalesce(F.try_element_at("state_map", F.col("source_state")), F.col("source_state"))
    joined = joined.withColumn("_state", state).withColumn(
        "_code", F.when((F.col("_state") == "PRESENT"), normalized_source(F.col("source_value")))
    )
    missing = F.coalesce(F.array_contains("missing_codes", F.col("_code")), F.lit(False))
    negative = F.coalesce(F.array_contains("negative_codes", F.col("_code")), F.lit(False))
    open_value = F.col("_code").isNotNull() & ~missing & ~negative
    mapped = F.when(
        F.coalesce(F.size("value_map"), F.lit(0)) > 0, F.try_element_at("value_map", F.col("_code"))
    ).otherwise(F.col("source_value"))
    joined = joined.withColumn("_mapped", F.when(open_value, mapped))
    has_rule = F.col("unit_source").isNotNull()
    unit_fits = F.col("source_unit").eqNullSafe(F.col("unit_source"))
    converted = convert_unit(F.col("_mapped"), F.col("unit_multiplier"), F.col("unit_offset"))
    observed_state = (
        F.when(missing, "UNKNOWN").when(negative, "EXPLICITLY_ABSENT").otherwise(F.col("_state"))
    )
    observed_value = F.when(
        open_value,
        F.when(~has_rule, F.col("_mapped")).when(unit_fits, converted),
    )
    keeps_unit = open_value | (F.col("_code").isNull() & (F.col("_state") == "PRESENT"))
    observed_unit = F.when(
        keeps_unit,
        F.when(open_value & has_rule & unit_fits, F.col("unit_target")).otherwise(F.col("source_unit")),
    )
    out = (
        joined.withColumn("observed_state", observed_state)
        .withColumn("observed_value", observed_value)
        .withColumn("observed_unit", observed_unit)
    )
    passed = (
        (F.col("observed_state") == F.col("expected_state"))
        & _same_scalar(F.col("observed_value"), F.col("expected_value"))
        & F.col("observed_unit").eqNullSafe(F.col("expected_unit"))
    )
    return out.withColumn("passed", passed).select(
        *vectors.columns, "observed_state", "observed_value", "observed_unit", "passed"
    )


def release_checksum(releases: DataFrame, rows: DataFrame, row_hash: Column) -> DataFrame:
    """Adds ``computed_checksum`` over a release header and the bag of its governed rows."""
    bags = rows.withColumn("_h", row_hash).groupBy("release_id").agg(multiset_digest("_h").alias("_bag"))
    header = canonical_json(
        schema_version=F.lit("1.0"),
        parent_release_id="parent_release_id",
        vocabulary_release_id="vocabulary_release_id",
        authored_by="authored_by",
        approved_by="approved_by",
        approved_at=F.date_format("approved_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        entries="_bag",
    )
    return releases.join(bags, "release_id", "left").withColumn(
        "computed_checksum", F.sha2(header, 256)
    ).drop("_bag")


def verify_release_checksum(releases: DataFrame, rows: DataFrame, row_hash: Column) -> DataFrame:
    """Recomputed against stored checksum."""
    return release_checksum(releases, rows, row_hash).withColumn(
        "verified", F.col("computed_checksum").eqNullSafe(F.col("payload_checksum_sha256"))
    )


def release_identity(releases: DataFrame, rows: DataFrame, row_hash: Column) -> DataFrame:
    """Adds ``content_release_id``, the id derived from everything the release governs."""
    return release_checksum(releases, rows, row_hash).withColumn(
        "content_release_id", release_key("mapping", F.col("computed_checksum"))
    )


def select_release(forms: DataFrame, releases: DataFrame, entries: DataFrame) -> DataFrame:
    """Latest approved release that covers a form's source or compatibility fingerprint.

    A form that names ``requested_release_id`` only accepts that release. Where ``releases`` says which are
    ``verified`` (see ``verify_release_checksum``), others are never chosen, also when they are asked for.
    Coverage is reduced to the best release per fingerprint before it meets the forms.
    """
    sound = releases.filter("verified") if "verified" in releases.columns else releases
    approved = entries.join(sound.select("release_id", "approved_at"), "release_id")
    keys = {"source_fingerprint": "_by_source", "compatibility_fingerprint": "_by_compat"}
    out = forms
    best = F.struct("approved_at", "release_id")
    for key, tag in keys.items():
        cover = approved.dropna(subset=[key]).groupBy(key).agg(F.max(best).alias(tag))
        asked = approved.dropna(subset=[key]).select(
            key, F.col("release_id").alias("requested_release_id"), F.lit(True).alias(f"{tag}_asked")
        ).distinct()
        out = out.join(cover, key, "left").join(asked, [key, "requested_release_id"], "left")
    latest = F.greatest("_by_source", "_by_compat")
    asked = F.coalesce("_by_source_asked", "_by_compat_asked")
    chosen = F.when(
        F.col("requested_release_id").isNotNull(), F.when(asked, F.col("requested_release_id"))
    ).otherwise(latest["release_id"])
    return out.withColumn("selected_release_id", chosen).drop(
        *keys.values(), *[f"{tag}_asked" for tag in keys.values()]
    )


def draft_queue(drafts: DataFrame, forms: DataFrame) -> DataFrame:
    """Mapping drafts with the form they concern, newest first."""
    return drafts.join(forms, ["form_id", "form_version"]).orderBy(
        F.col("created_at").desc(), F.col("draft_id")
    )
