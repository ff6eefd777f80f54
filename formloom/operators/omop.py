"""Projection of published answers to OMOP CDM 5.4 tables, and integrity checks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.functions.answers import NUMBER, plain_number
from formloom.functions.identity import FACT_ID_SPACE, deterministic_uuid, integer_fact_id
from formloom.operators.ordering import global_index, running
from formloom.session import cut

# The CDM table each target domain is published to.
TABLE_BY_DOMAIN = {
    "CONDITION": "condition_occurrence",
    "MEASUREMENT": "measurement",
    "OBSERVATION": "observation",
    "NOTE": "note",
    "NOTE_NLP": "note_nlp",
}


def route_domain(domain: Column) -> Column:
    """CDM table of a domain; null for a domain that has none."""
    table = F.create_map(*[F.lit(part) for pair in TABLE_BY_DOMAIN.items() for part in pair])
    return F.try_element_at(table, domain)


def project_facts(decisions: DataFrame) -> DataFrame:
    """Published answers as facts, at most one value column filled.

    Numbers go to ``value_as_number``, everything else that is present to ``value_as_string``
    (booleans as true/false), an explicit absence to its own name.
    """
    value, state = F.col("clinical_value"), F.col("clinical_state")
    present = (state == "PRESENT") & value.isNotNull()
    number = F.when(present & (value["t"] == "num"), value["num"])
    text = (
        F.when(present & (value["t"] == "bool"), F.lower(value["s"]))
        .when(present & (value["t"] != "num"), value["s"])
        .when(state == "EXPLICITLY_ABSENT", F.lit("EXPLICITLY_ABSENT"))
    )
    published = decisions.filter("decision = 'PUBLISH' AND clinical_event_id IS NOT NULL")
    facts = published.withColumn("omop_table", route_domain(F.col("target_domain"))).select(
        "clinical_event_id",
        "event_id",
        "establishment_id",
        "omop_table",
        F.col("patient_pseudonym").alias("person_source_value"),
        F.col("target_concept_id").alias("concept_id"),
        F.col("authored_date").alias("event_date"),
        F.col("authored_at").cast("timestamp").alias("event_datetime"),
        number.cast(NUMBER).alias("value_as_number"),
        text.alias("value_as_string"),
        F.lit(None).cast("bigint").alias("value_as_concept_id"),
        F.col("clinical_unit").alias("unit_source_value"),
        "source_value",
    )
    return facts.withColumn(
        "fact_id", deterministic_uuid("omop-fact", "omop_table", "clinical_event_id", "concept_id")
    )


def assign_person_ids(pseudonyms: DataFrame, existing: DataFrame) -> DataFrame:
    """``person_source_value, person_id``: known pseudonyms keep their id, new ones follow on.

    New ids continue after the greatest known id in the order of the pseudonyms.
    """
    known = existing.select("person_source_value", "person_id")
    fresh = pseudonyms.select("person_source_value").distinct().join(known, "person_source_value", "left_anti")
    start = known.agg(F.coalesce(F.max("person_id"), F.lit(0)) + 1).scalar()
    numbered = global_index(fresh, "person_source_value", name="_i").select(
        "person_source_value", (F.col("_i") + start).cast("bigint").alias("person_id")
    )
    return known.unionByName(numbered)


def _free_slots(df: DataFrame, value: str, taken: DataFrame, mark: str) -> DataFrame:
    """Adds ``_below``, the number of ``taken`` values below ``value``."""
    rows = df.withColumn("_flag", F.lit(0)).withColumn("_v", F.col(value))
    marks = taken.select(F.col(mark).alias("_v"), F.lit(1).alias("_flag"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    counted = running(both, ["_v", "_flag"], sums={"_below": "_flag"})
    return counted.filter("_flag = 0").drop("_v", "_flag")


def resolve_id_collisions(
    rows: DataFrame, base: str, tie: str, name: str = "resolved_id",
    taken: DataFrame | None = None, space: int = FACT_ID_SPACE,
) -> DataFrame:
    """Unique ids ``1..space`` by linear probing from ``base``, in the order of base and ``tie``.

    Probing in sorted order gives each row the maximum of its base and the previous id + 1, which
    is its position plus a running maximum of base minus position. ``taken`` (one column of
    distinct ids already stored) is skipped by probing in the numbering of the free slots. Rows
    that run past the end wrap around to the first free slots.
    """
    if rows.count() + (taken.count() if taken is not None else 0) > space:
        raise ValueError("more ids requested than the id space holds")
    work = rows.withColumn("_base", F.col(base).cast("bigint"))
    if taken is not None:
        stored = taken.select(F.col(taken.columns[0]).cast("bigint").alias("_taken"))
        work = _free_slots(work, "_base", stored, "_taken").withColumn("_base", F.col("_base") - F.col("_below")).drop("_below")
    placed = global_index(work, "_base", tie, name="_rn").withColumn("_d", F.col("_base") - F.col("_rn"))
    placed = running(placed, ["_base", tie], maxima={"_m": "_d"})
    placed = placed.withColumn("_slot", F.col("_rn") + F.col("_m")).drop("_rn", "_d", "_m", "_base")
    if taken is not None:
        ranked = running(stored, ["_taken"], index="_i")
        gaps = ranked.select((F.col("_taken") - F.col("_i") - 1).alias("_free"))
        placed = _free_slots(placed, "_slot", gaps, "_free").withColumn("_slot", F.col("_slot") + F.col("_below")).drop("_below")
    placed = cut(placed, "probed")
    fits = placed.filter(F.col("_slot") <= space).withColumnRenamed("_slot", name)
    late = placed.filter(F.col("_slot") > space).drop("_slot")
    if late.isEmpty():
        return fits
    used = fits.select(F.col(name).alias("_taken"))
    if taken is not None:
        used = used.unionByName(stored)
    wrapped = resolve_id_collisions(
        late.withColumn("_one", F.lit(1)), "_one", tie, name, used, space
    ).drop("_one")
    return fits.unionByName(wrapped)


def unique_ids(claims: DataFrame, stored: DataFrame | None = None, space: int = FACT_ID_SPACE) -> DataFrame:
    """``omop_table, key, id`` for claims ``omop_table, key, base``: no id twice in a table.

    Ids already stored (``omop_table, id``) are taken. Only the few tables in which a claim meets
    another one or a stored id are probed; everywhere else the base is the id.
    """
    claims = cut(claims.select("omop_table", "key", F.col("base").cast("bigint").alias("base")), "claims")
    met = claims.groupBy("omop_table", "base").count().filter("count > 1").select("omop_table")
    if stored is not None:
        own = stored.select("omop_table", F.col("id").cast("bigint").alias("base")).distinct()
        met = met.union(claims.join(own, ["omop_table", "base"]).select("omop_table"))
    # As many rows as the common data model has fact tables.
    tables = [row["omop_table"] for row in met.distinct().collect()]
    out = claims.filter(~F.col("omop_table").isin(tables)) if tables else claims
    out = out.select("omop_table", "key", F.col("base").alias("id"))
    for table in tables:
        taken = _of(own, table).select("base") if stored is not None else None
        placed = resolve_id_collisions(_of(claims, table), "base", "key", "id", taken, space)
        out = out.unionByName(placed.select("omop_table", "key", F.col("id").cast("bigint").alias("id")))
    return out


def identify_facts(facts: DataFrame, persons: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Adds ``person_id``, ``omop_fact_id`` and, for NLP facts, ``parent_note_id``.

    Integer ids are unique per table, against ``stored`` ids too; notes generated for NLP facts take
    part in the note table.
    """
    known = facts.join(persons, "person_source_value")
    parent = deterministic_uuid("note-nlp-parent", "fact_id")
    claims = facts.select("omop_table", F.col("fact_id").alias("key"), integer_fact_id("fact_id").alias("base")).unionByName(
        _of(facts, "note_nlp").select(F.lit("note").alias("omop_table"), parent.alias("key"), integer_fact_id(parent).alias("base"))
    )
    ids = cut(unique_ids(claims.distinct(), stored), "fact-ids")
    own = ids.select("omop_table", F.col("key").alias("fact_id"), F.col("id").alias("omop_fact_id"))
    notes = ids.filter("omop_table = 'note'").select(F.col("key").alias("_parent"), F.col("id").alias("parent_note_id"))
    return (
        known.join(own, ["omop_table", "fact_id"])
        .withColumn("_parent", F.when(F.col("omop_table") == "note_nlp", parent))
        .join(notes, "_parent", "left")
        .drop("_parent")
    )


def to_person(persons: DataFrame) -> DataFrame:
    """Person rows; what a form does not say is the unknown concept."""
    unknown = [F.lit(0).alias(n) for n in ("gender_concept_id", "race_concept_id", "ethnicity_concept_id")]
    return persons.select("person_id", F.lit(1970).alias("year_of_birth"), *unknown, "person_source_value")


def _of(facts: DataFrame, table: str) -> DataFrame:
    return facts.filter(F.col("omop_table") == table)


def _cut_text(column: str, length: int) -> Column:
    return F.substring(column, 1, length)


def to_observation(facts: DataFrame) -> DataFrame:
    return _of(facts, "observation").select(
        F.col("omop_fact_id").alias("observation_id"),
        "person_id",
        F.col("concept_id").alias("observation_concept_id"),
        F.col("event_date").alias("observation_date"),
        F.col("event_datetime").alias("observation_datetime"),
        F.lit(0).alias("observation_type_concept_id"),
        "value_as_number",
        _cut_text("value_as_string", 60).alias("value_as_string"),
        "value_as_concept_id",
        _cut_text("source_value", 50).alias("observation_source_value"),
        _cut_text("unit_source_value", 50).alias("unit_source_value"),
    )


def to_measurement(facts: DataFrame) -> DataFrame:
    return _of(facts, "measurement").select(
        F.col("omop_fact_id").alias("measurement_id"),
        "person_id",
        F.col("concept_id").alias("measurement_concept_id"),
        F.col("event_date").alias("measurement_date"),
        F.col("event_datetime").alias("measurement_datetime"),
        F.lit(0).alias("measurement_type_concept_id"),
        "value_as_number",
        "value_as_concept_id",
        _cut_text("source_value", 50).alias("measurement_source_value"),
        _cut_text("unit_source_value", 50).alias("unit_source_value"),
        _cut_text("value_as_string", 50).alias("value_source_value"),
    )


def to_condition_occurrence(facts: DataFrame) -> DataFrame:
    return _of(facts, "condition_occurrence").select(
        F.col("omop_fact_id").alias("condition_occurrence_id"),
        "person_id",
        F.col("concept_id").alias("condition_concept_id"),
        F.col("event_date").alias("condition_start_date"),
        F.col("event_datetime").alias("condition_start_datetime"),
        F.lit(0).alias("condition_type_concept_id"),
        _cut_text("source_value", 50).alias("condition_source_value"),
    )


def _narrative(fallback: str) -> Column:
    filled = [F.nullif(F.col(c), F.lit("")) for c in ("value_as_string", "source_value")]
    return F.coalesce(*filled, F.lit(fallback))


def _note(rows: DataFrame, note_id: Column, type_concept: Column, title: str, text: Column) -> DataFrame:
    zero = F.lit(0)
    return rows.select(
        note_id.alias("note_id"),
        "person_id",
        F.col("event_date").alias("note_date"),
        F.col("event_datetime").alias("note_datetime"),
        type_concept.cast("bigint").alias("note_type_concept_id"),
        zero.alias("note_class_concept_id"),
        F.lit(title).alias("note_title"),
        text.alias("note_text"),
        zero.alias("encoding_concept_id"),
        zero.alias("language_concept_id"),
        _cut_text("source_value", 50).alias("note_source_value"),
    )


def to_note(facts: DataFrame) -> DataFrame:
    """Notes of the note domain; the text falls back to the source value."""
    return _note(
        _of(facts, "note"), F.col("omop_fact_id"), F.col("concept_id"),
        "Standardized form narrative", _narrative("No narrative text"),
    )


def to_note_nlp(facts: DataFrame, system: str = "formloom/deterministic-rules") -> tuple[DataFrame, DataFrame]:
    """NLP rows and the notes generated to hold their evidence; both share the note id."""
    rows = _of(facts, "note_nlp")
    text = _narrative("abstained candidate")
    parents = _note(rows, F.col("parent_note_id"), F.lit(0), "Evidence for note_nlp", text)
    nlp = rows.select(
        F.col("omop_fact_id").alias("note_nlp_id"),
        F.col("parent_note_id").alias("note_id"),
        F.substring(text, 1, 250).alias("snippet"),
        F.substring(text, 1, 250).alias("lexical_variant"),
        F.col("concept_id").alias("note_nlp_concept_id"),
        F.lit(system).alias("nlp_system"),
        F.col("event_date").alias("nlp_date"),
        F.col("event_datetime").alias("nlp_datetime"),
        F.lit("Y").alias("term_exists"),
    )
    return nlp, parents


def list_facts(observations: DataFrame) -> DataFrame:
    return observations.orderBy("observation_id")


# --- catalog of the common data model -------------------------------------------------------

# The tables of CDM 5.4.
CDM_TABLES = (
    "person observation_period visit_occurrence visit_detail condition_occurrence drug_exposure "
    "procedure_occurrence device_exposure measurement observation death note note_nlp specimen "
    "fact_relationship location care_site provider payer_plan_period cost drug_era dose_era "
    "condition_era episode episode_event metadata cdm_source concept vocabulary domain "
    "concept_class concept_relationship relationship concept_synonym concept_ancestor "
    "source_to_concept_map drug_strength cohort cohort_definition"
).split()

# Columns of the tables this package fills; ! marks a column that must not be null.
CDM_COLUMNS = {
    "person": "person_id! gender_concept_id! year_of_birth! month_of_birth day_of_birth "
    "birth_datetime race_concept_id! ethnicity_concept_id! location_id provider_id care_site_id "
    "person_source_value gender_source_value gender_source_concept_id race_source_value "
    "race_source_concept_id ethnicity_source_value ethnicity_source_concept_id",
    "observation": "observation_id! person_id! observation_concept_id! observation_date! "
    "observation_datetime observation_type_concept_id! value_as_number value_as_string "
    "value_as_concept_id qualifier_concept_id unit_concept_id provider_id visit_occurrence_id "
    "visit_detail_id observation_source_value observation_source_concept_id unit_source_value "
    "qualifier_source_value value_source_value observation_event_id obs_event_field_concept_id",
    "measurement": "measurement_id! person_id! measurement_concept_id! measurement_date! "
    "measurement_datetime measurement_time measurement_type_concept_id! operator_concept_id "
    "value_as_number value_as_concept_id unit_concept_id range_low range_high provider_id "
    "visit_occurrence_id visit_detail_id measurement_source_value measurement_source_concept_id "
    "unit_source_value unit_source_concept_id value_source_value measurement_event_id "
    "meas_event_field_concept_id",
    "condition_occurrence": "condition_occurrence_id! person_id! condition_concept_id! "
    "condition_start_date! condition_start_datetime condition_end_date condition_end_datetime "
    "condition_type_concept_id! condition_status_concept_id stop_reason provider_id "
    "visit_occurrence_id visit_detail_id condition_source_value condition_source_concept_id "
    "condition_status_source_value",
    "note": "note_id! person_id! note_date! note_datetime note_type_concept_id! "
    "note_class_concept_id! note_title note_text! encoding_concept_id! language_concept_id! "
    "provider_id visit_occurrence_id visit_detail_id note_source_value note_event_id "
    "note_event_field_concept_id",
    "note_nlp": "note_nlp_id! note_id! section_concept_id snippet offset lexical_variant! "
    "note_nlp_concept_id note_nlp_source_concept_id nlp_system nlp_date! nlp_datetime "
    "term_exists term_temporal term_modifiers",
    "concept": "concept_id! concept_name! domain_id! vocabulary_id! concept_class_id! "
    "standard_concept concept_code! valid_start_date! valid_end_date! invalid_reason",
    "vocabulary": "vocabulary_id! vocabulary_name! vocabulary_reference vocabulary_version "
    "vocabulary_concept_id!",
    "domain": "domain_id! domain_name! domain_concept_id!",
    "concept_class": "concept_class_id! concept_class_name! concept_class_concept_id!",
}
_TEXT_IDS = {"domain_id", "vocabulary_id", "concept_class_id"}
_DECIMALS = {"value_as_number", "range_low", "range_high"}


def _cdm_type(column: str) -> T.DataType:
    if column in _DECIMALS:
        return T.DecimalType(38, 9)
    if column.endswith("_datetime"):
        return T.TimestampType()
    if column.endswith("_date"):
        return T.DateType()
    if column.endswith("_of_birth"):
        return T.IntegerType()
    if column.endswith("_id") and column not in _TEXT_IDS:
        return T.LongType()
    return T.StringType()


def cdm_schema(table: str) -> T.StructType:
    """Schema of a filled CDM table; types follow from the CDM's naming rules."""
    fields = CDM_COLUMNS[table].split()
    return T.StructType(
        [T.StructField(f.rstrip("!"), _cdm_type(f.rstrip("!")), not f.endswith("!")) for f in fields]
    )


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns and types of the CDM table; what it lacks is null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in cdm_schema(table)
        ]
    )


def schema_findings(table: str, schema: T.StructType) -> list[str]:
    """Differences of a schema from the CDM's, column by column."""
    want = {f.name: f.dataType for f in cdm_schema(table)}
    have = {f.name: f.dataType for f in schema}
    out = [f"{table}.{n}: missing" for n in want if n not in have]
    out += [f"{table}.{n}: unexpected" for n in have if n not in want]
    out += [
        f"{table}.{n}: {have[n].simpleString()} instead of {want[n].simpleString()}"
        for n in want
        if n in have and have[n] != want[n]
    ]
    return out


def is_complete_catalog(tables: Iterable[str], person_columns: Iterable[str]) -> bool:
    """All 39 CDM tables are there and person has the 5.4 birth time."""
    return set(CDM_TABLES) <= set(tables) and "birth_datetime" in set(person_columns)


def read_field_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Field-level catalog of the whole CDM from its published CSV: types, keys and references."""
    raw = spark.read.csv(path, header=True)

    def yes(name: str) -> Column:
        return F.coalesce(F.lower(F.trim(name)) == "yes", F.lit(False))

    return raw.select(
        F.lower("cdmTableName").alias("table"),
        F.lower(F.regexp_replace("cdmFieldName", '"', "")).alias("column"),
        F.lower("cdmDatatype").alias("data_type"),
        yes("isRequired").alias("required"),
        yes("isPrimaryKey").alias("primary_key"),
        F.when(yes("isForeignKey"), F.lower("fkTableName")).alias("references_table"),
        F.when(yes("isForeignKey"), F.lower("fkFieldName")).alias("references_column"),
    )


def foreign_keys(tables: Iterable[str] = tuple(CDM_COLUMNS)) -> list[tuple[str, str, str, str]]:
    """(table, column, referenced table, referenced column) of the filled tables, from the names."""
    owners = {"person_id": "person", "note_id": "note", "domain_id": "domain", "vocabulary_id": "vocabulary", "concept_class_id": "concept_class"}
    out = []
    for table in tables:
        for field in CDM_COLUMNS[table].split():
            column = field.rstrip("!")
            if column.endswith("_concept_id"):
                out.append((table, column, "concept", "concept_id"))
            elif column in owners and owners[column] != table:
                out.append((table, column, owners[column], column))
    return out


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_primary_keys(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, key, rows) of every key that is null or not unique."""
    return _stack(
        [
            df.groupBy(F.col(key).cast("string").alias("key"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .filter("rows > 1 OR key IS NULL")
            .select(F.lit(name).alias("table"), "key", "rows")
            for name, (df, key) in tables.items()
        ]
    )


def check_not_null(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, rows) of nulls in required CDM columns; one pass per table."""
    parts = []
    for name, df in tables.items():
        required = [f.name for f in cdm_schema(name) if not f.nullable]
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        parts.append(
            counts.select(
                F.lit(name).alias("table"),
                F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in required])).alias("x"),
            ).select("table", "x.*").filter("rows > 0")
        )
    return _stack(parts)


def check_foreign_keys(
    tables: dict[str, DataFrame], constraints: list[tuple[str, str, str, str]]
) -> DataFrame:
    """(table, column, value, rows) of references to nothing.

    Values are counted per column before the anti-join, so a hot value is one row there.
    """
    parts = []
    for table, column, target, key in constraints:
        if table not in tables or target not in tables or column not in tables[table].columns:
            continue
        used = tables[table].filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
        known = tables[target].select(F.col(key).alias("value")).distinct()
        parts.append(
            used.join(known, "value", "left_anti").select(
                F.lit(table).alias("table"), F.lit(column).alias("column"), F.col("value").cast("string").alias("value"), "rows"
            )
        )
    return _stack(parts)


def omop_validate(concepts: DataFrame, tables: Iterable[str]) -> DataFrame:
    """One row: concepts, concepts with a non-positive id, tables present, verdict."""
    present = len(set(tables) & set(CDM_TABLES))
    counted = concepts.agg(
        F.count(F.lit(1)).alias("concept_count"), F.count_if(F.col("concept_id") <= 0).alias("invalid_ids")
    )
    return counted.withColumn("table_count", F.lit(present)).withColumn(
        "passed", (F.col("concept_count") > 0) & (F.col("invalid_ids") == 0) & (F.lit(present) == len(CDM_TABLES))
    )


def validate_target_concepts(entries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Mapping entries with whether their target exists, is standard and fits the domain."""
    known = concepts.select(
        F.col("concept_id").alias("target_concept_id"), F.col("standard_concept").alias("_standard"), F.upper("domain_id").alias("_domain")
    )
    joined = entries.join(known, "target_concept_id", "left")
    exists = F.col("_domain").isNotNull()
    standard = F.coalesce(F.col("_standard") == "S", F.lit(False))
    domain = F.coalesce(F.col("_domain") == F.col("target_domain"), F.lit(False))
    return joined.withColumns(
        {"concept_exists": exists, "is_standard": standard, "domain_matches": domain, "valid": exists & standard & domain}
    ).drop("_standard", "_domain")


def fact_value_text(facts: DataFrame) -> DataFrame:
    """Adds ``value_text``, the one filled value column as text."""
    return facts.withColumn(
        "value_text", F.coalesce(plain_number(F.col("value_as_number")), "value_as_string", F.col("value_as_concept_id").cast("string"))
    )
