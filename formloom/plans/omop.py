"""OMOP projection and integrity on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.operators import cdm, omop, vocabulary
from formloom.plans.answers import decided_sql, stored_decisions
from formloom.plans.registry import Source, query
from formloom.plans.sqltext import sql_fact_id, sql_uuid
from formloom.session import cut

FACTS_SQL = f"""{decided_sql()},
    facts AS (SELECT *, {sql_uuid('omop-fact', 'omop_table', 'clinical_event_id', 'target_concept_id')} AS fact_id FROM (
      SELECT *, CASE target_domain WHEN 'CONDITION' THEN 'condition_occurrence' WHEN 'MEASUREMENT' THEN 'measurement'
          WHEN 'OBSERVATION' THEN 'observation' WHEN 'NOTE' THEN 'note' WHEN 'NOTE_NLP' THEN 'note_nlp' END AS omop_table,
        CASE WHEN clinical_state = 'EXPLICITLY_ABSENT' THEN 'EXPLICITLY_ABSENT' ELSE text END AS value_as_string,
        CAST(authored_at AS DATE) AS event_date
      FROM decided WHERE decision = 'PUBLISH' AND clinical_event_id IS NOT NULL) x),
    known AS (SELECT DISTINCT 'u' || user_id AS psv, user_id + 1 AS person_id FROM events WHERE event_type = 'purchase' AND value > 200),
    fresh AS (SELECT psv, row_number() OVER (ORDER BY psv) + (SELECT max(person_id) FROM known) AS person_id FROM (
      SELECT DISTINCT patient_id AS psv FROM facts WHERE patient_id NOT IN (SELECT psv FROM known)) y),
    persons AS (SELECT * FROM known UNION ALL SELECT * FROM fresh),
    idf AS (SELECT f.*, p.person_id, {sql_fact_id('fact_id')} AS omop_fact_id FROM facts f JOIN persons p ON p.psv = f.patient_id)"""


def event_facts(src: Source) -> DataFrame:
    return omop.project_facts(stored_decisions(src))


def known_persons(src: Source) -> DataFrame:
    """People stored by an earlier release: those with a large purchase."""
    return src.table("events").filter("event_type = 'purchase' AND value > 200").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("person_source_value"),
        (F.col("user_id") + 1).alias("person_id"),
    ).distinct()


def identified(src: Source) -> DataFrame:
    facts = event_facts(src)
    return omop.identify_facts(facts, omop.assign_person_ids(facts, known_persons(src)))


@query(
    "i1_project_facts",
    "b_answers",
    sql=f"""WITH {FACTS_SQL} SELECT fact_id, clinical_event_id, patient_id AS person_source_value, target_concept_id AS concept_id,
      event_date, CAST(number AS DOUBLE) AS value_as_number, value_as_string, clinical_unit AS unit_source_value,
      raw_value AS source_value FROM facts""",
)
def i1_project_facts(src: Source) -> DataFrame:
    return event_facts(src).select(
        "fact_id", "clinical_event_id", "person_source_value", "concept_id", "event_date",
        F.col("value_as_number").cast("double").alias("value_as_number"), "value_as_string", "unit_source_value", "source_value",
    )


@query(
    "i2_route_domain",
    "b_answers",
    sql=f"""WITH {FACTS_SQL} SELECT omop_table, count(*) AS facts, count(number) AS numbers, count(value_as_string) AS texts,
      count(*) FILTER (number IS NOT NULL AND value_as_string IS NOT NULL) AS both_filled FROM facts GROUP BY 1""",
)
def i2_route_domain(src: Source) -> DataFrame:
    both = F.col("value_as_number").isNotNull() & F.col("value_as_string").isNotNull()
    return event_facts(src).groupBy("omop_table").agg(
        F.count(F.lit(1)).alias("facts"),
        F.count("value_as_number").alias("numbers"),
        F.count("value_as_string").alias("texts"),
        F.count_if(both).alias("both_filled"),
    )


@query(
    "i3a_to_observation",
    "b_answers",
    sql=f"""WITH {FACTS_SQL} SELECT omop_fact_id AS observation_id, person_id, target_concept_id AS observation_concept_id, event_date AS observation_date,
      substr(value_as_string, 1, 60) AS value_as_string, substr(raw_value, 1, 50) AS observation_source_value,
      clinical_unit AS unit_source_value FROM idf WHERE omop_table = 'observation'""",
)
def i3a_to_observation(src: Source) -> DataFrame:
    return omop.to_observation(identified(src)).select(
        "observation_id", "person_id", "observation_concept_id", "observation_date", "value_as_string",
        "observation_source_value", "unit_source_value",
    )


@query(
    "i3b_to_measurement",
    "b_answers",
    sql=f"""WITH {FACTS_SQL} SELECT omop_fact_id AS measurement_id, person_id, target_concept_id AS measurement_concept_id, event_date AS measurement_date,
      CAST(number AS DOUBLE) AS value_as_number, clinical_unit AS unit_source_value, value_as_string AS value_source_value
      FROM idf WHERE omop_table = 'measurement'""",
)
def i3b_to_measurement(src: Source) -> DataFrame:
    return omop.to_measurement(identified(src)).select(
        "measurement_id", "person_id", "measurement_concept_id", "measurement_date",
        F.col("value_as_number").cast("double").alias("value_as_number"), "unit_source_value", "value_source_value",
    )


@query(
    "i3c_to_condition_occurrence",
    "b_answers",
    sql=f"""WITH {FACTS_SQL} SELECT omop_fact_id AS condition_occurrence_id, person_id, target_concept_id AS condition_concept_id,
      event_date AS condition_start_date, raw_value AS condition_source_value FROM idf WHERE omop_table = 'condition_occurrence'""",
)
def i3c_to_condition_occurrence(src: Source) -> DataFrame:
    return omop.to_condition_occurrence(identified(src)).select(
        "condition_occurrence_id", "person_id", "condition_concept_id", "condition_start_date", "condition_source_value"
    )


@query(
    "i3d_to_note",
    "b_answers",
    sql=f"""WITH {FACTS_SQL} SELECT omop_fact_id AS note_id, person_id, target_concept_id AS note_type_concept_id, event_date AS note_date,
      'Standardized form narrative' AS note_title, coalesce(nullif(value_as_string, ''), nullif(raw_value, ''), 'No narrative text') AS note_text
      FROM idf WHERE omop_table = 'note'""",
)
def i3d_to_note(src: Source) -> DataFrame:
    return omop.to_note(identified(src)).select(
        "note_id", "person_id", "note_type_concept_id", "note_date", "note_title", "note_text"
    )


@query(
    "i3e_to_note_nlp",
    "b_answers",
    sql=f"""WITH {FACTS_SQL} SELECT omop_fact_id AS note_nlp_id, {sql_fact_id(sql_uuid('note-nlp-parent', 'fact_id'))} AS note_id, person_id,
      coalesce(nullif(value_as_string, ''), nullif(raw_value, ''), 'abstained candidate') AS lexical_variant,
      target_concept_id AS note_nlp_concept_id, event_date AS nlp_date, 'Evidence for note_nlp' AS note_title
      FROM idf WHERE omop_table = 'note_nlp'""",
)
def i3e_to_note_nlp(src: Source) -> DataFrame:
    nlp, parents = omop.to_note_nlp(identified(src))
    return nlp.join(parents.select("note_id", "person_id", "note_title"), "note_id").select(
        "note_nlp_id", "note_id", "person_id", "lexical_variant", "note_nlp_concept_id", "nlp_date", "note_title"
    )


@query(
    "i4_assign_person_ids",
    sql="""WITH known AS (SELECT DISTINCT 'u' || user_id AS psv, user_id + 1 AS person_id FROM events WHERE event_type = 'purchase' AND value > 200),
    fresh AS (SELECT psv, row_number() OVER (ORDER BY psv) + (SELECT max(person_id) FROM known) AS person_id
      FROM (SELECT DISTINCT 'u' || user_id AS psv FROM events WHERE 'u' || user_id NOT IN (SELECT psv FROM known)))
    SELECT psv AS person_source_value, person_id FROM known UNION ALL SELECT * FROM fresh""",
)
def i4_assign_person_ids(src: Source) -> DataFrame:
    everyone = src.table("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("person_source_value"))
    return omop.assign_person_ids(everyone, known_persons(src))


@query(
    "i5_resolve_id_collisions",
    sql="""WITH r AS (SELECT o_orderkey, o_custkey + 1 AS base, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rn FROM orders)
    SELECT o_orderkey, base, rn + max(base - rn) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS resolved_id FROM r""",
)
def i5_resolve_id_collisions(src: Source) -> DataFrame:
    rows = src.table("orders").select("o_orderkey", (F.col("o_custkey") + 1).alias("base"))
    return omop.resolve_id_collisions(rows, "base", "o_orderkey")


def produced(src: Source) -> dict[str, DataFrame]:
    """Every table the projection fills, as it comes from the facts and before it is conformed."""
    facts = event_facts(src)
    # Written once: every table is read from them, and the ids take several joins over all facts.
    persons = cut(omop.assign_person_ids(facts, known_persons(src)), "persons")
    own = cut(omop.identify_facts(facts, persons), "identified")
    nlp, parents = omop.to_note_nlp(own)
    return {
        "person": omop.to_person(persons),
        "observation": omop.to_observation(own),
        "measurement": omop.to_measurement(own),
        "condition_occurrence": omop.to_condition_occurrence(own),
        "note": omop.to_note(own).unionByName(parents),
        "note_nlp": nlp,
    }


@query(
    "i6_cdm_catalog",
    "b_answers",
    sql=f"""WITH {FACTS_SQL}, n AS (
        SELECT 'person' AS t, count(*) AS rows FROM persons
        UNION ALL SELECT omop_table, count(*) FROM idf WHERE omop_table <> 'note' GROUP BY 1
        UNION ALL SELECT 'note', count(*) FROM idf WHERE omop_table IN ('note', 'note_nlp')),
      f AS (SELECT * FROM (VALUES ('person', 12), ('observation', 10), ('measurement', 12), ('condition_occurrence', 9), ('note', 5), ('note_nlp', 5)) v(t, missing))
      SELECT t AS "table", rows, missing AS missing_optional, 0 AS breaches FROM n JOIN f USING (t)""",
)
def i6_cdm_catalog(src: Source) -> DataFrame:
    fields, out = cdm.filled_fields(), []
    for name, df in produced(src).items():
        found = cdm.schema_findings(fields, name, df.schema)
        missing = sum(kind == "MISSING_OPTIONAL" for kind, _, _ in found)
        out.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(missing).alias("missing_optional"), F.lit(len(found) - missing).alias("breaches")
        ))
    return reduce(DataFrame.unionByName, out)


def breached(src: Source) -> dict[str, DataFrame]:
    """The produced tables with people, concepts, notes and dates taken away, and people given twice."""
    tables = {name: cut(df, f"cdm-{name}") for name, df in produced(src).items()}
    people = tables["person"].filter("person_id % 7 <> 0")
    concepts = reduce(
        DataFrame.unionByName,
        [tables[t].select(F.col(c).cast("bigint").alias("concept_id")) for t, c in
         (("observation", "observation_concept_id"), ("measurement", "measurement_concept_id"), ("condition_occurrence", "condition_concept_id"),
          ("note", "note_type_concept_id"), ("note_nlp", "note_nlp_concept_id"))],
    ).distinct()
    kept = concepts.filter("concept_id % 3 <> 0 OR concept_id = 0").unionByName(src.spark.range(1).select(F.col("id").alias("concept_id"))).distinct()
    return tables | {
        "person": people.unionByName(people.filter("person_id % 11 = 0")),
        "concept": kept,
        "note": tables["note"].filter("note_id % 5 <> 0"),
        "observation": tables["observation"].withColumn("observation_date", F.when(F.col("observation_id") % 13 != 0, F.col("observation_date"))),
    }


@query(
    "i8_cdm_constraints",
    "b_answers",
    sql=f"""WITH {FACTS_SQL},
    p AS (SELECT person_id FROM persons WHERE person_id % 7 <> 0),
    notes AS (SELECT omop_fact_id AS note_id, person_id, target_concept_id AS c FROM idf WHERE omop_table = 'note'
      UNION ALL SELECT {sql_fact_id(sql_uuid('note-nlp-parent', 'fact_id'))}, person_id, 0 FROM idf WHERE omop_table = 'note_nlp'),
    n AS (SELECT * FROM notes WHERE note_id % 5 <> 0),
    uses AS (
      SELECT omop_table AS t, 'person_id' AS c, person_id AS v, person_id IN (SELECT person_id FROM p) AS ok FROM idf WHERE omop_table IN ('observation', 'measurement', 'condition_occurrence')
      UNION ALL SELECT 'note', 'person_id', person_id, person_id IN (SELECT person_id FROM p) FROM n
      UNION ALL SELECT omop_table, CASE omop_table WHEN 'observation' THEN 'observation_concept_id' WHEN 'measurement' THEN 'measurement_concept_id'
        WHEN 'condition_occurrence' THEN 'condition_concept_id' ELSE 'note_nlp_concept_id' END, target_concept_id, target_concept_id % 3 <> 0
        FROM idf WHERE omop_table <> 'note'
      UNION ALL SELECT 'note', 'note_type_concept_id', c, c % 3 <> 0 OR c = 0 FROM n
      UNION ALL SELECT 'note_nlp', 'note_id', {sql_fact_id(sql_uuid('note-nlp-parent', 'fact_id'))},
        {sql_fact_id(sql_uuid('note-nlp-parent', 'fact_id'))} % 5 <> 0 FROM idf WHERE omop_table = 'note_nlp')
    SELECT 'REFERENCE' AS kind, t AS "table", c AS "column", CAST(v AS VARCHAR) AS value, count(*) AS rows FROM uses WHERE NOT ok GROUP BY ALL
    UNION ALL SELECT 'PRIMARY_KEY', 'person', 'person_id', CAST(person_id AS VARCHAR), 2 FROM p WHERE person_id % 11 = 0
    UNION ALL SELECT 'NOT_NULL', 'observation', 'observation_date', NULL, count(*) FROM idf WHERE omop_table = 'observation' AND omop_fact_id % 13 = 0 HAVING count(*) > 0""",
)
def i8_cdm_constraints(src: Source) -> DataFrame:
    return cdm.check_constraints(breached(src), cdm.filled_fields())


@query(
    "i7_check_primary_keys",
    sql="""SELECT 'lines' AS "table", CAST(l_orderkey AS VARCHAR) AS key, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
    UNION ALL SELECT 'customers', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY o_custkey HAVING count(*) > 1
    UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1""",
)
def i7_check_primary_keys(src: Source) -> DataFrame:
    orders = src.table("orders")
    return omop.check_primary_keys(
        {
            "lines": (src.table("lineitem"), "l_orderkey"),
            "customers": (orders, "o_custkey"),
            "orders": (orders, "o_orderkey"),
        }
    )


@query(
    "i7_check_not_null",
    sql="""SELECT 'person' AS "table", 'year_of_birth' AS "column", count(*) AS rows FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 'person', 'race_concept_id', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' HAVING count(*) > 0""",
)
def i7_check_not_null(src: Source) -> DataFrame:
    people = src.table("customer").select(
        F.col("c_custkey").alias("person_id"),
        F.lit(0).alias("gender_concept_id"),
        F.when(F.col("c_acctbal") >= 0, 1970).alias("year_of_birth"),
        F.when(F.col("c_mktsegment") != "BUILDING", 0).alias("race_concept_id"),
        F.lit(0).alias("ethnicity_concept_id"),
    )
    return omop.check_not_null({"person": omop.conform(people, "person")})


@query(
    "i8_check_foreign_keys",
    sql="""SELECT 'orders' AS "table", 'o_custkey' AS "column", CAST(o_custkey AS VARCHAR) AS value, count(*) AS rows
      FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey
    UNION ALL SELECT 'lineitem', 'l_partkey', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem
      WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3) GROUP BY l_partkey
    UNION ALL SELECT 'lineitem', 'l_orderkey', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""",
)
def i8_check_foreign_keys(src: Source) -> DataFrame:
    tables = {
        "orders": src.table("orders"),
        "lineitem": src.table("lineitem"),
        "customer": src.table("customer").filter("c_acctbal > 0"),
        "part": src.table("part").filter("p_size > 3"),
    }
    return omop.check_foreign_keys(
        tables,
        [
            ("orders", "o_custkey", "customer", "c_custkey"),
            ("lineitem", "l_partkey", "part", "p_partkey"),
            ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ],
    )


@query(
    "i9_omop_validate",
    sql="""SELECT count(*) AS concept_count, count(*) FILTER (p_partkey <= 0) AS invalid_ids, 39 AS table_count,
      count(*) FILTER (p_partkey <= 0) = 0 AS passed FROM part""",
)
def i9_omop_validate(src: Source) -> DataFrame:
    return omop.omop_validate(src.table("part").select(F.col("p_partkey").alias("concept_id")), omop.CDM_TABLES)


def part_concepts(src: Source) -> DataFrame:
    """Parts as vocabulary concepts."""
    return src.table("part").select(
        F.col("p_partkey").alias("concept_id"),
        F.col("p_name").alias("concept_name"),
        F.when(F.col("p_size") % 5 == 0, "Measurement").otherwise("Observation").alias("domain_id"),
        F.lit("LOCAL").alias("vocabulary_id"),
        F.col("p_brand").alias("concept_class_id"),
        F.when(F.col("p_size") > 10, "S").alias("standard_concept"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("concept_code"),
        F.lit("1970-01-01").cast("date").alias("valid_start_date"),
        F.lit("2099-12-31").cast("date").alias("valid_end_date"),
        F.lit(None).cast("string").alias("invalid_reason"),
    )


@query(
    "i10_vocabulary_snapshot",
    sql="""WITH c AS (SELECT count(*) AS n, count(*) FILTER (p_size > 10) AS s FROM part)
    SELECT 'r1' AS release_id, 'v1' AS vocabulary_version, n AS concept_count, s AS standard_concept_count, s > 0 AS accepted FROM c""",
)
def i10_vocabulary_snapshot(src: Source) -> DataFrame:
    members = part_concepts(src).select(
        F.concat(F.lit("CONCEPT-"), "concept_class_id").alias("name"), F.sha2("concept_class_id", 256).alias("digest")
    ).distinct()
    return vocabulary.snapshot(part_concepts(src), members, "r1", "v1").select(
        "release_id", "vocabulary_version", "concept_count", "standard_concept_count", "accepted"
    )


@query(
    "i10_snapshot_checksum",
    sql="""WITH m AS (SELECT DISTINCT 'CONCEPT-' || p_brand AS name, sha256(p_brand) AS digest FROM part)
    SELECT 'r1' AS release_id, sha256(unhex(string_agg(hex(encode(name)) || '00' || digest, '' ORDER BY name))) AS source_checksum FROM m""",
)
def i10_snapshot_checksum(src: Source) -> DataFrame:
    members = part_concepts(src).select(
        F.concat(F.lit("CONCEPT-"), "concept_class_id").alias("name"), F.sha2("concept_class_id", 256).alias("digest")
    ).distinct()
    return vocabulary.snapshot(part_concepts(src), members, "r1", "v1").select("release_id", "source_checksum")


@query(
    "i11_load_vocabulary",
    sql="""SELECT p_brand AS release_id, CASE WHEN count(*) < 75 THEN 'APPEND' WHEN count(*) < 85 THEN 'REPLAY' ELSE 'REBOUND' END AS action
    FROM part GROUP BY p_brand""",
)
def i11_load_vocabulary(src: Source) -> DataFrame:
    offered = src.table("part").groupBy(F.col("p_brand").alias("release_id")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "source_checksum", F.sha2(F.col("n").cast("string"), 256)
    )
    ledger = offered.filter("n >= 75").select(
        "release_id", F.when(F.col("n") < 85, F.col("source_checksum")).otherwise("other").alias("source_checksum")
    )
    return vocabulary.plan_load(offered, ledger).select("release_id", "action")


@query(
    "i12_validate_target_concepts",
    sql="""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey * 2 AS c, CASE l_returnflag WHEN 'A' THEN 'MEASUREMENT' ELSE 'OBSERVATION' END AS d FROM lineitem)
    SELECT c AS target_concept_id, d AS target_domain, p_partkey IS NOT NULL AS concept_exists, coalesce(p_size > 10, false) AS is_standard,
      coalesce((p_size % 5 = 0) = (d = 'MEASUREMENT'), false) AS domain_matches, count(*) AS entries
    FROM e LEFT JOIN part ON p_partkey = c GROUP BY ALL""",
)
def i12_validate_target_concepts(src: Source) -> DataFrame:
    entries = src.table("lineitem").select(
        (F.col("l_partkey") * 2).alias("target_concept_id"),
        F.when(F.col("l_returnflag") == "A", "MEASUREMENT").otherwise("OBSERVATION").alias("target_domain"),
    )
    checked = omop.validate_target_concepts(entries, part_concepts(src))
    return checked.groupBy("target_concept_id", "target_domain", "concept_exists", "is_standard", "domain_matches").agg(
        F.count(F.lit(1)).alias("entries")
    )


@query(
    "i13_list_facts",
    "b_answers",
    sql=f"""WITH {FACTS_SQL} SELECT omop_fact_id AS observation_id, person_id, target_concept_id AS observation_concept_id, event_date AS observation_date
      FROM idf WHERE omop_table = 'observation' ORDER BY 1""",
)
def i13_list_facts(src: Source) -> DataFrame:
    return omop.list_facts(omop.to_observation(identified(src))).select(
        "observation_id", "person_id", "observation_concept_id", "observation_date"
    )
