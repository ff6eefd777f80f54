"""Constraints of the common data model: reading the published field list, and planted breaches."""

from formloom.operators import cdm, omop
from formloom.session import local_table

DDL = """--comment with a ; in it is not expected, one without is
CREATE TABLE @cdmDatabaseSchema.person (
      person_id integer NOT NULL,
      gender_concept_id Integer NOT NULL,
      birth_datetime TIMESTAMP NULL,
      amount numeric(10,2) NULL );
--HINT DISTRIBUTE ON RANDOM
CREATE TABLE @cdmDatabaseSchema.concept (concept_id integer NOT NULL, concept_name varchar(255) NOT NULL, "offset" varchar(50) NULL );
CREATE TABLE @cdmDatabaseSchema.cohort (subject_id integer NOT NULL);
CREATE INDEX idx ON @cdmDatabaseSchema.person (person_id);
"""
KEYS = "ALTER TABLE @cdmDatabaseSchema.person  ADD CONSTRAINT xpk_person PRIMARY KEY (person_id);\nALTER TABLE @cdmDatabaseSchema.concept ADD CONSTRAINT xpk PRIMARY KEY (concept_id);\n"
REFERENCES = "ALTER TABLE @cdmDatabaseSchema.person  ADD CONSTRAINT fpk_a FOREIGN KEY (gender_concept_id) REFERENCES @cdmDatabaseSchema.CONCEPT (CONCEPT_ID);\n"


def read(spark, folder):
    for name, text in (("ddl", DDL), ("keys", KEYS), ("constraints", REFERENCES)):
        (folder / f"{name}.sql").write_text(text)
    return cdm.fields_of(cdm.read_ddl(spark, *[str(folder / f"{name}.sql") for name in ("constraints", "ddl", "keys")]))


def test_published_ddl(spark, tmp_path):
    assert read(spark, tmp_path) == [
        cdm.Field("cohort", "subject_id", "integer", True),
        cdm.Field("concept", "concept_id", "integer", True, True),
        cdm.Field("concept", "concept_name", "varchar", True),
        cdm.Field("concept", "offset", "varchar", False),
        cdm.Field("person", "amount", "numeric", False),
        cdm.Field("person", "birth_datetime", "timestamp", False),
        cdm.Field("person", "gender_concept_id", "integer", True, False, "concept", "concept_id"),
        cdm.Field("person", "person_id", "integer", True, True),
    ]


def test_schema_before_it_is_conformed(spark, tmp_path):
    fields = read(spark, tmp_path)
    df = local_table(spark, [], "person_id bigint, gender_concept_id string, amount double, extra int")
    assert cdm.schema_findings(fields, "person", df.schema) == [
        ("MISSING_OPTIONAL", "birth_datetime", "timestamp"), ("TYPE", "gender_concept_id", "string instead of integer"), ("UNEXPECTED", "extra", "int")]
    assert cdm.schema_findings(fields, "nothing", df.schema) == [("UNKNOWN_TABLE", "", "nothing")]
    assert all(not [f for f in cdm.schema_findings(cdm.filled_fields(), t, omop.cdm_schema(t))] for t in omop.CDM_COLUMNS)


def test_breaches_of_every_kind(spark, tmp_path):
    """Keys null or repeated, references to nothing and to a repeated key, nulls, an empty and a missing table."""
    fields = read(spark, tmp_path)
    person = local_table(spark, [(1, 8, 1.0), (1, 9, None), (None, 8, None), (2, None, 1.0), (3, 7, 1.0), (4, 9, 1.0)], "person_id bigint, gender_concept_id int, amount double")
    concept = local_table(spark, [(8, "a"), (8, "b"), (7, None)], "concept_id bigint, concept_name string")
    found = sorted(map(str, (tuple(r) for r in cdm.check_constraints({"person": person, "concept": concept}, fields).collect())))
    assert found == sorted(map(str, [
        ("PRIMARY_KEY", "person", "person_id", "1", 2), ("PRIMARY_KEY", "person", "person_id", None, 1), ("PRIMARY_KEY", "concept", "concept_id", "8", 2),
        ("REFERENCE", "person", "gender_concept_id", "9", 2), ("NOT_NULL", "person", "gender_concept_id", None, 1), ("NOT_NULL", "concept", "concept_name", None, 1)]))
    nothing = concept.filter("false")
    assert cdm.check_constraints({"person": person, "concept": nothing}, fields).filter("kind = 'REFERENCE'").count() == 3
    assert cdm.unchecked_references({"person": person}, fields) == [("person", "gender_concept_id")]
    assert cdm.check_constraints({"person": person}, fields).filter("kind = 'REFERENCE'").count() == 0


def test_number_of_shuffles_does_not_grow_with_the_references(spark):
    tables = {t: local_table(spark, [], omop.cdm_schema(t).simpleString()[7:-1].replace(":", " ")) for t in omop.CDM_COLUMNS}
    found = cdm.check_constraints(tables, cdm.filled_fields())
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert found.count() == 0 and plan.count("HashAggregate") <= 4 and "Join" not in plan
