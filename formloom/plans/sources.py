"""Sources and sinks: documents derived from the driver tables are written or parsed back."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.operators import catalog, lineage, omop, privacy, releases
from formloom.plans.answers import decided_sql, eav_canonical, stored_decisions
from formloom.plans.catalog import BUNDLE_SQL, site_bundle
from formloom.plans.omop import FACTS_SQL, identified, part_concepts
from formloom.plans.registry import Source, query
from formloom.session import cut, fresh_path, local_table
from formloom.sources import cda, fhir, files, store, structured, synthetic

FORM = ["form_id", "version"]


# --- A1, B1 to B5 --------------------------------------------------------------------------


def stored_canonical(src: Source) -> str:
    root = fresh_path(src.spark, "canonical")
    rows = eav_canonical(src).select(
        "event_id", "patient_pseudonym", "item_path", "state", "value", "unit", "authored_at", "evidence", "establishment_id",
        store.period_of(F.col("authored_at")).alias("source_period"),
        F.lit("batch-1").alias("batch_id"),
        "source_fingerprint",
    )
    store.write_canonical(rows, root)
    return root


@query(
    "b1_write_canonical",
    "b_answers",
    sql=f"""WITH {decided_sql()} SELECT establishment_id, strftime(authored_at, '%Y-%m') AS source_period, 'batch-1' AS batch_id, source_fp AS source_fingerprint,
      state, count(*) AS answers, count(*) FILTER (state = 'PRESENT') AS with_value FROM canon GROUP BY ALL""",
)
def b1_write_canonical(src: Source) -> DataFrame:
    root = stored_canonical(src)
    # Writing the same batch again replaces its partitions.
    again = store.read_canonical(src.spark, root, site="site-b")
    store.write_canonical(cut(again, "replay"), root)
    return store.read_canonical(src.spark, root).groupBy(*store.PARTITIONS, "state").agg(
        F.count(F.lit(1)).alias("answers"), F.count("value").alias("with_value")
    )


@query(
    "a1_read_canonical",
    "b_answers",
    sql=f"""WITH {decided_sql()} SELECT event_id, state, CASE WHEN state = 'PRESENT' THEN raw_value END AS value FROM canon WHERE establishment_id = 'site-b'""",
)
def a1_read_canonical(src: Source) -> DataFrame:
    rows = store.read_canonical(src.spark, stored_canonical(src), site="site-b", batch="batch-1")
    return rows.select("event_id", "state", F.col("value.s").alias("value"))


@query(
    "b2_write_stage_artifacts",
    "b_answers",
    sql=f"""WITH {FACTS_SQL} SELECT 'canonical' AS stage, count(*) AS rows FROM canon UNION ALL SELECT 'quality', count(*) FROM decided
      UNION ALL SELECT 'omop', count(*) FROM facts""",
)
def b2_write_stage_artifacts(src: Source) -> DataFrame:
    decisions = stored_decisions(src)
    stages = {
        "canonical": decisions.select("event_id", "establishment_id", "item_path", "state", "value", "evidence"),
        "quality": decisions.select("event_id", "decision", "failures"),
        "omop": omop.project_facts(decisions),
    }
    root = fresh_path(src.spark, "stages")
    store.write_stage_artifacts(stages, root, "batch-1")
    out = None
    for stage in stages:
        part = src.spark.read.parquet(f"{root}/batch_id=batch-1/{stage}").agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "b2_all_stages",
    "b_answers",
    sql=f"""WITH {FACTS_SQL} SELECT 'canonical' AS stage, count(*) AS rows FROM canon UNION ALL SELECT 'quality', count(*) FROM decided
      UNION ALL SELECT 'omop', count(*) FROM facts UNION ALL SELECT 'manifest', count(DISTINCT establishment_id) FROM decided
      UNION ALL SELECT 'lineage', 3 * (SELECT count(*) FROM decided) + 2 * (SELECT count(*) FROM facts)
      UNION ALL SELECT 'catalog', count(DISTINCT (establishment_id, item_path)) FROM decided""",
)
def b2_all_stages(src: Source) -> DataFrame:
    """All six stages of a batch, written and read again."""
    decisions = stored_decisions(src)
    facts = omop.project_facts(decisions)
    rows = decisions.withColumn("object_key", F.col("evidence")[0]["object_key"]).withColumn("mapping_release_id", F.lit("mapping_r1"))
    stages = {
        "manifest": decisions.groupBy("establishment_id").agg(
            F.count(F.lit(1)).alias("record_count"), F.min("authored_at").alias("source_period_start"), F.max("authored_at").alias("source_period_end")
        ),
        "canonical": decisions.select("event_id", "establishment_id", "item_path", "state", "value", "evidence"),
        "quality": decisions.select("event_id", "decision", "failures"),
        "omop": facts,
        "lineage": lineage.lineage_edges(rows, facts, F.lit("batch-1")),
        "catalog": catalog.coverage(catalog.coverage_from_facts(decisions, ["establishment_id", "item_path"])),
    }
    root = fresh_path(src.spark, "stages")
    store.write_stage_artifacts(stages, root, "batch-1")
    parts = [
        src.spark.read.parquet(f"{root}/batch_id=batch-1/{stage}").agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("rows")) for stage in store.STAGES
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "b3_write_omop",
    "b_answers",
    sql=f"""WITH {FACTS_SQL} SELECT CASE omop_table WHEN 'note_nlp' THEN 'note' ELSE omop_table END AS "table", 'release_1' AS release_id, count(*) AS rows,
      count(DISTINCT person_id) AS persons FROM idf GROUP BY ALL UNION ALL SELECT 'note_nlp', 'release_1', count(*), NULL FROM idf WHERE omop_table = 'note_nlp'""",
)
def b3_write_omop(src: Source) -> DataFrame:
    facts = cut(identified(src), "facts")
    nlp, parents = omop.to_note_nlp(facts)
    tables = {
        "observation": omop.to_observation(facts),
        "measurement": omop.to_measurement(facts),
        "condition_occurrence": omop.to_condition_occurrence(facts),
        "note": omop.to_note(facts).unionByName(parents),
        "note_nlp": nlp,
    }
    root = fresh_path(src.spark, "omop")
    store.write_omop(tables, root, "release_1")
    out = None
    for name in tables:
        rows = src.spark.read.parquet(f"{root}/{name}")
        persons = F.countDistinct("person_id") if "person_id" in rows.columns else F.lit(None).cast("bigint")
        part = rows.groupBy("release_id").agg(F.count(F.lit(1)).alias("rows"), persons.alias("persons")).select(
            F.lit(name).alias("table"), "release_id", "rows", "persons"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "b4_commit_release",
    sql="""SELECT 'release_' || o_orderstatus AS release_id, count(*) AS facts FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""",
)
def b4_commit_release(src: Source) -> DataFrame:
    root = fresh_path(src.spark, "releases")
    orders = src.table("orders")
    facts = orders.select("o_orderkey", F.concat(F.lit("release_"), "o_orderstatus").alias("release_id"))
    facts.write.partitionBy("release_id").parquet(f"{root}/facts")
    for status in ("F", "O"):
        own = orders.filter(F.col("o_orderstatus") == status)
        rows = own.select(F.lit(0).alias("partition_id"), F.col("o_orderkey").alias("event_id"))
        size = own.agg(F.count(F.lit(1)).alias("end_row")).select(F.lit(0).alias("partition_id"), F.lit(0).alias("first_row"), "end_row")
        manifest = size.select(F.lit(f"release_{status}").alias("release_id"), F.col("end_row").alias("published_count"))
        store.commit_release(manifest, releases.finalize_check(size, rows), root)
    written = src.spark.read.parquet(f"{root}/facts")
    visible = store.committed(written, src.spark.read.parquet(f"{root}/manifests"))
    return visible.groupBy("release_id").agg(F.count(F.lit(1)).alias("facts"))


@query(
    "b5_export_site_bundle",
    "b_coverage",
    sql=f"WITH {BUNDLE_SQL} SELECT concept_key, period_start, recorded_count, suppressed FROM site",
)
def b5_export_site_bundle(src: Source) -> DataFrame:
    header, metrics = site_bundle(src)
    path = fresh_path(src.spark, "bundle")
    store.export_site_bundle(header, metrics, path)
    headers, bodies = store.read_site_bundles(src.spark, [path], _ddl(header), _ddl(metrics))
    return privacy.import_site_bundles(headers, bodies).select("concept_key", "period_start", "recorded_count", "suppressed")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


# --- A2, A3, E14 for FHIR ------------------------------------------------------------------


def questionnaires(src: Source) -> DataFrame:
    """One questionnaire per part: a group that may repeat, with three items."""
    key = F.col("p_partkey")
    kind = F.when(key % 29 == 0, "unheard-of").otherwise("decimal")
    option = F.struct(F.struct(F.col("p_brand").alias("code"), F.lower("p_brand").alias("display")).alias("valueCoding"))
    when = F.struct(F.lit("SIZE").alias("question"), F.lit(">=").alias("operator"), F.col("p_size").alias("answerInteger"))
    extension = F.when(key % 31 == 0, F.array(F.struct(F.lit("urn:x").alias("url"))))
    children = F.array(
        F.struct(F.lit("SIZE").alias("linkId"), F.lit("integer").alias("type"), F.lit(True).alias("required"), F.lit(None).alias("extension")),
        F.struct(F.lit("PRICE").alias("linkId"), kind.alias("type"), F.lit(False).alias("required"), extension.alias("extension")),
    )
    # Children of different shapes are put into the array as text, so each keeps only its fields.
    texts = F.transform(children, lambda c: F.to_json(c))
    brand = F.to_json(
        F.struct(
            F.lit("BRAND").alias("linkId"), F.col("p_name").alias("text"), F.lit("choice").alias("type"),
            F.array(option).alias("answerOption"), F.array(when).alias("enableWhen"),
        )
    )
    body = F.concat(
        F.lit('{"resourceType":"Questionnaire","id":"part-'), key.cast("string"), F.lit('","version":"'), (F.col("p_size") % 3).cast("string"),
        F.lit('","title":"'), F.col("p_name"), F.lit('","item":[{"linkId":"'), F.col("p_type"), F.lit('","type":"group","repeats":'),
        (F.col("p_size") % 2 == 0).cast("string"), F.lit(',"item":['), F.array_join(texts, ","), F.lit(","), brand, F.lit("]}]}"),
    )
    content = F.when(key % 37 == 0, F.lit("[1, 2")).when(key % 41 == 0, F.lit('{"resourceType":"Patient"}')).otherwise(body)
    return src.spread("part").select(F.concat(F.lit("part/"), key.cast("string")).alias("object_key"), content.alias("content"))


READABLE_SQL = "p_partkey % 37 <> 0 AND p_partkey % 41 <> 0"


@query(
    "a2_read_fhir_questionnaires",
    sql=f"""WITH p AS (SELECT *, 'part-' || p_partkey AS form_id, CAST(p_size % 3 AS VARCHAR) AS version FROM part WHERE {READABLE_SQL})
    SELECT form_id, version, p_type AS path, NULL AS parent_path, p_type AS label, 'group' AS data_type, p_size % 2 = 0 AS repeats, false AS required, NULL AS option, NULL AS condition FROM p
    UNION ALL SELECT form_id, version, p_type || '/SIZE', p_type, 'SIZE', 'integer', false, true, NULL, NULL FROM p
    UNION ALL SELECT form_id, version, p_type || '/PRICE', p_type, 'PRICE', 'decimal', false, false, NULL, NULL FROM p WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0
    UNION ALL SELECT form_id, version, p_type || '/BRAND', p_type, p_name, 'coding', false, false, p_brand || '=' || lower(p_brand), p_type || '/SIZE gte ' || p_size FROM p""",
)
def a2_read_fhir_questionnaires(src: Source) -> DataFrame:
    _, items, _ = fhir.read_questionnaires(questionnaires(src))
    return items.select(
        "form_id", "version", "path", "parent_path", "label", "data_type", "repeats", "required",
        F.when(F.size("options") > 0, F.concat_ws("=", F.try_element_at("options", F.lit(1))["code"], F.try_element_at("options", F.lit(1))["display"])).alias("option"),
        F.when(
            F.size("conditions") > 0,
            F.concat_ws(" ", F.try_element_at("conditions", F.lit(1))["source_item_path"], F.try_element_at("conditions", F.lit(1))["operator"], F.try_element_at("conditions", F.lit(1))["expected"]["s"]),
        ).alias("condition"),
    )


@query(
    "a2_fhir_questionnaire_errors",
    sql=f"""SELECT 'part/' || p_partkey AS object_key, CASE WHEN p_partkey % 37 = 0 THEN 'INVALID_FHIR_JSON' ELSE 'INVALID_FHIR_RESOURCE' END AS error FROM part WHERE NOT ({READABLE_SQL})
    UNION ALL SELECT 'part/' || p_partkey, CASE WHEN p_partkey % 31 = 0 THEN 'UNSUPPORTED_FHIR_EXTENSION' ELSE 'UNSUPPORTED_FHIR_ITEM_TYPE' END FROM part
      WHERE {READABLE_SQL} AND (p_partkey % 29 = 0 OR p_partkey % 31 = 0)""",
)
def a2_fhir_questionnaire_errors(src: Source) -> DataFrame:
    _, _, errors = fhir.read_questionnaires(questionnaires(src))
    return errors.select("object_key", "error")


def asking_questionnaires(src: Source) -> DataFrame:
    """One form per part in which a link id repeats, siblings ask ahead, and some ask about what is not known yet."""
    key = F.col("p_partkey").cast("string")

    def item(link: str, question: str | None = None, below: Column | None = None, operator: str = "=") -> Column:
        when = f',"enableWhen":[{{"question":"{question}","operator":"{operator}","answerInteger":7}}]' if question else ""
        start = F.lit(f'{{"linkId":"{link}","type":"{"group" if below is not None else "integer"}"{when}')
        return F.concat(start, F.lit(',"item":['), below, F.lit("]}")) if below is not None else F.concat(start, F.lit("}"))

    def joined(*parts: Column) -> Column:
        return F.concat_ws(",", *parts)

    early = F.when(F.col("p_partkey") % 5 == 0, item("T", "S")).when(F.col("p_partkey") % 7 == 0, item("T", "Q", None, "~"))
    first = item("G1", None, joined(item("Q"), item("R", "Q"), early))
    second = item("G2", "G1", joined(item("Q"), item("S", "Q")))
    body = joined(item("V", "W"), first, second, item("U", "Q"), item("W", "Q"))
    return src.spread("part").select(
        F.concat(F.lit("asking/"), key).alias("object_key"),
        F.concat(F.lit('{"resourceType":"Questionnaire","id":"q'), key, F.lit('","item":['), body, F.lit("]}")).alias("content"),
    )


@query(
    "a2_conditions_in_order",
    sql="""SELECT 'asking/' || p_partkey AS object_key, path, asks FROM part, (VALUES ('V', 'W'), ('G1', NULL), ('G1/Q', NULL), ('G1/R', 'G1/Q'), ('G2', 'G1'),
      ('G2/Q', NULL), ('G2/S', 'G2/Q'), ('U', 'G2/Q'), ('W', 'G2/Q')) v(path, asks) WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0""",
)
def a2_conditions_in_order(src: Source) -> DataFrame:
    _, items, _ = fhir.read_questionnaires(asking_questionnaires(src), whole=True)
    return items.select("object_key", "path", F.try_element_at("conditions", F.lit(1))["source_item_path"].alias("asks"))


@query(
    "a2_condition_errors",
    sql="""SELECT 'asking/' || p_partkey AS object_key, 'G1/T' AS path, CASE WHEN p_partkey % 5 = 0 THEN 'INVALID_FHIR_CONDITION' ELSE 'UNSUPPORTED_FHIR_CONDITION' END AS error
      FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0""",
)
def a2_condition_errors(src: Source) -> DataFrame:
    return fhir.read_questionnaires(asking_questionnaires(src), whole=True)[2].select("object_key", "path", "error")


RESPONSE_ITEMS = [
    ("STATUS", None, "coding", False, None),
    ("TOTAL", None, "decimal", False, ("STATUS", "ne", ("str", "P", None))),
    ("TAGS", None, "string", False, None),
    ("PARTY", None, "group", True, None),
    ("PARTY/NAME", "PARTY", "string", False, None),
    ("PARTY/ROLE", "PARTY", "coding", False, ("PARTY/NAME", "exists", ("bool", "true", 1))),
    ("NOTE", None, "text", False, None),
]


def response_items(src: Source) -> DataFrame:
    rows = []
    for path, parent, kind, repeats, condition in RESPONSE_ITEMS:
        conditions = []
        if condition:
            tag, text, number = condition[2]
            conditions = [(condition[0], condition[1], (tag, text, None if number is None else Decimal(number)))]
        rows.append(("order", "1", path, parent, kind, repeats, None, conditions))
    return local_table(
        src.spark, rows,
        "form_id string, version string, path string, parent_path string, data_type string, repeats boolean, unit string, "
        f"conditions array<{fhir.CONDITION}>",
    )


def order_documents(src: Source) -> DataFrame:
    """One QuestionnaireResponse per order, with two parties and one or two tags."""
    key = F.col("o_orderkey").cast("string")
    tags = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('{"valueString":"'), "o_orderpriority", F.lit('"},{"valueString":"x"}'))).otherwise(
        F.concat(F.lit('{"valueString":"'), "o_orderpriority", F.lit('"}'))
    )
    total = F.concat(F.lit('{"valueQuantity":{"value":'), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(',"unit":"EUR"}}'))
    second = F.when(F.col("o_custkey") % 2 == 0, '{"linkId":"NAME","answer":[{"valueString":"clerk"}]},').otherwise('{"linkId":"NAME"},')
    bad = F.when(F.col("o_orderkey") % 43 == 0, ',{"linkId":"NOTE","answer":[{"valueString":"a","valueCode":"b"}]}').otherwise("")
    body = F.concat(
        F.lit('{"resourceType":"QuestionnaireResponse","id":"'), key, F.lit('","authored":"'), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('T10:00:00+02:00","item":[{"linkId":"STATUS","answer":[{"valueCoding":{"code":"'), F.col("o_orderstatus"),
        F.lit('"}}]},{"linkId":"TOTAL","answer":['), total, F.lit(']},{"linkId":"TAGS","answer":['), tags,
        F.lit(']},{"linkId":"PARTY","item":[{"linkId":"NAME","answer":[{"valueString":"c'), F.col("o_custkey").cast("string"),
        F.lit('"}]},{"linkId":"ROLE","answer":[{"valueCoding":{"code":"buyer"}}]}]},{"linkId":"PARTY","item":['), second,
        F.lit('{"linkId":"ROLE","answer":[{"valueCoding":{"code":"seller"}}]}]}'), bad, F.lit("]}"),
    )
    return src.spread("orders").select(
        F.lit("site-a").alias("establishment_id"),
        F.col("o_custkey").cast("string").alias("patient_pseudonym"),
        F.concat(F.lit("raw/"), key).alias("object_key"),
        F.lit("order").alias("form_id"),
        F.lit("1").alias("version"),
        body.alias("content"),
    )


RESPONSE_SQL = """r AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS rid FROM orders),
    a AS (
      SELECT rid, 'STATUS' AS item_path, NULL AS group_instance, o_orderstatus AS value, '/item/0/answer/0' AS json_pointer FROM r
      UNION ALL SELECT rid, 'TOTAL', NULL, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '/item/1/answer/0' FROM r
      UNION ALL SELECT rid, 'TAGS', CASE WHEN o_orderstatus = 'F' THEN 'answer:0' END, o_orderpriority, '/item/2/answer/0' FROM r
      UNION ALL SELECT rid, 'TAGS', 'answer:1', 'x', '/item/2/answer/1' FROM r WHERE o_orderstatus = 'F'
      UNION ALL SELECT rid, 'PARTY/NAME', 'PARTY:0', 'c' || o_custkey, '/item/3/item/0/answer/0' FROM r
      UNION ALL SELECT rid, 'PARTY/ROLE', 'PARTY:0', 'buyer', '/item/3/item/1/answer/0' FROM r
      UNION ALL SELECT rid, 'PARTY/NAME', 'PARTY:1', CASE WHEN o_custkey % 2 = 0 THEN 'clerk' END, CASE WHEN o_custkey % 2 = 0 THEN '/item/4/item/0/answer/0' ELSE '/item/4/item/0' END FROM r
      UNION ALL SELECT rid, 'PARTY/ROLE', 'PARTY:1', 'seller', '/item/4/item/1/answer/0' FROM r)"""


@query(
    "a3_read_fhir_responses",
    sql=f"WITH {RESPONSE_SQL} SELECT rid AS response_id, item_path, group_instance, CASE WHEN item_path = 'TOTAL' THEN NULL ELSE value END AS text, CASE WHEN item_path = 'TOTAL' THEN CAST(value AS DOUBLE) END AS number, json_pointer FROM a",
)
def a3_read_fhir_responses(src: Source) -> DataFrame:
    _, answers, _ = fhir.read_responses(order_documents(src), response_items(src), FORM)
    number = F.col("answer.t") == "num"
    return answers.select(
        "response_id", "item_path", "group_instance", F.when(~number, F.col("answer.s")).alias("text"),
        F.when(number, F.col("answer.num").cast("double")).alias("number"), "json_pointer",
    )


@query(
    "e14_canonicalize_fhir",
    sql=f"""WITH {RESPONSE_SQL}, x AS (SELECT rid, item_path, group_instance, value, json_pointer FROM a UNION ALL SELECT rid, 'NOTE', NULL, NULL, '/item' FROM r)
    SELECT rid AS response_id, item_path, group_instance, CASE
        WHEN item_path = 'TOTAL' AND o_orderstatus = 'P' THEN 'NOT_DISPLAYED_BY_FORM_LOGIC'
        WHEN item_path = 'PARTY/ROLE' AND group_instance = 'PARTY:1' AND o_custkey % 2 <> 0 THEN 'NOT_DISPLAYED_BY_FORM_LOGIC'
        WHEN value IS NULL THEN 'NOT_RECORDED' ELSE 'PRESENT' END AS state, json_pointer, o_orderdate::DATE AS authored_date, 'raw/' || rid AS object_key
    FROM x JOIN r USING (rid)""",
)
def e14_canonicalize_fhir(src: Source) -> DataFrame:
    items = response_items(src)
    responses, answers, _ = fhir.read_responses(order_documents(src), items, FORM)
    rows = fhir.canonicalize(responses, answers, items, FORM)
    return rows.select(
        "response_id", "item_path", "group_instance", "state", F.col("evidence")[0]["json_pointer"].alias("json_pointer"),
        "authored_date", F.col("evidence")[0]["object_key"].alias("object_key"),
    )


# --- A4, A5 --------------------------------------------------------------------------------


def structured_source(src: Source) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(key % 5 == 0, "CORRECTED").otherwise("SIGNED")
    return src.spread("orders").select(
        F.lit("site-a").alias("establishment_id"),
        F.lit("order").alias("form_id"),
        F.lit("1").alias("version"),
        F.concat(F.lit("raw/"), key.cast("string")).alias("object_key"),
        key.alias("k"),
        status.alias("status"),
        F.when((key % 5 == 0) & (key % 3 != 0), (key - 1).cast("string")).alias("prior"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
        F.when(key % 7 == 0, "").otherwise("Z").alias("zone"),
        F.when(key % 11 == 0, "structured/0.9").otherwise(structured.SCHEMA_VERSION).alias("schema"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"),
        F.col("o_orderpriority").alias("priority"),
    )


STRUCTURED_OK_SQL = "o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND NOT (o_orderkey % 5 = 0 AND o_orderkey % 3 = 0)"
STRUCTURED_SQL = f"""o AS (SELECT CAST(o_orderkey AS VARCHAR) AS response_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total, o_orderpriority AS priority,
    o_orderdate AS authored_at, CASE WHEN o_orderkey % 5 = 0 THEN 'CORRECTED' ELSE 'SIGNED' END AS lifecycle_status,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey - 1 AS VARCHAR) END AS prior FROM orders WHERE {STRUCTURED_OK_SQL})"""
STRUCTURED_ERRORS_SQL = f"""SELECT 'raw/' || o_orderkey AS object_key, CASE WHEN o_orderkey % 11 = 0 THEN 'UNSUPPORTED_STRUCTURED_SCHEMA' ELSE 'INVALID_STRUCTURED_RESPONSE' END AS error
    FROM orders WHERE NOT ({STRUCTURED_OK_SQL})"""


def json_documents(src: Source) -> DataFrame:
    prior = F.when(F.col("prior").isNotNull(), F.concat(F.lit(',"supersedes_response_id":"'), "prior", F.lit('"'))).otherwise("")
    body = F.concat(
        F.lit('{"schema_version":"'), "schema", F.lit('","response_id":"'), F.col("k").cast("string"), F.lit('","authored_at":"'), "at", "zone",
        F.lit('","lifecycle_status":"'), "status", F.lit('"'), prior, F.lit(',"answers":[{"item_path":"TOTAL","value":'), "total",
        F.lit(',"unit":"EUR"},{"item_path":"PARTY/PRIORITY","value":"'), "priority", F.lit('","group_instance":"PARTY:0","enabled":true},{"item_path":"PAID","value":false},{"item_path":"NOTE","value":null}]}'),
    )
    return structured_source(src).select("establishment_id", *FORM, "object_key", body.alias("content"))


def xml_documents(src: Source) -> DataFrame:
    prior = F.when(F.col("prior").isNotNull(), F.concat(F.lit(' supersedes-response-id="'), "prior", F.lit('"'))).otherwise("")
    body = F.concat(
        F.lit('<?xml version="1.0"?>\n<form-response schema-version="'), "schema", F.lit('" response-id="'), F.col("k").cast("string"), F.lit('" authored-at="'), "at", "zone",
        F.lit('" lifecycle-status="'), "status", F.lit('"'), prior, F.lit('><answer item-path="TOTAL" unit="EUR"><value>'), "total",
        F.lit('</value></answer><answer item-path="PARTY/PRIORITY" group-instance="PARTY:0" enabled="true"><value>'), "priority",
        F.lit('</value></answer><answer item-path="PAID"><value>false</value></answer><answer item-path="NOTE"/></form-response>'),
    )
    return structured_source(src).select("establishment_id", *FORM, "object_key", body.alias("content"))


def _answers_sql(locator: str, total_type: str, paid_type: str) -> str:
    def at(i: int) -> str:
        return locator.format(i=i, j=i + 1)

    return f"""WITH {STRUCTURED_SQL} SELECT response_id, 'TOTAL' AS item_path, NULL AS group_instance, '{total_type}' AS raw_type, total AS raw_value, 'EUR' AS unit, NULL AS declared_enabled, '{at(0)}' AS locator, lifecycle_status, prior FROM o
    UNION ALL SELECT response_id, 'PARTY/PRIORITY', 'PARTY:0', 'str', priority, NULL, true, '{at(1)}', lifecycle_status, prior FROM o
    UNION ALL SELECT response_id, 'PAID', NULL, '{paid_type}', 'false', NULL, NULL, '{at(2)}', lifecycle_status, prior FROM o
    UNION ALL SELECT response_id, 'NOTE', NULL, NULL, NULL, NULL, NULL, '{at(3)}', lifecycle_status, prior FROM o"""


def _flat(responses: DataFrame, answers: DataFrame) -> DataFrame:
    heads = responses.select("response_id", "lifecycle_status", F.col("supersedes_response_id").alias("prior"))
    value = F.when(F.col("raw_type") == "num", F.col("raw_value").cast("decimal(18,2)").cast("string")).otherwise(F.col("raw_value"))
    return answers.join(heads, "response_id").select(
        "response_id", "item_path", "group_instance", "raw_type", value.alias("raw_value"), "unit", "declared_enabled", "locator", "lifecycle_status", "prior"
    )


KEEP = ["establishment_id", *FORM]


@query("a4_read_structured_json", sql=_answers_sql("/answers/{i}", "num", "bool"))
def a4_read_structured_json(src: Source) -> DataFrame:
    responses, answers, _ = structured.read_json_responses(json_documents(src), KEEP)
    return _flat(responses, answers)


@query("a4_structured_json_errors", sql=STRUCTURED_ERRORS_SQL)
def a4_structured_json_errors(src: Source) -> DataFrame:
    return structured.read_json_responses(json_documents(src), KEEP)[2]


@query("a5_read_structured_xml", sql=_answers_sql("/form-response/answer[{j}]", "str", "str"))
def a5_read_structured_xml(src: Source) -> DataFrame:
    responses, answers, _ = structured.read_xml_responses(xml_documents(src), KEEP)
    return _flat(responses, answers)


@query("a5_structured_xml_errors", sql=STRUCTURED_ERRORS_SQL)
def a5_structured_xml_errors(src: Source) -> DataFrame:
    return structured.read_xml_responses(xml_documents(src), KEEP)[2]


DEFINITION_SQL = """SELECT 'part-' || p_partkey AS form_id, 'G' AS path, NULL AS parent_path, 'group' AS data_type, 0 AS item_order, p_size % 2 = 0 AS repeats, NULL AS unit, NULL AS condition, 0 AS options FROM part
    UNION ALL SELECT 'part-' || p_partkey, 'G/SIZE', 'G', 'integer', 0, false, 'cm', NULL, 0 FROM part
    UNION ALL SELECT 'part-' || p_partkey, 'G/KIND', 'G', 'coding', 1, false, NULL, 'G/SIZE gte ' || p_size, 1 FROM part"""


def json_definitions(src: Source) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    body = F.concat(
        F.lit('{"schema_version":"structured/1.0","form":{"ehr_product":"P","ehr_version":"1","form_id":"part-'), key, F.lit('","form_family":"'), F.col("p_brand"),
        F.lit('","version":"1","title":"'), F.col("p_name"), F.lit('","items":[{"item_id":"G","path":"G","label":"Group","data_type":"group","order":0,"repeats":'),
        (F.col("p_size") % 2 == 0).cast("string"), F.lit(',"children":[{"item_id":"SIZE","path":"G/SIZE","label":"Size","data_type":"integer","order":0,"unit":"cm"},'
        '{"item_id":"KIND","path":"G/KIND","label":"Kind","data_type":"coding","order":1,"value_options":[{"code":"'), F.col("p_type"), F.lit('","display":"k"}],'
        '"display_conditions":[{"source_item_path":"G/SIZE","operator":"gte","expected":'), size, F.lit("}]}]}]}}"),
    )
    return src.spread("part").select(F.concat(F.lit("part/"), key).alias("object_key"), body.alias("content"))


def xml_definitions(src: Source) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    body = F.concat(
        F.lit('<form-definition schema-version="structured/1.0" ehr-product="P" ehr-version="1" form-id="part-'), key, F.lit('" form-family="'), F.col("p_brand"),
        F.lit('" version="1" title="'), F.col("p_name"), F.lit('"><metadata key="status" value="on"/><item id="G" label="Group" data-type="group" repeats="'),
        (F.col("p_size") % 2 == 0).cast("string"), F.lit('"><item id="SIZE" data-type="integer" unit="cm"/><item id="KIND" data-type="coding"><option code="'),
        F.col("p_type"), F.lit('"/><condition source-path="G/SIZE" operator="gte" expected-json="'), size, F.lit('"/></item></item></form-definition>'),
    )
    return src.spread("part").select(F.concat(F.lit("part/"), key).alias("object_key"), body.alias("content"))


def _definition_rows(items: DataFrame) -> DataFrame:
    first = F.try_element_at("conditions", F.lit(1))
    condition = F.when(first.isNotNull(), F.concat_ws(" ", first["source_item_path"], first["operator"], first["expected"]["s"]))
    return items.select(
        "form_id", "path", "parent_path", "data_type", "item_order", "repeats", "unit", condition.alias("condition"), F.size("options").alias("options")
    )


@query("a4_read_json_definitions", sql=DEFINITION_SQL)
def a4_read_json_definitions(src: Source) -> DataFrame:
    return _definition_rows(structured.read_json_definitions(json_definitions(src))[1])


@query("a5_read_xml_definitions", sql=DEFINITION_SQL)
def a5_read_xml_definitions(src: Source) -> DataFrame:
    return _definition_rows(structured.read_xml_definitions(xml_definitions(src))[1])


# --- A7 to A11 -----------------------------------------------------------------------------


@query(
    "a7_read_cda_sections",
    sql="""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, doc_id % 3 AS m, text AS body FROM documents),
    t AS (SELECT doc_id, m, lang, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS text FROM d)
    SELECT doc_id, 0 AS pos, CASE WHEN m = 0 THEN 'Untitled section' ELSE 'Language ' || lang END AS title, CASE WHEN m = 0 AND text = '' THEN 'end' ELSE trim(text || ' end') END AS text FROM t
    UNION ALL SELECT doc_id, 1, 'Inner', '' FROM t WHERE m = 2""",
)
def a7_read_cda_sections(src: Source) -> DataFrame:
    # Whole texts: markup escaped, accented letters as references.
    clean = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("é"), F.lit("&#xE9;"))
    m = F.col("doc_id") % 3
    title = F.when(m == 0, F.lit("")).otherwise(F.concat(F.lit("<title> Language\n "), "lang", F.lit("</title>")))
    inner = F.when(m == 2, "<component><section><title>Inner</title><text/></section></component>").otherwise("")
    empty = F.when(m == 1, "<component><section><text>  </text></section></component>").otherwise("")
    body = F.concat(
        F.lit('<ClinicalDocument xmlns="urn:hl7-org:v3"><component><section>'), title, F.lit("<text><paragraph>"), clean,
        F.lit(" </paragraph><list><item>end</item></list></text>"), inner, F.lit("</section></component>"), empty, F.lit("</ClinicalDocument>"),
    )
    docs = src.table("documents").select("doc_id", body.alias("content"))
    return cda.read_sections(docs).filter("error IS NULL").drop("error")


def vocabulary_files(src: Source) -> str:
    """Parts as a concept file, some rows malformed, dates in both spellings."""
    root = fresh_path(src.spark, "vocabulary")
    key = F.col("concept_id")
    text = part_concepts(src).select(
        F.when(key % 53 == 0, "x").otherwise(key.cast("string")).alias("concept_id"),
        F.when(key % 47 == 0, " ").otherwise(F.col("concept_name")).alias("concept_name"),
        "domain_id", "vocabulary_id", "concept_class_id", "standard_concept", "concept_code",
        F.when(key % 2 == 0, "19700101").otherwise("1970-01-01").alias("valid_start_date"),
        F.when(key % 59 == 0, "20991340").otherwise("2099-12-31").alias("valid_end_date"),
        "invalid_reason",
    )
    text.write.option("sep", "\t").option("header", "true").csv(f"{root}/CONCEPT.csv")
    return root


@query(
    "a8_read_vocabulary",
    sql="""SELECT p_partkey AS concept_id, p_name AS concept_name, CASE WHEN p_size > 10 THEN 'S' END AS standard_concept, DATE '1970-01-01' AS valid_start_date, DATE '2099-12-31' AS valid_end_date
    FROM part WHERE p_partkey % 53 <> 0 AND p_partkey % 47 <> 0 AND p_partkey % 59 <> 0""",
)
def a8_read_vocabulary(src: Source) -> DataFrame:
    rows, _ = files.read_vocabulary(src.spark, vocabulary_files(src), "CONCEPT.csv")
    return rows.select("concept_id", "concept_name", "standard_concept", "valid_start_date", "valid_end_date")


@query(
    "a8_vocabulary_errors",
    sql="""SELECT CASE WHEN p_partkey % 53 = 0 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS key, CASE WHEN p_partkey % 53 = 0 THEN 'invalid_integer:concept_id'
      WHEN p_partkey % 47 = 0 THEN 'empty_value:concept_name' ELSE 'invalid_date:valid_end_date' END AS error
    FROM part WHERE p_partkey % 53 = 0 OR p_partkey % 47 = 0 OR p_partkey % 59 = 0""",
)
def a8_vocabulary_errors(src: Source) -> DataFrame:
    _, errors = files.read_vocabulary(src.spark, vocabulary_files(src), "CONCEPT.csv")
    return errors.select("key", "error")


@query("a9_read_evidence")
def a9_read_evidence(src: Source) -> DataFrame:
    """The files of the canonical store as evidence objects; their bytes are not in any table."""
    found = files.read_evidence(src.spark, stored_canonical(src), "*.parquet")
    return found.select("object_key", "size", "checksum_sha256")


@query(
    "a10_synthetic_patients",
    sql="""SELECT true AS synthetic, 'synthetic-7-' || printf('%06d', c_custkey) AS patient_id, CAST(1940 + (c_custkey * 17 + 7) % 70 AS INT) AS birth_year,
      'site-' || substr('abcd', CAST(c_custkey % 4 AS INT) + 1, 1) AS site FROM customer""",
)
def a10_synthetic_patients(src: Source) -> DataFrame:
    return synthetic.synthetic_patients(src.table("customer"), 7, "c_custkey")


@query(
    "a11_synthetic_answer_events",
    sql="""WITH n AS (SELECT l_orderkey * 7 + l_linenumber AS n FROM lineitem)
    SELECT lower(hex(n)) AS key_tail, n // 20 AS patient_number, n % 20 AS item_code, list_extract(['PRESENT','EXPLICITLY_ABSENT','UNKNOWN','NOT_RECORDED','NOT_APPLICABLE','NOT_DISPLAYED_BY_FORM_LOGIC'], n % 6 + 1) AS answer_state,
      CASE WHEN n % 6 = 0 THEN (n % 4000) / 10 END AS value_as_number, list_extract(['none','kg','mm[Hg]','Cel'], (n // 5) % 4 + 1) AS unit,
      list_extract(['site-a','site-b','site-c','site-d'], (n // 50000) % 4 + 1) AS establishment, n // 50000 AS partition FROM n""",
)
def a11_synthetic_answer_events(src: Source) -> DataFrame:
    numbers = src.table("lineitem").select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("id"))
    rows = synthetic.synthetic_answers(numbers)
    tail = F.lower(F.ltrim(F.substring(F.hex("clinical_event_id"), 17, 16), F.lit("0")))
    return rows.select(tail.alias("key_tail"), *[c for c in rows.columns if c != "clinical_event_id"])


@query(
    "a11_published_count",
    sql="""WITH n AS (SELECT l_orderkey * 7 + l_linenumber AS n FROM lineitem) SELECT CASE WHEN n % 6 <= 2 THEN 'PUBLISH' ELSE 'OMIT' END AS decision, count(*) AS events FROM n GROUP BY 1""",
)
def a11_published_count(src: Source) -> DataFrame:
    numbers = src.table("lineitem").select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("id"))
    rows = synthetic.synthetic_answers(numbers)
    return rows.groupBy(synthetic.decision_of(F.col("answer_state")).alias("decision")).agg(F.count(F.lit(1)).alias("events"))
