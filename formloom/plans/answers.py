"""Answer states, canonicalization, mapping, standardization and quality on the driver tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.answers import SCALAR, answer_state
from formloom.operators import canonical, lifecycle, mapping, quality, standardize
from formloom.operators.catalog import batch_summary
from formloom.plans.registry import Source, query
from formloom.plans.sqltext import sql_uuid
from formloom.session import cut, local_table

# --- E1, E6, E13, E12, E15, E16 ------------------------------------------------------------

STATE_SQL = """
    CASE WHEN lifecycle_status = 'DELETED' THEN 'DELETED'
         WHEN lifecycle_status = 'VOIDED' THEN 'VOIDED'
         WHEN lifecycle_status = 'DRAFT' THEN 'NOT_RECORDED'
         WHEN NOT {enabled} THEN 'NOT_DISPLAYED_BY_FORM_LOGIC'
         WHEN raw_value IS NULL OR raw_value = '' THEN 'NOT_RECORDED'
         WHEN lower(trim(raw_value)) IN ('false','non','no') THEN 'EXPLICITLY_ABSENT'
         WHEN lower(trim(raw_value)) IN ('unknown','inconnu') THEN 'UNKNOWN'
         WHEN lower(trim(raw_value)) IN ('n/a','not-applicable') THEN 'NOT_APPLICABLE'
         ELSE 'PRESENT' END"""


@query(
    "e1_answer_state",
    "b_answers",
    sql=f"""
    SELECT response_id, raw_value, lifecycle_status, enabled,
           {STATE_SQL.format(enabled='enabled')} AS state
    FROM b_answers""",
)
def e1_answer_state(src: Source) -> DataFrame:
    answers = src.view("b_answers")
    state = answer_state(F.lit(True), F.col("enabled"), F.col("raw_value"), F.col("lifecycle_status"))
    return answers.select("response_id", "raw_value", "lifecycle_status", "enabled", state.alias("state"))


DECLARED_SQL = """CASE item_path WHEN 'click' THEN 'decimal' WHEN 'view' THEN 'integer'
    WHEN 'signup' THEN 'boolean' WHEN 'purchase' THEN 'string' ELSE 'date' END"""


def declared_type(path: Column) -> Column:
    return (
        F.when(path == "click", "decimal")
        .when(path == "view", "integer")
        .when(path == "signup", "boolean")
        .when(path == "purchase", "string")
        .otherwise("date")
    )


@query(
    "e6_coerce_value",
    "b_answers",
    sql=f"""
    WITH raw AS (
      SELECT response_id, {DECLARED_SQL} AS data_type,
             CASE CAST(response_id AS BIGINT) % 4
                  WHEN 0 THEN CAST(CAST(floor(length(props) * 1.0) AS BIGINT) AS VARCHAR)
                  WHEN 1 THEN CASE WHEN enabled THEN 'TRUE' ELSE 'false' END
                  WHEN 2 THEN CAST(CAST(authored_at AS DATE) AS VARCHAR)
                  ELSE raw_value END AS raw_value
      FROM b_answers)
    SELECT response_id, data_type, raw_value,
           CASE data_type
             WHEN 'decimal' THEN CAST(TRY_CAST(trim(raw_value) AS DECIMAL(38,9)) AS DOUBLE)
             WHEN 'integer' THEN CASE WHEN regexp_full_match(trim(raw_value), '[+-]?[0-9]+')
                                      THEN CAST(raw_value AS DOUBLE) END
             WHEN 'boolean' THEN CASE lower(raw_value) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 END
           END AS number,
           CASE data_type WHEN 'string' THEN raw_value
             WHEN 'date' THEN CASE WHEN regexp_full_match(raw_value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
                                   THEN CAST(TRY_CAST(raw_value AS DATE) AS VARCHAR) END
             WHEN 'boolean' THEN CASE WHEN lower(raw_value) IN ('true','false') THEN lower(raw_value) END
           END AS text,
           CASE WHEN raw_value IS NOT NULL AND number IS NULL AND text IS NULL
                THEN 'INVALID_DATA_TYPE' END AS type_error
    FROM raw""",
)
def e6_coerce_value(src: Source) -> DataFrame:
    answers = src.view("b_answers")
    kind = F.col("response_id").cast("bigint") % 4
    raw = (
        F.when(kind == 0, F.length("props").cast("string"))
        .when(kind == 1, F.when(F.col("enabled"), "TRUE").otherwise("false"))
        .when(kind == 2, F.col("authored_at").cast("date").cast("string"))
        .otherwise(F.col("raw_value"))
    )
    dense = answers.select(
        "response_id",
        declared_type(F.col("item_path")).alias("data_type"),
        F.lit("str").alias("raw_type"),
        raw.alias("raw_value"),
    )
    typed = canonical.type_answers(dense)
    is_number = F.col("data_type").isin("decimal", "integer", "boolean")
    return typed.select(
        "response_id",
        "data_type",
        "raw_value",
        F.when(is_number, F.col("answer.num").cast("double")).alias("number"),
        F.when(F.col("data_type").isin("string", "date", "boolean"), F.col("answer.s")).alias("text"),
        "type_error",
    )


CHECKSUM_SQL = "sha256(props)"
EVENT_ID_SQL = sql_uuid("canonical-answer", "establishment_id", "response_id", "item_path", "'0'")


def eav_canonical(src: Source) -> DataFrame:
    """Canonical rows of the event answers, with form and evidence columns."""
    return event_canonical(src.view("b_answers"))


def event_canonical(answers: DataFrame) -> DataFrame:
    contract = canonical.read_eav(answers).withColumnsRenamed({"patient_id": "patient_pseudonym"})
    rows = canonical.canonicalize_eav(contract)
    rows = canonical.attach_evidence(
        rows,
        object_key=F.concat(F.lit("raw/events/"), F.col("response_id")),
        checksum_sha256=F.sha2("props", 256),
        media_type=F.lit("application/json"),
        json_pointer=F.lit("/k"),
        extraction_method=F.lit("STRUCTURED_FORM"),
        extractor_version=F.lit("tabular-eav/1.0.0"),
    )
    return rows.withColumns(
        {
            "form_id": F.lit("events"),
            "form_version": F.lit("1"),
            "source_fingerprint": F.concat(F.lit("sf-"), F.col("establishment_id")),
            "compatibility_fingerprint": F.lit("cf-events"),
            "authored_date": F.col("authored_at").cast("date"),
        }
    )


@query(
    "e13_canonicalize_eav",
    "b_answers",
    sql=f"""
    SELECT response_id, {EVENT_ID_SQL} AS event_id, {STATE_SQL.format(enabled='true')} AS state,
           CASE WHEN {STATE_SQL.format(enabled='true')} = 'PRESENT' THEN raw_value END AS value,
           unit, {CHECKSUM_SQL} AS evidence_checksum
    FROM b_answers""",
)
def e13_canonicalize_eav(src: Source) -> DataFrame:
    return eav_canonical(src).select(
        "response_id",
        "event_id",
        "state",
        F.col("value.s").alias("value"),
        "unit",
        F.col("evidence")[0]["checksum_sha256"].alias("evidence_checksum"),
    )


@query(
    "a6_read_eav",
    "b_answers",
    sql="""
    SELECT lifecycle_status, count(*) AS answers, count(raw_value) AS with_value,
           count(unit) AS with_unit, count(DISTINCT patient_id) AS patients
    FROM b_answers GROUP BY lifecycle_status""",
)
def a6_read_eav(src: Source) -> DataFrame:
    source = src.view("b_answers").withColumnsRenamed({"raw_value": "answer", "patient_id": "subject"})
    rows = canonical.read_eav(source, {"raw_value": "answer", "patient_id": "subject"})
    return rows.groupBy("lifecycle_status").agg(
        F.count(F.lit(1)).alias("answers"),
        F.count("raw_value").alias("with_value"),
        F.count("unit").alias("with_unit"),
        F.countDistinct("patient_id").alias("patients"),
    )


@query(
    "e9_attach_evidence",
    "b_answers",
    sql=f"""
    SELECT 'raw/events/' || response_id AS object_key, {CHECKSUM_SQL} AS checksum_sha256,
           'application/json' AS media_type, '/k' AS json_pointer,
           'STRUCTURED_FORM' AS extraction_method, 1 AS evidence_count
    FROM b_answers""",
)
def e9_attach_evidence(src: Source) -> DataFrame:
    first = F.col("evidence")[0]
    names = ("object_key", "checksum_sha256", "media_type", "json_pointer", "extraction_method")
    return eav_canonical(src).select(
        *[first[name].alias(name) for name in names], F.size("evidence").alias("evidence_count")
    )


@query(
    "e10_attach_lifecycle",
    "b_chain",
    sql=f"""
    SELECT event_id, lifecycle_status AS status,
           CASE WHEN supersedes_event_id IS NOT NULL THEN
             {sql_uuid("canonical-answer", "'site-' || patient_id", "supersedes_event_id", "'TOTAL'", "'0'")}
           END AS supersedes_id
    FROM b_chain""",
)
def e10_attach_lifecycle(src: Source) -> DataFrame:
    rows = src.view("b_chain").select(
        "event_id",
        F.concat(F.lit("site-"), F.col("patient_id").cast("string")).alias("establishment_id"),
        F.col("supersedes_event_id").cast("string").alias("supersedes_response_id"),
        F.lit("TOTAL").alias("item_path"),
        F.lit(None).cast("string").alias("group_instance"),
        "lifecycle_status",
        "authored_at",
        F.lit(0).alias("source_sequence"),
    )
    step = F.col("lifecycle")[0]
    return canonical.attach_lifecycle(rows).select(
        "event_id", step["status"].alias("status"), step["supersedes_event_id"].alias("supersedes_id")
    )


@query(
    "e12_canonical_invariants",
    "b_answers",
    sql=f"""
    WITH c AS (SELECT *, {EVENT_ID_SQL} AS event_id, CAST(response_id AS BIGINT) AS n,
                      {STATE_SQL.format(enabled='true')} AS state FROM b_answers),
    v AS (SELECT *, CASE WHEN n % 5 = 0 THEN true ELSE state = 'PRESENT' AND n % 7 <> 0 END AS has_value
          FROM c)
    SELECT event_id, 'PRESENT_REQUIRES_VALUE' AS violation FROM v WHERE state = 'PRESENT' AND NOT has_value
    UNION ALL SELECT event_id, 'STATE_FORBIDS_VALUE' FROM v WHERE state NOT IN ('PRESENT','INVALID') AND has_value
    UNION ALL SELECT event_id, 'SPAN_PAIRING' FROM v WHERE n % 19 = 0
    UNION ALL SELECT event_id, 'SPAN_ORDER' FROM v WHERE n % 19 <> 0 AND n % 23 = 0
    UNION ALL SELECT event_id, 'CONFIDENCE_RANGE' FROM v WHERE n % 29 = 0
    UNION ALL SELECT event_id, 'CHECKSUM_FORMAT' FROM v WHERE n % 31 = 0""",
)
def e12_canonical_invariants(src: Source) -> DataFrame:
    n = F.col("response_id").cast("bigint")
    rows = eav_canonical(src)
    keep = F.when(n % 5 == 0, F.lit(True)).otherwise((F.col("state") == "PRESENT") & (n % 7 != 0))
    some = F.struct(F.lit("str").alias("t"), F.lit("x").alias("s"), F.lit(None).cast("decimal(38,9)").alias("num"))
    damaged = rows.withColumn("value", F.when(keep, some)).withColumn("digest", F.sha2("response_id", 256))
    damaged = canonical.attach_evidence(
        damaged,
        checksum_sha256=F.when(n % 31 == 0, F.lit("XYZ")).otherwise(F.col("digest")),
        text_span_start=F.lit(4),
        text_span_end=F.when(n % 19 == 0, F.lit(None)).when(n % 23 == 0, 4).otherwise(9),
        confidence=F.when(n % 29 == 0, 1.5).otherwise(0.5),
    )
    return canonical.invariant_violations(damaged).select("event_id", "violation")


@query(
    "e16_validate_manifests",
    sql="""
    WITH m AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day,
                      CAST(max(o_orderdate) AS DATE) AS last_day, count(*) AS n,
                      min(o_orderkey) AS k FROM orders GROUP BY o_custkey)
    SELECT o_custkey AS manifest_id, 'CHECKSUM_ARITY' AS violation FROM m WHERE k % 3 = 0
    UNION ALL SELECT o_custkey, 'CHECKSUM_FORMAT' FROM m WHERE k % 5 = 0
    UNION ALL SELECT o_custkey, 'PERIOD_ORDER' FROM m WHERE k % 2 = 0 AND last_day > first_day
    UNION ALL SELECT o_custkey, 'RECORD_COUNT' FROM m WHERE n - 4 < 0""",
)
def e16_validate_manifests(src: Source) -> DataFrame:
    grouped = src.table("orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("first_day"),
        F.max("o_orderdate").cast("date").alias("last_day"),
        (F.count(F.lit(1)) - 4).alias("record_count"),
        F.min("o_orderkey").alias("k"),
    )
    swap = F.col("k") % 2 == 0
    sums = F.array(F.when(F.col("k") % 5 == 0, F.lit("bad")).otherwise(F.sha2(F.col("k").cast("string"), 256)))
    manifests = grouped.select(
        F.col("o_custkey").alias("manifest_id"),
        "record_count",
        F.when(F.col("k") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("object_keys"),
        sums.alias("object_checksums"),
        F.when(swap, F.col("last_day")).otherwise(F.col("first_day")).alias("source_period_start"),
        F.when(swap, F.col("first_day")).otherwise(F.col("last_day")).alias("source_period_end"),
    )
    return canonical.manifest_violations(manifests)


# --- order forms: E2, E3, E4, E5, E7, E8, E14 ----------------------------------------------

FORM = ["form_id", "form_version"]
NUM = "decimal(38,9)"
ITEM_SCHEMA = f"""form_id string, form_version string, path string, data_type string,
    repeated_root string, unit string,
    conditions array<struct<source_item_path:string,operator:string,expected:{SCALAR}>>"""


def _expect_number(value: str) -> tuple:
    return ("num", value, Decimal(value))


def order_items(src: Source) -> DataFrame:
    """The order form: three header items and a repeated line group of four."""
    rows = [
        ("STATUS", "coding", None, None, []),
        ("PRIORITY", "coding", None, None, [("TOTAL", "exists", ("bool", "true", Decimal(1)))]),
        ("TOTAL", "decimal", None, "EUR", [("STATUS", "ne", ("str", "F", None))]),
        ("LINE", "group", "LINE", None, []),
        ("LINE/QTY", "decimal", "LINE", None, []),
        ("LINE/PRICE", "decimal", "LINE", "EUR", [("LINE/QTY", "gte", _expect_number("10"))]),
        ("LINE/DISC", "decimal", "LINE", "pct", [
            ("LINE/FLAG", "eq", ("str", "R", None)),
            ("PRIORITY", "ne", ("str", "1-URGENT", None)),
        ]),
        ("LINE/FLAG", "coding", "LINE", None, []),
    ]
    return local_table(src.spark, [("order", "1", *row) for row in rows], ITEM_SCHEMA)


def order_responses(src: Source) -> DataFrame:
    return src.table("orders").select(
        F.concat(F.lit("site-"), (F.col("o_custkey") % 5).cast("string")).alias("establishment_id"),
        F.col("o_orderkey").cast("string").alias("response_id"),
        F.lit("order").alias("form_id"),
        F.lit("1").alias("form_version"),
        F.col("o_custkey").cast("string").alias("patient_pseudonym"),
        F.col("o_orderdate").alias("authored_at"),
        F.when(F.col("o_orderkey") % 13 == 0, "DRAFT").otherwise("SIGNED").alias("lifecycle_status"),
    )


def _site_answers(src: Source) -> DataFrame:
    """``b_order_answers`` of known orders with their site and form, joined by line and order before the answers
    are spread out, so that no answer is shuffled here."""
    site = order_responses(src).select("establishment_id", "response_id", *FORM)
    key = F.col("o_orderkey").cast("string").alias("response_id")
    heads = src.table("orders").select(key, "o_orderstatus", "o_orderpriority", "o_totalprice").join(site, "response_id")
    lines = src.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("response_id"), "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"
    )
    # By order alone, so that lines are grouped and joined where they are.
    lines = lines.repartition("response_id").groupBy("response_id", "l_linenumber").agg(
        F.min("l_quantity").alias("qty"), F.min("l_extendedprice").alias("price"), F.min("l_discount").alias("disc"), F.min("l_returnflag").alias("flag")
    ).join(site, "response_id")

    def money(column: str) -> Column:
        return F.col(column).cast("decimal(18,2)").cast("string")

    def spread(rows: DataFrame, instance: Column, values: dict[str, Column], skipped: Column) -> DataFrame:
        each = F.array(*[F.struct(F.lit(path).alias("item_path"), value.alias("raw_value")) for path, value in values.items()])
        out = rows.select(*site.columns, instance.cast("string").alias("group_instance"), skipped.alias("_skipped"), F.explode(each).alias("e"))
        kept = F.col("_skipped").isNull() | (F.col("e.item_path") != F.col("_skipped"))
        return out.filter(kept).select(*site.columns, "group_instance", "e.*")

    inside = {"LINE/QTY": money("qty"), "LINE/PRICE": money("price"), "LINE/DISC": money("disc"), "LINE/FLAG": F.col("flag")}
    outside = {"STATUS": F.col("o_orderstatus"), "PRIORITY": F.col("o_orderpriority"), "TOTAL": money("o_totalprice")}
    # NOT (item = 'DISC' AND disc = 0) is unknown, and drops the row, where the discount is null.
    instance = F.concat(F.lit("LINE:"), F.col("l_linenumber").cast("string"))
    of_lines = spread(lines, instance, inside, F.when(F.coalesce(F.col("disc") == 0, F.lit(True)), "LINE/DISC"))
    of_heads = spread(heads, F.lit(None), outside, F.when(F.coalesce(F.col("o_orderstatus") == "P", F.lit(True)), "TOTAL"))
    return of_lines.unionByName(of_heads)


def order_answers(src: Source) -> DataFrame:
    """Answers of known orders, with type tags and a document position."""
    answers = _site_answers(src)
    text = F.col("item_path").isin("STATUS", "PRIORITY", "LINE/FLAG")
    rank = F.when(F.col("group_instance").isNull(), 0).otherwise(
        F.substring_index("group_instance", ":", -1).cast("bigint") * 10
    )
    within = (
        F.when(F.col("item_path").isin("STATUS", "LINE/QTY"), 1)
        .when(F.col("item_path").isin("PRIORITY", "LINE/PRICE"), 2)
        .when(F.col("item_path").isin("TOTAL", "LINE/DISC"), 3)
        .otherwise(4)
    )
    return answers.select(
        "establishment_id",
        "response_id",
        *FORM,
        "item_path",
        "group_instance",
        F.when(text, "str").otherwise("num").alias("raw_type"),
        "raw_value",
        F.lit(None).cast("string").alias("unit"),
        (rank + within).alias("pos"),
    )


# Expected rows, context and display state of the order form, in SQL.
ORDER_SQL = """
    inst AS (SELECT DISTINCT response_id, group_instance FROM b_order_answers WHERE group_instance IS NOT NULL),
    expected AS (
      SELECT CAST(o_orderkey AS VARCHAR) AS response_id, i.p AS item_path, CAST(NULL AS VARCHAR) AS group_instance
      FROM orders CROSS JOIN (VALUES ('STATUS'),('PRIORITY'),('TOTAL')) i(p)
      UNION ALL
      SELECT response_id, 'LINE/' || i.p, group_instance
      FROM inst JOIN orders ON CAST(o_orderkey AS VARCHAR) = response_id
      CROSS JOIN (VALUES ('QTY'),('PRICE'),('DISC'),('FLAG')) i(p)),
    dense AS (
      SELECT e.*, a.raw_value, a.response_id IS NOT NULL AS present,
             o.o_custkey % 5 AS site, o.o_orderkey % 13 = 0 AS draft
      FROM expected e JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = e.response_id
      LEFT JOIN b_order_answers a ON a.response_id = e.response_id AND a.item_path = e.item_path
        AND a.group_instance IS NOT DISTINCT FROM e.group_instance),
    shown AS (
      SELECT d.*, CASE d.item_path
        WHEN 'PRIORITY' THEN EXISTS (SELECT 1 FROM b_order_answers x WHERE x.response_id = d.response_id
             AND x.item_path = 'TOTAL')
        WHEN 'TOTAL' THEN EXISTS (SELECT 1 FROM b_order_answers x WHERE x.response_id = d.response_id
             AND x.item_path = 'STATUS' AND x.raw_value <> 'F')
        WHEN 'LINE/PRICE' THEN EXISTS (SELECT 1 FROM b_order_answers x WHERE x.response_id = d.response_id
             AND x.group_instance = d.group_instance AND x.item_path = 'LINE/QTY'
             AND CAST(x.raw_value AS DOUBLE) >= 10)
        WHEN 'LINE/DISC' THEN EXISTS (SELECT 1 FROM b_order_answers x WHERE x.response_id = d.response_id
             AND x.group_instance = d.group_instance AND x.item_path = 'LINE/FLAG' AND x.raw_value = 'R')
          AND EXISTS (SELECT 1 FROM b_order_answers x WHERE x.response_id = d.response_id
             AND x.item_path = 'PRIORITY' AND x.raw_value <> '1-URGENT')
        ELSE true END AS enabled FROM dense d)"""


@query(
    "e3_densify_answers",
    "b_order_answers",
    sql=f"WITH {ORDER_SQL} SELECT response_id, item_path, group_instance, present, raw_value FROM dense",
)
def e3_densify_answers(src: Source) -> DataFrame:
    dense = canonical.densify(order_responses(src), order_answers(src), order_items(src), FORM)
    return dense.select("response_id", "item_path", "group_instance", "present", "raw_value")


def order_shown(src: Source) -> DataFrame:
    kinds = order_items(src).select(*FORM, F.col("path").alias("item_path"), "data_type")
    typed = canonical.type_answers(order_answers(src).join(kinds, [*FORM, "item_path"], "left")).drop("data_type")
    typed = cut(typed.drop("raw_type", "raw_value", "unit", "type_error"), "typed-answers")
    # What was answered is only looked up by the conditions; the rows that are told apart need not carry it.
    given = typed.select(*canonical.RESPONSE_KEY, *FORM, "item_path", "group_instance")
    responses = order_responses(src).select(*canonical.RESPONSE_KEY, *FORM)
    dense = canonical.densify(responses, given, order_items(src).drop("unit"), FORM)
    return canonical.display_state(dense, typed, order_items(src), FORM)


@query(
    "e2_display_conditions",
    "b_order_answers",
    sql=f"""WITH {ORDER_SQL}
    SELECT response_id, item_path, group_instance, enabled FROM shown""",
)
def e2_display_conditions(src: Source) -> DataFrame:
    return order_shown(src).select("response_id", "item_path", "group_instance", "enabled")


@query(
    "e5_answer_context",
    "b_order_answers",
    sql="""
    SELECT response_id, group_instance, own_quantity, outer_priority
    FROM (SELECT response_id, group_instance, max(CASE WHEN item_path = 'LINE/QTY' THEN raw_value END) AS own_quantity,
            bool_or(item_path = 'LINE/PRICE') AS priced
          FROM b_order_answers WHERE group_instance IS NOT NULL GROUP BY response_id, group_instance) g
    JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS response_id, o_orderpriority AS outer_priority FROM orders) o USING (response_id)
    WHERE priced""",
)
def e5_answer_context(src: Source) -> DataFrame:
    answers = order_answers(src).withColumn("answer", F.col("raw_value"))
    priced = answers.filter("item_path = 'LINE/PRICE'").select(*canonical.RESPONSE_KEY, "group_instance")
    sources = local_table(
        src.spark, [("order", "1", "LINE/QTY"), ("order", "1", "PRIORITY")],
        "form_id string, form_version string, item_path string",
    )
    seen = canonical.with_context(priced, canonical.answer_context(answers, sources, FORM))
    return seen.select(
        "response_id",
        "group_instance",
        canonical.visible(F.lit("LINE/QTY")).alias("own_quantity"),
        canonical.visible(F.lit("PRIORITY")).alias("outer_priority"),
    )


@query(
    "e8_display_conflicts",
    "b_order_answers",
    sql=f"""WITH {ORDER_SQL}
    SELECT response_id, item_path, group_instance, 'CONDITIONAL_LOGIC_CONFLICT' AS reason
    FROM shown WHERE present AND CAST(response_id AS BIGINT) % 3 <> 0
      AND enabled <> (CAST(response_id AS BIGINT) % 3 = 1)""",
)
def e8_display_conflicts(src: Source) -> DataFrame:
    n = F.col("response_id").cast("bigint") % 3
    declared = F.when(F.col("present") & (n != 0), n == 1)
    return canonical.display_conflicts(order_shown(src).withColumn("declared_enabled", declared)).select(
        "response_id", "item_path", "group_instance", "reason"
    )


@query(
    "e14_canonicalize_structured",
    "b_order_answers",
    sql=f"""WITH {ORDER_SQL}
    SELECT {sql_uuid("canonical-answer", "'site-' || site", "response_id", "item_path", "coalesce(group_instance, '0')")} AS event_id,
           response_id, item_path, group_instance,
           CASE WHEN draft THEN 'NOT_RECORDED' WHEN NOT enabled THEN 'NOT_DISPLAYED_BY_FORM_LOGIC'
                WHEN NOT present OR raw_value IS NULL THEN 'NOT_RECORDED' ELSE 'PRESENT' END AS state,
           CASE WHEN NOT draft AND enabled AND present THEN CAST(CASE WHEN item_path IN
             ('LINE/QTY','LINE/PRICE','LINE/DISC','TOTAL') THEN raw_value END AS DOUBLE) END AS number,
           CASE WHEN present THEN NULL WHEN item_path = 'TOTAL' THEN 'EUR' WHEN item_path = 'LINE/DISC'
             THEN 'pct' END AS unit
    FROM shown""",
)
def e14_canonicalize_structured(src: Source) -> DataFrame:
    rows = canonical.canonicalize_structured(
        order_responses(src), order_answers(src), order_items(src), FORM
    )
    return rows.select(
        "event_id", "response_id", "item_path", "group_instance", "state",
        F.col("value.num").cast("double").alias("number"), "unit",
    )


def faulty_answers(src: Source) -> DataFrame:
    """The order answers with declared display states, and some that break the form."""
    own = order_answers(src).withColumn(
        "declared_enabled", F.when((F.col("item_path") == "LINE/PRICE") & (F.col("response_id").cast("bigint") % 4 == 1), F.lit(True))
    )
    key = F.col("response_id").cast("bigint")

    def extra(divisor: int, path: str, instance: str | None, pos: int):
        made = F.struct(F.lit(path).alias("item_path"), F.lit(instance).cast("string").alias("group_instance"), F.lit(pos).cast("bigint").alias("pos"))
        return F.when(key % divisor == 0, made)

    wrong = F.array_compact(
        F.array(
            extra(50, "NOPE", None, 900_001), extra(70, "STATUS", None, 900_002), extra(110, "TOTAL", "LINE:1", 900_003),
            extra(130, "LINE/QTY", None, 900_004), extra(190, "LINE", "LINE:1", 900_005),
        )
    )
    added = order_responses(src).select("establishment_id", "response_id", *FORM, F.explode(wrong).alias("w")).select(
        "establishment_id", "response_id", *FORM, "w.item_path", "w.group_instance", F.lit("str").alias("raw_type"), F.lit("x").alias("raw_value"),
        F.lit(None).cast("string").alias("unit"), "w.pos", F.lit(None).cast("boolean").alias("declared_enabled"),
    )
    return own.unionByName(added)


FAULT_SQL = f"""{ORDER_SQL},
    k AS (SELECT CAST(o_orderkey AS VARCHAR) AS response_id, o_orderkey AS n, o_orderstatus FROM orders),
    shape AS (
      SELECT response_id, 'NOPE' AS item_path, CAST(NULL AS VARCHAR) AS group_instance, 'UNKNOWN_ITEM_PATH' AS reason FROM k WHERE n % 50 = 0
      UNION ALL SELECT response_id, 'STATUS', NULL, 'DUPLICATE_ANSWER' FROM k WHERE n % 70 = 0
      UNION ALL SELECT response_id, 'TOTAL', 'LINE:1', 'REPEATED_GROUP_CONFLICT' FROM k WHERE n % 110 = 0
      UNION ALL SELECT response_id, 'LINE/QTY', NULL, 'REPEATED_GROUP_CONFLICT' FROM k WHERE n % 130 = 0
      UNION ALL SELECT response_id, 'LINE', 'LINE:1', 'INVALID_STRUCTURED_VALUE' FROM k WHERE n % 190 = 0),
    fault AS (
      SELECT * FROM shape
      UNION ALL SELECT s.response_id, s.item_path, s.group_instance, 'CONDITIONAL_LOGIC_CONFLICT' FROM shown s
      WHERE s.item_path = 'LINE/PRICE' AND s.present AND NOT s.enabled AND CAST(s.response_id AS BIGINT) % 4 = 1
        AND s.response_id NOT IN (SELECT response_id FROM shape))"""


@query(
    "e14_structured_errors",
    "b_order_answers",
    sql=f"WITH {FAULT_SQL} SELECT response_id, item_path, group_instance, reason FROM fault",
)
def e14_structured_errors(src: Source) -> DataFrame:
    stream = canonical.canonical_stream(order_responses(src), faulty_answers(src), order_items(src), FORM)
    return canonical.canonical_errors(stream).select("response_id", "item_path", "group_instance", "reason")


@query(
    "e14_structured_accepted",
    "b_order_answers",
    sql=f"""WITH {FAULT_SQL}
    SELECT 'site-' || site AS establishment_id, CASE WHEN draft THEN 'NOT_RECORDED' WHEN NOT enabled THEN 'NOT_DISPLAYED_BY_FORM_LOGIC'
             WHEN NOT present OR raw_value IS NULL THEN 'NOT_RECORDED' ELSE 'PRESENT' END AS state,
           count(*) AS n_answers, count(DISTINCT response_id) AS n_responses
    FROM shown WHERE response_id NOT IN (SELECT response_id FROM fault) GROUP BY 1, 2""",
)
def e14_structured_accepted(src: Source) -> DataFrame:
    rows = canonical.canonicalize_structured(order_responses(src), faulty_answers(src), order_items(src), FORM)
    return rows.groupBy("establishment_id", "state").agg(
        F.count(F.lit(1)).alias("n_answers"), F.countDistinct("response_id").alias("n_responses")
    )


@query(
    "e7_answer_shape_errors",
    sql="""
    WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate,
                 CASE l_returnflag WHEN 'A' THEN 'LINE/QTY' WHEN 'N' THEN 'LINE/PRICE'
                   ELSE CASE l_linenumber WHEN 1 THEN 'LINE' WHEN 2 THEN 'TOTAL' WHEN 3 THEN 'NOPE'
                        ELSE 'LINE/FLAG' END END AS item_path,
                 CASE WHEN l_tax = 0 THEN NULL ELSE 'LINE:' || l_linenumber END AS group_instance
               FROM lineitem),
    c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, item_path, group_instance) AS n FROM a)
    SELECT CAST(l_orderkey AS VARCHAR) AS response_id, item_path, group_instance,
           CASE WHEN item_path = 'NOPE' THEN 'UNKNOWN_ITEM_PATH'
                WHEN item_path = 'LINE' THEN 'INVALID_STRUCTURED_VALUE'
                WHEN item_path LIKE 'LINE/%' AND group_instance IS NULL THEN 'REPEATED_GROUP_CONFLICT'
                WHEN item_path = 'TOTAL' AND group_instance IS NOT NULL THEN 'REPEATED_GROUP_CONFLICT'
                WHEN n > 1 THEN 'DUPLICATE_ANSWER' END AS reason
    FROM c WHERE reason IS NOT NULL""",
)
def e7_answer_shape_errors(src: Source) -> DataFrame:
    odd = (
        F.when(F.col("l_linenumber") == 1, "LINE")
        .when(F.col("l_linenumber") == 2, "TOTAL")
        .when(F.col("l_linenumber") == 3, "NOPE")
        .otherwise("LINE/FLAG")
    )
    path = F.when(F.col("l_returnflag") == "A", "LINE/QTY").when(F.col("l_returnflag") == "N", "LINE/PRICE").otherwise(odd)
    answers = src.table("lineitem").select(
        F.lit("site").alias("establishment_id"),
        F.col("l_orderkey").cast("string").alias("response_id"),
        F.lit("order").alias("form_id"),
        F.lit("1").alias("form_version"),
        path.alias("item_path"),
        F.when(F.col("l_tax") != 0, F.concat(F.lit("LINE:"), F.col("l_linenumber").cast("string"))).alias("group_instance"),
    )
    return canonical.answer_shape_errors(answers, order_items(src), FORM).select(
        "response_id", "item_path", "group_instance", "reason"
    )


@query(
    "e4_group_instances",
    "b_turns",
    sql="""
    SELECT response_id, item_path, pos,
           row_number() OVER (PARTITION BY response_id, item_path ORDER BY pos) - 1 AS occurrence,
           CASE WHEN item_path = 'system' THEN 'conv:' || response_id
                ELSE 'conv:' || response_id || '/' || item_path || ':' ||
                  (row_number() OVER (PARTITION BY response_id, item_path ORDER BY pos) - 1) END AS group_instance
    FROM b_turns""",
)
def e4_group_instances(src: Source) -> DataFrame:
    turns = src.view("b_turns").select(
        "response_id",
        "item_path",
        "pos",
        F.concat(F.lit("conv:"), F.col("response_id").cast("string")).alias("parent_instance"),
        (F.col("item_path") != "system").alias("repeats"),
    )
    numbered = canonical.group_instances(turns, ["response_id", "parent_instance", "item_path"])
    return numbered.select("response_id", "item_path", "pos", "occurrence", "group_instance")


# --- E11, E15 ------------------------------------------------------------------------------

CHAIN_SQL = """
    link AS (SELECT c.event_id, c.patient_id, c.supersedes_event_id AS target, t.patient_id AS target_patient
             FROM b_chain c LEFT JOIN b_chain t ON t.event_id = c.supersedes_event_id
             WHERE c.lifecycle_status IN ('CORRECTED','VOIDED')),
    valid AS (SELECT * FROM link WHERE target IS NOT NULL AND target_patient IS NOT NULL
              AND target <> event_id AND target_patient = patient_id),
    counted AS (SELECT *, count(*) OVER (PARTITION BY target) AS n FROM valid),
    single AS (SELECT event_id, target FROM counted WHERE n = 1),
    walk(origin, node, depth) AS (
      SELECT event_id, target, 1 FROM single
      UNION ALL SELECT w.origin, s.target, w.depth + 1 FROM walk w JOIN single s ON s.event_id = w.node
      WHERE w.depth < 12),
    cyclic AS (SELECT DISTINCT origin FROM walk WHERE depth = 12),
    errors AS (
      SELECT event_id, 'INVALID_SUPERSESSION' AS reason FROM link
        WHERE event_id NOT IN (SELECT event_id FROM valid)
      UNION ALL SELECT event_id, 'AMBIGUOUS_SUPERSESSION' FROM counted WHERE n > 1
      UNION ALL SELECT origin, 'CYCLIC_SUPERSESSION' FROM cyclic),
    done AS (SELECT target FROM single WHERE event_id NOT IN (SELECT origin FROM cyclic))"""


def chain_canonical(src: Source) -> DataFrame:
    step = F.struct(
        F.col("lifecycle_status").alias("status"),
        F.col("authored_at").cast("timestamp").alias("occurred_at"),
        F.lit(0).cast("bigint").alias("source_sequence"),
        F.col("supersedes_event_id"),
    )
    return src.view("b_chain").select(
        "event_id",
        F.col("patient_id").alias("patient_pseudonym"),
        F.lit("order").alias("form_id"),
        F.lit("TOTAL").alias("item_path"),
        F.lit(None).cast("string").alias("group_instance"),
        F.lit("PRESENT").alias("state"),
        F.col("amount").alias("value"),
        F.array(step).alias("lifecycle"),
    )


@query(
    "e11_resolve_lifecycle",
    "b_chain",
    sql=f"""WITH RECURSIVE {CHAIN_SQL}
    SELECT c.event_id, CASE WHEN d.target IS NOT NULL THEN 'SUPERSEDED' ELSE 'PRESENT' END AS state,
           CASE WHEN d.target IS NULL THEN c.amount END AS value, e.reason AS lifecycle_error
    FROM b_chain c LEFT JOIN done d ON d.target = c.event_id LEFT JOIN errors e ON e.event_id = c.event_id""",
)
def e11_resolve_lifecycle(src: Source) -> DataFrame:
    resolved = lifecycle.resolve_lifecycle(chain_canonical(src))
    return resolved.select("event_id", "state", "value", "lifecycle_error")


@query(
    "e15_current_view",
    "b_chain",
    sql=f"""WITH RECURSIVE {CHAIN_SQL}
    SELECT c.patient_id, count(*) AS standing, round(sum(c.amount), 2) AS amount
    FROM b_chain c WHERE c.event_id NOT IN (SELECT target FROM done) GROUP BY c.patient_id""",
)
def e15_current_view(src: Source) -> DataFrame:
    current = canonical.current_view(lifecycle.resolve_lifecycle(chain_canonical(src)))
    return current.groupBy(F.col("patient_pseudonym").alias("patient_id")).agg(
        F.count(F.lit(1)).alias("standing"), F.round(F.sum("value"), 2).alias("amount")
    )


# --- F, G, H, K5 ---------------------------------------------------------------------------


def _entry(mapping_id: str, item: str, domain: str, concept: int, **extra) -> dict:
    row = {
        "release_id": "mapping_r1", "vocabulary_release_id": "vocab_v1", "mapping_id": mapping_id,
        "item_path": item, "establishment_id": None, "source_fingerprint": None,
        "compatibility_fingerprint": None, "declared_source_type": "string",
        "target_domain": domain, "target_concept_id": concept, "target_concept_code": f"C{concept}",
        "target_concept_name": f"Concept {concept}", "target_vocabulary_id": "LOCAL",
        "standard_concept": True, "value_map": {}, "state_map": {}, "unit_source": None,
        "unit_target": None, "unit_multiplier": None, "unit_offset": None,
        "missing_codes": [], "negative_codes": [],
    }
    return row | extra


CF = "cf-events"
EVENT_ENTRIES = [
    _entry("m-click", "click", "OBSERVATION", 2000001, compatibility_fingerprint=CF),
    _entry("m-click-a", "click", "OBSERVATION", 2000011, source_fingerprint="sf-site-a"),
    _entry(
        "m-view", "view", "MEASUREMENT", 2000002, compatibility_fingerprint=CF, unit_source="g",
        unit_target="kg", unit_multiplier=Decimal("0.001"), unit_offset=Decimal("0.5"),
    ),
    _entry("m-buy", "purchase", "OBSERVATION", 2000003, compatibility_fingerprint=CF),
    _entry(
        "m-buy-b", "purchase", "CONDITION", 2000013, establishment_id="site-b",
        source_fingerprint="sf-site-b", state_map={"UNKNOWN": "EXPLICITLY_ABSENT"},
    ),
    _entry("m-buy-d1", "purchase", "OBSERVATION", 2000023, source_fingerprint="sf-site-d"),
    _entry("m-buy-d2", "purchase", "OBSERVATION", 2000033, source_fingerprint="sf-site-d"),
    _entry(
        "m-signup", "signup", "CONDITION", 2000004, compatibility_fingerprint=CF, missing_codes=["LOW"],
    ),
    _entry("m-signup-a", "signup", "CONDITION", 0, source_fingerprint="sf-site-a", negative_codes=["LOW"]),
    _entry(
        "m-err-a", "error", "NOTE", 2000005, source_fingerprint="sf-site-a",
        value_map={"LOW": ("str", "low severity", None)},
    ),
    _entry("m-err-b", "error", "NOTE_NLP", 2000015, source_fingerprint="sf-site-b"),
    _entry("m-err-d", "error", "MEASUREMENT", 2000025, source_fingerprint="sf-site-d"),
]


def event_entries(src: Source, rows: list[dict] | None = None) -> DataFrame:
    """The mapping release used for the event answers."""
    data = [tuple(row.values()) for row in rows or EVENT_ENTRIES]
    return local_table(src.spark, data, mapping.ENTRY_SCHEMA)


def _lit(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, Decimal)) else f"'{value}'"


def entries_sql(rows: list[dict] | None = None) -> str:
    """The scalar part of the release as a VALUES list."""
    names = (
        "mapping_id item_path establishment_id source_fingerprint compatibility_fingerprint "
        "target_domain target_concept_id unit_source unit_target unit_multiplier unit_offset"
    ).split()
    body = ",\n".join("(" + ",".join(_lit(r[n]) for n in names) + ")" for r in rows or EVENT_ENTRIES)
    return f"entries({', '.join(names)}) AS (VALUES {body})"


def decided_sql(entries: str | None = None) -> str:
    """CTEs from canonical answers to decisions (``decided``)."""
    return f"""
    {entries or entries_sql()},
    canon AS (SELECT *, {EVENT_ID_SQL} AS event_id, {STATE_SQL.format(enabled='true')} AS state,
                     'sf-' || establishment_id AS source_fp FROM b_answers),
    cand AS (
      SELECT c.event_id, e.mapping_id,
             CASE WHEN e.establishment_id IS NOT NULL THEN 1 WHEN e.source_fingerprint = c.source_fp THEN 2 ELSE 3 END AS lvl
      FROM canon c JOIN entries e ON e.item_path = c.item_path AND (
        (e.establishment_id = c.establishment_id AND e.source_fingerprint = c.source_fp)
        OR (e.establishment_id IS NULL AND (e.source_fingerprint = c.source_fp OR e.compatibility_fingerprint = 'cf-events')))),
    best AS (SELECT *, min(lvl) OVER (PARTITION BY event_id) AS top FROM cand),
    pick AS (SELECT event_id, min(lvl) AS lvl, count(*) AS n, min(mapping_id) AS mapping_id
             FROM best WHERE lvl = top GROUP BY event_id),
    resolved AS (
      SELECT c.*, p.lvl, CASE WHEN p.n IS NULL THEN 'UNKNOWN_MAPPING' WHEN p.n > 1 THEN 'AMBIGUOUS_MAPPING'
               ELSE 'RESOLVED' END AS resolution, e.* EXCLUDE (item_path, establishment_id)
      FROM canon c LEFT JOIN pick p ON p.event_id = c.event_id
      LEFT JOIN entries e ON p.n = 1 AND e.mapping_id = p.mapping_id),
    routed AS (
      SELECT *, CASE WHEN mapping_id IS NULL OR state <> 'PRESENT' THEN NULL
          WHEN mapping_id = 'm-signup' AND trim(raw_value) = 'LOW' THEN 'MISSING'
          WHEN mapping_id = 'm-signup-a' AND trim(raw_value) = 'LOW' THEN 'NEGATIVE'
          WHEN mapping_id = 'm-err-a' THEN CASE WHEN trim(raw_value) = 'LOW' THEN 'MAPPED' ELSE 'UNMAPPED' END
          ELSE 'KEPT' END AS outcome FROM resolved),
    stated AS (
      SELECT *, CASE outcome WHEN 'MISSING' THEN 'UNKNOWN' WHEN 'NEGATIVE' THEN 'EXPLICITLY_ABSENT'
          ELSE CASE WHEN mapping_id = 'm-buy-b' AND state = 'UNKNOWN' THEN 'EXPLICITLY_ABSENT' ELSE state END END AS cstate,
        CAST(TRY_CAST(trim(raw_value) AS DECIMAL(20,9)) AS DECIMAL(38,9)) AS num FROM routed),
    failed AS (
      SELECT *, CASE WHEN mapping_id IS NULL THEN resolution WHEN outcome = 'UNMAPPED' THEN 'UNKNOWN_LOCAL_VALUE'
          WHEN outcome IS NOT NULL AND cstate = 'PRESENT' AND unit_source IS NOT NULL
            AND (unit IS DISTINCT FROM unit_source OR num IS NULL) THEN 'INVALID_UNIT' END AS failure FROM stated),
    std AS (
      SELECT *, CASE WHEN failure IS NULL THEN {sql_uuid("clinical-event", "event_id", "'mapping_r1'", "mapping_id")} END AS clinical_event_id,
        CASE WHEN failure IS NULL THEN cstate END AS clinical_state,
        CASE WHEN failure IS NULL AND cstate = 'PRESENT' AND unit_source IS NOT NULL
             THEN CAST(num * 0.001 + 0.5 AS DECIMAL(38,9)) END AS number,
        CASE WHEN failure IS NULL AND cstate = 'PRESENT' AND unit_source IS NULL
             THEN CASE WHEN outcome = 'MAPPED' THEN 'low severity' ELSE raw_value END END AS text,
        CASE WHEN failure IS NULL AND cstate = 'PRESENT' THEN coalesce(unit_target, unit) END AS clinical_unit FROM failed),
    decided AS (
      SELECT *, CASE WHEN clinical_event_id IS NULL AND state NOT IN ('NOT_RECORDED','NOT_APPLICABLE','VOIDED','DELETED')
                     THEN failure END AS f2,
        CASE WHEN state IN ('VOIDED','DELETED') THEN 'CLINICAL_INCONSISTENCY' END AS f3,
        CASE WHEN clinical_event_id IS NOT NULL AND target_concept_id <= 0 THEN 'OMOP_CONFORMANCE_FAILURE' END AS f4,
        CASE WHEN state IN ('NOT_RECORDED','NOT_APPLICABLE','VOIDED','DELETED') THEN 'OMIT'
             WHEN f2 IS NOT NULL OR f3 IS NOT NULL OR f4 IS NOT NULL THEN 'QUARANTINE' ELSE 'PUBLISH' END AS decision
      FROM std)"""


def event_decisions(src: Source, rows: list[dict] | None = None) -> DataFrame:
    # Judging is most of the work on an answer, and the events may be a file of few pieces.
    return quality.judge(event_canonical(src.dealt(src.view("b_answers"))), event_entries(src, rows))


def stored_decisions(src: Source) -> DataFrame:
    """Decisions as the stage table that quarantine, facts and lineage are read from."""
    return cut(event_decisions(src).drop("props", "raw_value"), "decisions")


@query(
    "f1_resolve_mappings",
    "b_answers",
    sql=f"WITH {decided_sql()} SELECT event_id, mapping_id, lvl AS resolution_level, resolution FROM resolved",
)
def f1_resolve_mappings(src: Source) -> DataFrame:
    return mapping.resolve(eav_canonical(src), event_entries(src)).select(
        "event_id", F.col("mapping.mapping_id").alias("mapping_id"), "resolution_level", "resolution"
    )


@query(
    "g1_normalize_source_value",
    "b_answers",
    sql="""SELECT response_id, CASE WHEN CAST(response_id AS BIGINT) % 2 = 0
             THEN CASE WHEN enabled THEN 'true' ELSE 'false' END ELSE trim(raw_value) END AS normalized
           FROM b_answers""",
)
def g1_normalize_source_value(src: Source) -> DataFrame:
    odd = F.col("response_id").cast("bigint") % 2
    value = F.when(
        odd == 0, F.struct(F.lit("bool").alias("t"), F.initcap(F.col("enabled").cast("string")).alias("s"))
    ).otherwise(F.struct(F.lit("str").alias("t"), F.col("raw_value").alias("s")))
    rows = src.view("b_answers").withColumn("value", value)
    return rows.select("response_id", standardize.normalized_source(F.col("value")).alias("normalized"))


@query(
    "g2_route_value",
    "b_answers",
    sql=f"""WITH {decided_sql()} SELECT event_id, outcome, CASE WHEN outcome IN ('MAPPED','KEPT') THEN
        CASE WHEN outcome = 'MAPPED' THEN 'low severity' ELSE raw_value END END AS routed_value FROM routed""",
)
def g2_route_value(src: Source) -> DataFrame:
    resolved = mapping.resolve(eav_canonical(src), event_entries(src))
    outcome, routed = standardize.route_value(F.col("value"), F.col("mapping"))
    open_answer = (F.col("state") == "PRESENT") & F.col("mapping").isNotNull()
    rows = resolved.withColumn("outcome", F.when(open_answer, outcome))
    return rows.select(
        "event_id",
        "outcome",
        F.when(F.col("outcome").isin("MAPPED", "KEPT"), routed["s"]).alias("routed_value"),
    )


@query(
    "g3_convert_unit",
    "b_answers",
    sql="""SELECT response_id, CAST(CAST(CAST(TRY_CAST(trim(raw_value) AS DECIMAL(20,9)) AS DECIMAL(38,9)) * 1.8 + 32
             AS DECIMAL(38,9)) AS DOUBLE) AS converted FROM b_answers""",
)
def g3_convert_unit(src: Source) -> DataFrame:
    value = F.struct(
        F.lit("str").alias("t"), F.col("raw_value").alias("s"), F.lit(None).cast(NUM).alias("num")
    )
    rows = src.view("b_answers").withColumn("value", value)
    converted = standardize.convert_unit(
        F.col("value"), F.lit(Decimal("1.8")), F.lit(Decimal("32"))
    )
    return rows.select("response_id", converted["num"].cast("double").alias("converted"))


@query(
    "g3_small_multiplier",
    sql="""SELECT l_orderkey, l_linenumber, CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.0000000001 AS DECIMAL(12,10)) + CAST(0.000000000001 AS DECIMAL(14,12))
      AS DECIMAL(38,12)) AS VARCHAR) AS converted FROM lineitem""",
)
def g3_small_multiplier(src: Source) -> DataFrame:
    """Prices by a multiplier and an offset beyond nine decimals; the text of the scalar is exact."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    value = F.struct(F.lit("num").alias("t"), price.cast("string").alias("s"), price.cast(NUM).alias("num"))
    converted = standardize.convert_unit(value, F.lit("0.0000000001"), F.lit("0.000000000001"))
    exactly = converted["s"].cast("decimal(38,12)").cast("string")
    return src.table("lineitem").select("l_orderkey", "l_linenumber", exactly.alias("converted"))


@query(
    "g4_map_state",
    "b_answers",
    sql=f"""WITH {decided_sql()} SELECT state, item_path, establishment_id,
        CASE WHEN mapping_id = 'm-buy-b' AND state = 'UNKNOWN' THEN 'EXPLICITLY_ABSENT' ELSE state END AS mapped_state,
        count(*) AS answers FROM resolved GROUP BY 1, 2, 3, 4""",
)
def g4_map_state(src: Source) -> DataFrame:
    resolved = mapping.resolve(eav_canonical(src), event_entries(src))
    mapped = standardize.map_state(F.col("state"), F.col("mapping"))
    return resolved.groupBy("state", "item_path", "establishment_id", mapped.alias("mapped_state")).agg(
        F.count(F.lit(1)).alias("answers")
    )


@query(
    "g5_standardize",
    "b_answers",
    sql=f"""WITH {decided_sql()} SELECT event_id, clinical_event_id, clinical_state,
        CAST(number AS DOUBLE) AS number, text, clinical_unit, failure FROM std""",
)
def g5_standardize(src: Source) -> DataFrame:
    rows = standardize.standardize(mapping.resolve(eav_canonical(src), event_entries(src)))
    value = F.col("clinical_value")
    return rows.select(
        "event_id", "clinical_event_id", "clinical_state",
        value["num"].cast("double").alias("number"),
        F.when(value["t"] == "str", value["s"]).alias("text"),
        "clinical_unit", "failure",
    )


@query(
    "h1_quality_results",
    "b_answers",
    sql=f"""WITH {decided_sql()}, long AS (
      SELECT event_id, 'provenance.evidence-present' AS rule_id, true AS passed, CAST(NULL AS VARCHAR) AS reason FROM decided
      UNION ALL SELECT event_id, 'mapping.resolved', f2 IS NULL, f2 FROM decided
      UNION ALL SELECT event_id, 'lifecycle.publishable', f3 IS NULL, f3 FROM decided
      UNION ALL SELECT event_id, 'omop.standard-concept', f4 IS NULL, f4 FROM decided WHERE clinical_event_id IS NOT NULL)
    SELECT {sql_uuid("quality-result", "event_id", "rule_id", "'1.0.0'")} AS result_id, event_id, rule_id, passed,
           CASE WHEN passed THEN 'INFO' ELSE 'ERROR' END AS severity, reason FROM long""",
)
def h1_quality_results(src: Source) -> DataFrame:
    return quality.quality_results(event_decisions(src)).select(
        "result_id", "event_id", "rule_id", "passed", "severity", "reason"
    )


@query(
    "h2_decide",
    "b_answers",
    sql=f"""WITH {decided_sql()} SELECT event_id, state, decision, concat_ws(',', f2, f3, f4) AS failures FROM decided""",
)
def h2_decide(src: Source) -> DataFrame:
    return event_decisions(src).select(
        "event_id", "state", "decision", F.concat_ws(",", "failures").alias("failures")
    )


QUARANTINE_SQL = f"""records AS (SELECT {sql_uuid("quarantine", "event_id")} AS quarantine_id, event_id, establishment_id,
    item_path, coalesce(f2, f3, f4) AS reason, 'OPEN' AS status, 'raw/events/' || response_id AS evidence_object_key,
    authored_at AS created_at FROM decided WHERE decision = 'QUARANTINE')"""


def event_quarantine(src: Source) -> DataFrame:
    return quality.quarantine_records(stored_decisions(src), F.col("authored_at"))


@query(
    "h3_quarantine_records",
    "b_answers",
    sql=f"""WITH {decided_sql()}, {QUARANTINE_SQL}
    SELECT quarantine_id, event_id, establishment_id, item_path, reason, status, evidence_object_key FROM records""",
)
def h3_quarantine_records(src: Source) -> DataFrame:
    return event_quarantine(src).select(
        "quarantine_id", "event_id", "establishment_id", "item_path", "reason", "status", "evidence_object_key"
    )


@query(
    "h4_quarantine_summary",
    "b_answers",
    sql=f"""WITH {decided_sql()}, {QUARANTINE_SQL}
    SELECT reason, status, count(*) AS records, count(DISTINCT item_path) AS item_paths, max(created_at) AS newest
    FROM records GROUP BY reason, status""",
)
def h4_quarantine_summary(src: Source) -> DataFrame:
    return quality.quarantine_summary(event_quarantine(src))


@query(
    "h4_open_quarantine",
    "b_answers",
    sql=f"""WITH {decided_sql()}, {QUARANTINE_SQL}
    SELECT quarantine_id, reason, created_at FROM records WHERE status = 'OPEN'
    ORDER BY created_at DESC, quarantine_id""",
)
def h4_open_quarantine(src: Source) -> DataFrame:
    return quality.open_quarantine(event_quarantine(src)).select("quarantine_id", "reason", "created_at")


# The release that answers the quarantine: one entry for the site that had none, one of the two
# rival entries withdrawn.
REPLAY_ENTRIES = [row for row in EVENT_ENTRIES if row["mapping_id"] != "m-buy-d2"] + [
    _entry("m-err-c", "error", "OBSERVATION", 2000035, source_fingerprint="sf-site-c")
]


@query(
    "h5_replay_quarantine",
    "b_answers",
    sql=f"""WITH first_pass AS (WITH {decided_sql()} SELECT event_id, decision FROM decided),
    second_pass AS (WITH {decided_sql(entries_sql(REPLAY_ENTRIES))} SELECT event_id, decision FROM decided)
    SELECT f.event_id, CASE WHEN s.decision = 'QUARANTINE' THEN 'OPEN' ELSE 'RESOLVED' END AS status,
           s.decision AS replayed_decision
    FROM first_pass f JOIN second_pass s USING (event_id) WHERE f.decision = 'QUARANTINE'""",
)
def h5_replay_quarantine(src: Source) -> DataFrame:
    # Dealt, as the events may be a file of few pieces and are judged a second time.
    rows = event_canonical(src.dealt(src.view("b_answers")))
    records = quality.quarantine_records(stored_decisions(src), F.col("authored_at"))
    again, after = quality.replay_quarantine(rows, records, event_entries(src, REPLAY_ENTRIES))
    return after.join(again.select("event_id", F.col("decision").alias("replayed_decision")), "event_id").select(
        "event_id", "status", "replayed_decision"
    )


@query(
    "k5_batch_summary",
    "b_answers",
    sql=f"""WITH {decided_sql()}
    SELECT establishment_id, item_path, state, decision, count(*) AS answers
    FROM decided GROUP BY ROLLUP (establishment_id, item_path, state, decision)""",
)
def k5_batch_summary(src: Source) -> DataFrame:
    return batch_summary(event_decisions(src), ["establishment_id", "item_path", "state", "decision"])


# --- F2 to F7 ------------------------------------------------------------------------------

def part_entries(src: Source) -> DataFrame:
    """One mapping entry per part; its brand is the release, its size the concept."""
    key = F.col("p_partkey")
    return src.table("part").select(
        F.col("p_brand").alias("release_id"),
        F.concat(F.lit("m"), (key % 900).cast("string")).alias("mapping_id"),
        F.when(key % 3 == 0, F.concat(F.lit("sf-"), F.col("p_type"))).alias("source_fingerprint"),
        F.when(key % 4 == 0, F.concat(F.lit("cf-"), F.col("p_size").cast("string"))).alias(
            "compatibility_fingerprint"
        ),
        (F.col("p_size") - 2).cast("bigint").alias("target_concept_id"),
    )


PART_ENTRY_SQL = """e AS (SELECT p_brand AS release_id, 'm' || (p_partkey % 900) AS mapping_id,
    CASE WHEN p_partkey % 3 = 0 THEN 'sf-' || p_type END AS source_fingerprint,
    CASE WHEN p_partkey % 4 = 0 THEN 'cf-' || p_size END AS compatibility_fingerprint,
    CAST(p_size - 2 AS BIGINT) AS target_concept_id FROM part),
    r AS (SELECT p_brand AS release_id, 'a' || (min(p_size) % 2) AS authored_by, 'a' || (max(p_size) % 2) AS approved_by,
    TIMESTAMP '2024-01-01' + to_days(CAST(count(*) AS INT)) AS approved_at FROM part GROUP BY p_brand)"""


def part_releases(src: Source) -> DataFrame:
    people = [
        F.concat(F.lit("a"), (agg("p_size") % 2).cast("string")).alias(name)
        for agg, name in ((F.min, "authored_by"), (F.max, "approved_by"))
    ]
    day = F.count(F.lit(1)).cast("int")
    return src.table("part").groupBy(F.col("p_brand").alias("release_id")).agg(
        *people, F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("approved_at")
    )


@query(
    "f2_validate_releases",
    sql=f"""WITH {PART_ENTRY_SQL}, v AS (SELECT DISTINCT p_brand AS release_id, 'm' || (p_partkey % 900) AS mapping_id
      FROM part WHERE p_retailprice < 1400)
    SELECT release_id, NULL AS mapping_id, 'MAKER_CHECKER' AS violation FROM r WHERE authored_by = approved_by
    UNION ALL SELECT release_id, mapping_id, 'FINGERPRINT_REQUIRED' FROM e
      WHERE source_fingerprint IS NULL AND compatibility_fingerprint IS NULL
    UNION ALL SELECT release_id, mapping_id, 'CONCEPT_ID_RANGE' FROM e WHERE target_concept_id <= 0
    UNION ALL SELECT release_id, mapping_id, 'DUPLICATE_MAPPING_ID' FROM e GROUP BY 1, 2 HAVING count(*) > 1
    UNION ALL SELECT DISTINCT release_id, mapping_id, 'VECTOR_REQUIRED' FROM e
      WHERE (release_id, mapping_id) NOT IN (SELECT (release_id, mapping_id) FROM v)""",
)
def f2_validate_releases(src: Source) -> DataFrame:
    tested = src.table("part").filter("p_retailprice < 1400").select(
        F.col("p_brand").alias("release_id"),
        F.concat(F.lit("m"), (F.col("p_partkey") % 900).cast("string")).alias("mapping_id"),
    )
    return mapping.release_violations(part_releases(src), part_entries(src), tested)


@query(
    "f3_run_mapping_vectors",
    "b_answers",
    sql="""
    WITH v AS (SELECT response_id, trim(raw_value) AS code, unit, state, item FROM (
        SELECT response_id, raw_value, unit,
               CASE WHEN raw_value IS NULL THEN 'NOT_RECORDED' WHEN lower(trim(raw_value)) = 'inconnu' THEN 'UNKNOWN' ELSE 'PRESENT' END AS state,
               CASE item_path WHEN 'view' THEN 'view' WHEN 'signup' THEN 'signup' WHEN 'error' THEN 'error' ELSE 'purchase' END AS item
        FROM b_answers)),
    s AS (SELECT *, CASE WHEN item = 'purchase' AND state = 'UNKNOWN' THEN 'EXPLICITLY_ABSENT' ELSE state END AS st FROM v),
    o AS (SELECT *, st = 'PRESENT' AS open_answer, CASE WHEN st = 'PRESENT' AND item = 'signup' AND code = 'LOW' THEN 'UNKNOWN' ELSE st END AS observed_state FROM s),
    x AS (SELECT response_id, observed_state,
        CASE WHEN observed_state = 'PRESENT' AND item = 'view' AND unit = 'g'
             THEN CAST(CAST(TRY_CAST(code AS DECIMAL(20,9)) AS DECIMAL(38,9)) * 0.001 + 0.5 AS DOUBLE) END AS number,
        CASE WHEN observed_state <> 'PRESENT' OR item = 'view' THEN NULL
             WHEN item = 'error' THEN CASE WHEN code = 'LOW' THEN 'low severity' END ELSE code END AS text,
        CASE WHEN observed_state <> 'PRESENT' THEN NULL WHEN item = 'view' AND unit = 'g' THEN 'kg' ELSE unit END AS observed_unit,
        code, unit FROM o)
    SELECT response_id, observed_state, number, text, observed_unit,
           observed_state = 'PRESENT' AND number IS NULL AND text IS NOT DISTINCT FROM code
             AND observed_unit IS NOT DISTINCT FROM unit AS passed FROM x""",
)
def f3_run_mapping_vectors(src: Source) -> DataFrame:
    wanted = {"view": "m-view", "signup": "m-signup", "error": "m-err-a"}
    path = F.col("item_path")
    mapping_id = F.coalesce(*[F.when(path == k, F.lit(v)) for k, v in wanted.items()], F.lit("m-buy-b"))
    raw = F.col("raw_value")
    text = F.when(
        raw.isNotNull(),
        F.struct(F.lit("str").alias("t"), F.trim(raw).alias("s"), F.lit(None).cast(NUM).alias("num")),
    )
    vectors = src.view("b_answers").select(
        F.lit("mapping_r1").alias("release_id"),
        mapping_id.alias("mapping_id"),
        F.col("response_id").alias("name"),
        F.when(raw.isNull(), "NOT_RECORDED")
        .when(F.lower(F.trim(raw)) == "inconnu", "UNKNOWN")
        .otherwise("PRESENT")
        .alias("source_state"),
        text.alias("source_value"),
        F.col("unit").alias("source_unit"),
        F.lit("PRESENT").alias("expected_state"),
        text.alias("expected_value"),
        F.col("unit").alias("expected_unit"),
    )
    tested = mapping.run_vectors(vectors, event_entries(src))
    value = F.col("observed_value")
    return tested.select(
        F.col("name").alias("response_id"), "observed_state",
        F.when(value["t"] == "num", value["num"].cast("double")).alias("number"),
        F.when(value["t"] == "str", value["s"]).alias("text"),
        "observed_unit", "passed",
    )


def part_row_hash() -> Column:
    return F.sha2(
        F.concat_ws(
            "|", "mapping_id", F.coalesce("source_fingerprint", F.lit("-")),
            F.coalesce("compatibility_fingerprint", F.lit("-")), F.col("target_concept_id").cast("string"),
        ),
        256,
    )


def _release_sql() -> str:
    from formloom.plans.sqltext import sql_bag

    row = """sha256(mapping_id || '|' || coalesce(source_fingerprint, '-') || '|' ||
        coalesce(compatibility_fingerprint, '-') || '|' || target_concept_id)"""
    return f"""WITH {PART_ENTRY_SQL}, bag AS (SELECT release_id, {sql_bag('h')} AS bag FROM
        (SELECT release_id, {row} AS h FROM e) GROUP BY release_id),
    c AS (SELECT r.release_id, sha256('{{"approved_at":"' || strftime(approved_at, '%Y-%m-%dT%H:%M:%SZ') ||
        '","approved_by":"' || approved_by || '","authored_by":"' || authored_by || '","entries":"' || bag ||
        '","parent_release_id":null,"schema_version":"1.0","vocabulary_release_id":"vocab_v1"}}') AS checksum
        FROM r JOIN bag USING (release_id))"""


def checked_releases(src: Source) -> DataFrame:
    return part_releases(src).withColumns(
        {"parent_release_id": F.lit(None).cast("string"), "vocabulary_release_id": F.lit("vocab_v1")}
    )


@query(
    "f4_verify_release_checksum",
    sql=_release_sql() + """
    SELECT release_id, checksum AS computed_checksum, length(release_id) % 2 = 0 AS verified FROM c""",
)
def f4_verify_release_checksum(src: Source) -> DataFrame:
    releases, entries = checked_releases(src), part_entries(src)
    stored = mapping.release_checksum(releases, entries, part_row_hash()).select(
        "release_id",
        F.when(F.length("release_id") % 2 == 0, F.col("computed_checksum")).otherwise(F.lit("tampered")).alias(
            "payload_checksum_sha256"
        ),
    )
    return mapping.verify_release_checksum(
        releases.join(stored, "release_id"), entries, part_row_hash()
    ).select("release_id", "computed_checksum", "verified")


@query(
    "f5_release_identity",
    sql=_release_sql() + "SELECT release_id, 'mapping_' || substr(checksum, 1, 16) AS content_release_id FROM c",
)
def f5_release_identity(src: Source) -> DataFrame:
    return mapping.release_identity(checked_releases(src), part_entries(src), part_row_hash()).select(
        "release_id", "content_release_id"
    )


def asking_forms(src: Source) -> DataFrame:
    """One form per order; finished orders name the release they want."""
    kind = F.col("o_custkey") % 7
    family = F.when(kind == 0, "ECONOMY").when(kind == 1, "PROMO").when(kind == 2, "STANDARD").otherwise("none")
    brand = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string"))
    return src.table("orders").select(
        F.col("o_orderkey").alias("form_id"),
        F.concat(F.lit("sf-"), family).alias("source_fingerprint"),
        F.concat(F.lit("cf-"), (F.col("o_custkey") % 60).cast("string")).alias("compatibility_fingerprint"),
        F.when(F.col("o_orderstatus") == "F", brand).alias("requested_release_id"),
    )


@query(
    "f6_select_release",
    sql=f"""WITH {PART_ENTRY_SQL},
    f AS (SELECT o_orderkey AS form_id, 'sf-' || CASE o_custkey % 7 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO'
            WHEN 2 THEN 'STANDARD' ELSE 'none' END AS sf, 'cf-' || (o_custkey % 60) AS cf,
          CASE WHEN o_orderstatus = 'F' THEN 'Brand#' || (o_custkey % 25 + 1) END AS asked FROM orders),
    s AS (SELECT e.source_fingerprint AS sf, max(r.approved_at) AS t, max_by(r.release_id, (r.approved_at, r.release_id)) AS id
          FROM e JOIN r USING (release_id) WHERE e.source_fingerprint IS NOT NULL GROUP BY 1),
    c AS (SELECT e.compatibility_fingerprint AS cf, max(r.approved_at) AS t, max_by(r.release_id, (r.approved_at, r.release_id)) AS id
          FROM e JOIN r USING (release_id) WHERE e.compatibility_fingerprint IS NOT NULL GROUP BY 1)
    SELECT f.form_id, CASE WHEN asked IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.release_id = asked
        AND (e.source_fingerprint = f.sf OR e.compatibility_fingerprint = f.cf)) THEN asked END
      WHEN s.id IS NULL THEN c.id WHEN c.id IS NULL THEN s.id
      WHEN (s.t, s.id) > (c.t, c.id) THEN s.id ELSE c.id END AS selected_release_id
    FROM f LEFT JOIN s ON s.sf = f.sf LEFT JOIN c ON c.cf = f.cf""",
)
def f6_select_release(src: Source) -> DataFrame:
    return mapping.select_release(asking_forms(src), part_releases(src), part_entries(src)).select(
        "form_id", "selected_release_id"
    )


@query(
    "f6_select_verified",
    sql=f"""WITH {PART_ENTRY_SQL},
    ok AS (SELECT * FROM r WHERE length(release_id) % 2 = 0),
    f AS (SELECT o_orderkey AS form_id, 'sf-' || CASE o_custkey % 7 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO'
            WHEN 2 THEN 'STANDARD' ELSE 'none' END AS sf, 'cf-' || (o_custkey % 60) AS cf,
          CASE WHEN o_orderstatus = 'F' THEN 'Brand#' || (o_custkey % 25 + 1) END AS asked FROM orders),
    s AS (SELECT e.source_fingerprint AS sf, max(ok.approved_at) AS t, max_by(release_id, (ok.approved_at, release_id)) AS id
          FROM e JOIN ok USING (release_id) WHERE e.source_fingerprint IS NOT NULL GROUP BY 1),
    c AS (SELECT e.compatibility_fingerprint AS cf, max(ok.approved_at) AS t, max_by(release_id, (ok.approved_at, release_id)) AS id
          FROM e JOIN ok USING (release_id) WHERE e.compatibility_fingerprint IS NOT NULL GROUP BY 1)
    SELECT f.form_id, CASE WHEN asked IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM e JOIN ok USING (release_id) WHERE e.release_id = asked
        AND (e.source_fingerprint = f.sf OR e.compatibility_fingerprint = f.cf)) THEN asked END
      WHEN s.id IS NULL THEN c.id WHEN c.id IS NULL THEN s.id
      WHEN (s.t, s.id) > (c.t, c.id) THEN s.id ELSE c.id END AS selected_release_id
    FROM f LEFT JOIN s ON s.sf = f.sf LEFT JOIN c ON c.cf = f.cf""",
)
def f6_select_verified(src: Source) -> DataFrame:
    """Releases whose stored checksum is not that of their content are refused."""
    releases, entries = checked_releases(src), part_entries(src)
    own = mapping.release_checksum(releases, entries, part_row_hash()).select("release_id", "computed_checksum")
    kept = F.when(F.length("release_id") % 2 == 0, F.col("computed_checksum")).otherwise(F.lit("tampered"))
    stored = releases.join(own.select("release_id", kept.alias("payload_checksum_sha256")), "release_id")
    verified = mapping.verify_release_checksum(stored, entries, part_row_hash())
    sound = part_releases(src).join(verified.select("release_id", "verified"), "release_id")
    return mapping.select_release(asking_forms(src), sound, entries).select("form_id", "selected_release_id")


@query(
    "f7_draft_queue",
    "b_forms",
    sql="""WITH d AS (SELECT o_orderkey AS draft_id, 'form-Brand#' || (o_custkey % 30) AS form_id,
        CAST(o_orderkey % 3 AS VARCHAR) AS form_version, o_orderdate AS created_at FROM orders),
    f AS (SELECT DISTINCT form_id, version, form_family FROM b_forms)
    SELECT draft_id, d.form_id, d.form_version, form_family, created_at FROM d
    JOIN f ON f.form_id = d.form_id AND f.version = d.form_version ORDER BY created_at DESC, draft_id""",
)
def f7_draft_queue(src: Source) -> DataFrame:
    drafts = src.table("orders").select(
        F.col("o_orderkey").alias("draft_id"),
        F.concat(F.lit("form-Brand#"), (F.col("o_custkey") % 30).cast("string")).alias("form_id"),
        (F.col("o_orderkey") % 3).cast("string").alias("form_version"),
        F.col("o_orderdate").alias("created_at"),
    )
    known = src.view("b_forms").select("form_id", F.col("version").alias("form_version"), "form_family").distinct()
    return mapping.draft_queue(drafts, known).select(
        "draft_id", "form_id", "form_version", "form_family", "created_at"
    )
