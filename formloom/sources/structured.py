"""Versioned JSON and XML form documents as item and answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.functions.answers import DATA_TYPES, LIFECYCLE, OPERATORS
from formloom.sources.fhir import CONDITION, OPTION, _tagged
from formloom.sources.nesting import json_levels, levels_of, xml_levels
from formloom.session import cut

SCHEMA_VERSION = "structured/1.0"
DEFINITION_TAG, RESPONSE_TAG = "form-definition", "form-response"
_ZONED = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def _contract_error(authored: Column, status: Column, prior: Column, response_id: Column, sequence: Column) -> Column:
    needs_prior = status.isin("CORRECTED", "VOIDED") & (F.coalesce(prior, F.lit("")) == "")
    return (
        F.when(F.coalesce(response_id, F.lit("")) == "", "INVALID_STRUCTURED_RESPONSE")
        .when(~F.coalesce(authored.rlike(_ZONED), F.lit(False)) | authored.try_cast("timestamp").isNull(), "INVALID_STRUCTURED_RESPONSE")
        .when(~status.isin(*LIFECYCLE) | needs_prior | (sequence < 0), "INVALID_STRUCTURED_RESPONSE")
    )


def _heads(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select(
        *keep,
        "object_key",
        "checksum",
        "media_type",
        F.col("authored").cast("timestamp").alias("authored_at"),
        F.substring("authored", 1, 10).cast("date").alias("authored_date"),
        "lifecycle_status",
        "source_sequence",
        "supersedes_response_id",
    )


def read_json_responses(documents: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(responses, answers, errors)`` of JSON response documents.

    ``documents``: ``object_key, content`` and the columns in ``keep`` (site, patient, form). The
    schema version is pinned, the time needs an offset, corrections need the prior response.
    Answers carry ``raw_type``, ``raw_value``, ``pos`` and their JSON pointer.
    """
    answer = "struct<item_path:string,value:variant,unit:string,group_instance:string,enabled:boolean>"
    schema = (
        "schema_version string, response_id string, authored_at string, lifecycle_status string, "
        f"source_sequence bigint, supersedes_response_id string, answers array<{answer}>, _corrupt string"
    )
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    parsed = documents.withColumn("doc", F.from_json("content", schema, options)).withColumn("checksum", F.sha2("content", 256))
    rows = parsed.select(
        *keep,
        "object_key",
        "checksum",
        F.lit("application/json").alias("media_type"),
        F.col("doc.response_id").alias("response_id"),
        F.col("doc.authored_at").alias("authored"),
        F.coalesce("doc.lifecycle_status", F.lit("SIGNED")).alias("lifecycle_status"),
        F.coalesce("doc.source_sequence", F.lit(0)).alias("source_sequence"),
        F.col("doc.supersedes_response_id").alias("supersedes_response_id"),
        F.col("doc.answers").alias("answers"),
        F.when(F.col("doc").isNull() | F.col("doc._corrupt").isNotNull(), "INVALID_STRUCTURED_JSON")
        .when(~F.coalesce(F.col("doc.schema_version") == SCHEMA_VERSION, F.lit(False)), "UNSUPPORTED_STRUCTURED_SCHEMA")
        .when(F.col("doc.answers").isNull(), "INVALID_STRUCTURED_RESPONSE")
        .alias("_shape"),
    )
    checked = rows.withColumn("error", F.coalesce("_shape", _contract(rows)))
    good = checked.filter("error IS NULL")
    heads = [*keep, "response_id"]
    exploded = good.select(*heads, F.posexplode("answers").alias("pos", "a"))
    value = _tagged(F.col("a.value"))
    kind = F.schema_of_variant("a.value")
    answers = exploded.select(
        *heads,
        F.col("a.item_path").alias("item_path"),
        F.col("a.group_instance").alias("group_instance"),
        F.when(F.col("a.value").isNotNull() & (kind != "VOID"), F.coalesce(value["t"], F.lit("other"))).alias("raw_type"),
        F.when(kind != "VOID", F.coalesce(value["s"], F.to_json("a.value"))).alias("raw_value"),
        F.col("a.unit").alias("unit"),
        F.col("a.enabled").alias("declared_enabled"),
        "pos",
        F.concat(F.lit("/answers/"), F.col("pos").cast("string")).alias("locator"),
    )
    errors = checked.filter("error IS NOT NULL").select("object_key", "error")
    return _heads(good, heads), answers, errors


def _contract(rows: DataFrame) -> Column:
    return _contract_error(
        F.col("authored"), F.col("lifecycle_status"), F.col("supersedes_response_id"), F.col("response_id"), F.col("source_sequence")
    )


def _attributes(names: list[str]) -> list[T.StructField]:
    return [T.StructField(f"_{n}", T.StringType()) for n in names]


def root_tag(xml: Column) -> Column:
    """Name of the document element."""
    return F.regexp_extract(xml, r"(?s)^\s*(?:<\?xml.*?\?>)?\s*(?:<!--.*?-->\s*)*<([A-Za-z_][\w.-]*)", 1)


def _parse_xml(documents: DataFrame, schema: T.StructType, tag: str) -> DataFrame:
    """Adds ``doc``, ``checksum`` and ``_shape``; documents with entities are refused unread."""
    schema = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    unsafe = F.col("content").rlike(r"(?i)<!ENTITY")
    text = F.when(~unsafe, F.col("content"))
    parsed = documents.withColumn(
        "doc", F.from_xml(text, schema.toDDL(), {"columnNameOfCorruptRecord": "_corrupt", "attributePrefix": "_"})
    ).withColumn("checksum", F.sha2("content", 256))
    version = F.coalesce(F.col("doc.`_schema-version`") == SCHEMA_VERSION, F.lit(False))
    shape = (
        F.when(unsafe | F.col("doc").isNull() | F.col("doc._corrupt").isNotNull(), "INVALID_STRUCTURED_XML")
        .when((root_tag(F.col("content")) != tag) | ~version, "UNSUPPORTED_STRUCTURED_SCHEMA")
    )
    return parsed.withColumn("_shape", shape)


def read_xml_responses(documents: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(responses, answers, errors)`` of XML response documents; locators count from 1."""
    answer = T.StructType(
        [*_attributes(["item-path", "unit", "group-instance", "enabled"]), T.StructField("value", T.StringType())]
    )
    schema = T.StructType(
        [
            *_attributes(["schema-version", "response-id", "authored-at", "lifecycle-status", "source-sequence", "supersedes-response-id"]),
            T.StructField("answer", T.ArrayType(answer)),
        ]
    )
    parsed = _parse_xml(documents, schema, RESPONSE_TAG)
    attribute = {n: F.col(f"doc.`_{n}`") for n in ("response-id", "authored-at", "lifecycle-status", "source-sequence", "supersedes-response-id")}
    rows = parsed.select(
        *keep,
        "object_key",
        "checksum",
        F.lit("application/xml").alias("media_type"),
        attribute["response-id"].alias("response_id"),
        attribute["authored-at"].alias("authored"),
        F.coalesce(attribute["lifecycle-status"], F.lit("SIGNED")).alias("lifecycle_status"),
        F.coalesce(attribute["source-sequence"], F.lit("0")).try_cast("bigint").alias("source_sequence"),
        attribute["supersedes-response-id"].alias("supersedes_response_id"),
        F.coalesce("doc.answer", F.array().cast(T.ArrayType(answer))).alias("answers"),
        "_shape",
    )
    blank = F.exists("answers", lambda a: F.trim(F.coalesce(a["_item-path"], F.lit(""))) == "")
    odd = F.exists("answers", lambda a: a["_enabled"].isNotNull() & ~a["_enabled"].isin("true", "false"))
    wrong = F.when(blank | odd, "INVALID_STRUCTURED_XML").when(F.col("source_sequence").isNull(), "INVALID_STRUCTURED_RESPONSE")
    # Written once: heads, answers and errors are read from it, and parsing is most of the work.
    checked = cut(rows.withColumn("error", F.coalesce(F.col("_shape"), wrong, _contract(rows))), "xml-responses")
    good = checked.filter("error IS NULL")
    heads = [*keep, "response_id"]
    exploded = good.select(*heads, F.posexplode("answers").alias("pos", "a"))
    answers = exploded.select(
        *heads,
        F.col("a.`_item-path`").alias("item_path"),
        F.col("a.`_group-instance`").alias("group_instance"),
        F.when(F.coalesce("a.value", F.lit("")) != "", "str").alias("raw_type"),
        F.nullif("a.value", F.lit("")).alias("raw_value"),
        F.col("a._unit").alias("unit"),
        F.col("a._enabled").cast("boolean").alias("declared_enabled"),
        "pos",
        F.concat(F.lit(f"/{RESPONSE_TAG}/answer["), (F.col("pos") + 1).cast("string"), F.lit("]")).alias("locator"),
    )
    return _heads(good, heads), answers, checked.filter("error IS NOT NULL").select("object_key", "error")


def _conditions(conditions: Column, expected) -> Column:
    return F.transform(
        F.coalesce(conditions, F.array()),
        lambda c: F.struct(expected(c, "source").alias("source_item_path"), expected(c, "operator").alias("operator"), _tagged(expected(c, "value")).alias("expected")),
    ).cast(f"array<{CONDITION}>")


def _item_errors(items: DataFrame) -> DataFrame:
    bad_condition = F.exists(
        "conditions",
        lambda c: c["source_item_path"].isNull()
        | ~F.coalesce(c["operator"].isin(*OPERATORS), F.lit(False))
        | c["expected"].isNull()
        | ((c["operator"] == "exists") & (c["expected"]["t"] != "bool")),
    )
    error = (
        F.when(F.coalesce(F.trim("item_id"), F.lit("")) == "", "INVALID_ITEM")
        .when(~F.coalesce(F.col("data_type").isin(*DATA_TYPES), F.lit(False)), "UNSUPPORTED_ITEM_TYPE")
        .when(F.col("item_order").isNull(), "INVALID_ITEM")
        .when(bad_condition, "INVALID_CONDITION")
    )
    return items.withColumn("error", error)


_FORM = ("ehr_product", "ehr_version", "form_id", "form_family", "version", "title")


def _definition_result(forms: DataFrame, items: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    checked = _item_errors(items)
    incomplete = None
    for name in _FORM:
        test = F.coalesce(F.trim(name), F.lit("")) == ""
        incomplete = test if incomplete is None else incomplete | test
    wrong = forms.filter(incomplete).select("object_key", F.lit("INVALID_FORM_DEFINITION").alias("error"))
    errors = errors.unionByName(wrong).unionByName(checked.filter("error IS NOT NULL").select("object_key", "error"))
    return forms.filter(~incomplete), checked.filter("error IS NULL").drop("error"), errors


def read_json_definitions(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(forms, items, errors)`` of JSON definitions; items nest through ``children``, as deep as they do."""
    depth = levels_of(documents, json_levels(F.col("content"), "children")) + 1

    def item(level: int) -> str:
        below = f"array<{item(level - 1)}>" if level > 1 else "string"
        return (
            "struct<item_id:string,path:string,label:string,data_type:string,order:int,order_semantic:boolean,"
            f"required:boolean,repeats:boolean,unit:string,calculation:string,value_options:array<{OPTION}>,"
            "display_conditions:array<struct<source_item_path:string,operator:string,expected:variant>>,"
            f"children:{below}>"
        )

    head = ",".join(f"{n}:string" for n in _FORM)
    schema = f"schema_version string, form struct<{head},source_order_semantic:boolean,metadata:map<string,string>,items:array<{item(depth)}>>"
    parsed = cut(documents.select("object_key", F.from_json("content", schema).alias("doc")), "definitions")
    good = F.coalesce((F.col("doc.schema_version") == SCHEMA_VERSION) & F.col("doc.form").isNotNull(), F.lit(False))
    forms = parsed.filter(good).select(
        "object_key",
        *[F.col(f"doc.form.{n}").alias(n) for n in _FORM],
        F.coalesce("doc.form.source_order_semantic", F.lit(True)).alias("source_order_semantic"),
        F.coalesce("doc.form.metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )
    keep = ["object_key", "form_id", "version"]
    level = parsed.filter(good).select(
        "object_key", F.col("doc.form.form_id").alias("form_id"), F.col("doc.form.version").alias("version"),
        F.lit(None).cast("string").alias("parent_path"), F.explode("doc.form.items").alias("it"),
    )
    rows = None
    for step in range(depth):
        conditions = _conditions(
            F.col("it.display_conditions"),
            lambda c, what: c[{"source": "source_item_path", "operator": "operator", "value": "expected"}[what]],
        )
        part = level.select(
            *keep, F.col("it.path").alias("path"), "parent_path", F.col("it.item_id").alias("item_id"), F.col("it.label").alias("label"),
            F.col("it.data_type").alias("data_type"), F.col("it.order").alias("item_order"),
            F.coalesce("it.order_semantic", F.lit(True)).alias("order_semantic"), F.coalesce("it.required", F.lit(False)).alias("required"),
            F.coalesce("it.repeats", F.lit(False)).alias("repeats"), F.col("it.unit").alias("unit"), F.col("it.calculation").alias("calculation"),
            F.coalesce("it.value_options", F.array().cast(f"array<{OPTION}>")).alias("options"), conditions.alias("conditions"),
        )
        rows = part if rows is None else rows.unionByName(part)
        if step + 1 < depth:
            level = level.select(*keep, F.col("it.path").alias("parent_path"), F.explode("it.children").alias("it"))
    errors = parsed.filter(~good).select(
        "object_key",
        F.when(F.col("doc").isNull(), "INVALID_STRUCTURED_JSON").otherwise("UNSUPPORTED_STRUCTURED_SCHEMA").alias("error"),
    )
    return _definition_result(forms, rows, errors)


def read_xml_definitions(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(forms, items, errors)`` of XML definitions; a path defaults to the parent's and the id."""
    depth = levels_of(documents, xml_levels(F.col("content"), "item"))
    option = T.StructType(_attributes(["code", "display", "system"]))
    condition = T.StructType(_attributes(["source-path", "operator", "expected-json"]))

    def item(level: int) -> T.StructType:
        fields = _attributes(
            ["id", "path", "label", "data-type", "order", "order-semantic", "required", "repeats", "unit", "calculation"]
        )
        fields += [T.StructField("option", T.ArrayType(option)), T.StructField("condition", T.ArrayType(condition))]
        below = T.ArrayType(item(level - 1)) if level > 1 else T.StringType()
        return T.StructType([*fields, T.StructField("item", below)])

    names = {n: n.replace("_", "-") for n in _FORM}
    schema = T.StructType(
        [
            *_attributes(["schema-version", *names.values(), "source-order-semantic"]),
            T.StructField("metadata", T.ArrayType(T.StructType(_attributes(["key", "value"])))),
            T.StructField("item", T.ArrayType(item(depth))),
        ]
    )
    parsed = cut(_parse_xml(documents, schema, DEFINITION_TAG).drop("content"), "definitions")
    good = parsed.filter("_shape IS NULL")
    pairs = F.transform("doc.metadata", lambda m: F.struct(m["_key"].alias("key"), m["_value"].alias("value")))
    forms = good.select(
        "object_key",
        *[F.col(f"doc.`_{x}`").alias(n) for n, x in names.items()],
        (F.coalesce("doc.`_source-order-semantic`", F.lit("true")) == "true").alias("source_order_semantic"),
        F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>")).alias("metadata"),
    )
    keep = ["object_key", "form_id", "version"]
    level = good.select(
        "object_key", F.col("doc.`_form-id`").alias("form_id"), F.col("doc._version").alias("version"),
        F.lit(None).cast("string").alias("parent_path"), F.posexplode("doc.item").alias("i", "it"),
    )
    rows = None
    for step in range(depth):
        path = F.coalesce("it._path", F.concat_ws("/", "parent_path", "it._id"))
        level = level.withColumn("path", path)
        conditions = _conditions(
            F.col("it.condition"),
            lambda c, what: F.try_parse_json(c["_expected-json"]) if what == "value" else c[{"source": "_source-path", "operator": "_operator"}[what]],
        )
        options = F.transform(
            F.coalesce("it.option", F.array().cast(T.ArrayType(option))),
            lambda o: F.struct(o["_code"].alias("code"), F.coalesce(o["_display"], o["_code"]).alias("display"), o["_system"].alias("system")),
        )
        part = level.select(
            *keep, "path", "parent_path", F.col("it._id").alias("item_id"), F.coalesce("it._label", "it._id").alias("label"),
            F.col("it.`_data-type`").alias("data_type"), F.coalesce(F.col("it._order"), F.col("i").cast("string")).try_cast("int").alias("item_order"),
            (F.coalesce("it.`_order-semantic`", F.lit("true")) == "true").alias("order_semantic"),
            (F.coalesce("it._required", F.lit("false")) == "true").alias("required"),
            (F.coalesce("it._repeats", F.lit("false")) == "true").alias("repeats"),
            F.col("it._unit").alias("unit"), F.col("it._calculation").alias("calculation"), options.alias("options"), conditions.alias("conditions"),
        )
        rows = part if rows is None else rows.unionByName(part)
        if step + 1 < depth:
            level = level.select(*keep, F.col("path").alias("parent_path"), F.posexplode("it.item").alias("i", "it"))
    errors = parsed.filter("_shape IS NOT NULL").select("object_key", F.col("_shape").alias("error"))
    return _definition_result(forms, rows, errors)
