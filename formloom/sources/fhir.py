"""FHIR R4 Questionnaire and QuestionnaireResponse documents as item rows.

Items nest; Spark has no recursive types, so documents are read with a schema as deep as the deepest of them and
exploded level by level. What a document does wrong becomes an error row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions.answers import SCALAR, answer_state, scalar
from formloom.operators import canonical
from formloom.session import broadcast_if_small, cut
from formloom.sources.nesting import json_levels, levels_of

# Item types and operators of the standard and the names used here.
ITEM_TYPES = {
    "boolean": "boolean",
    "decimal": "decimal",
    "integer": "integer",
    "date": "date",
    "dateTime": "datetime",
    "string": "string",
    "text": "text",
    "choice": "coding",
    "open-choice": "coding",
    "group": "group",
}
OPERATORS = {"=": "eq", "!=": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "exists": "exists"}
CONDITION = f"struct<source_item_path:string,operator:string,expected:{SCALAR}>"
OPTION = "struct<code:string,display:string,system:string>"


def _nested(fields: str, depth: int) -> str:
    below = f"array<{_nested(fields, depth - 1)}>" if depth > 1 else "string"
    return f"struct<{fields},item:{below}>"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def _explode_levels(parsed: DataFrame, keep: list[str], depth: int) -> list[DataFrame]:
    """One DataFrame per tree level: ``keep``, ``parent_path``, ``path``, ``at`` (indices), ``it``."""
    level = parsed.select(
        *keep, F.lit(None).cast("string").alias("parent_path"), F.array().cast("array<int>").alias("up"),
        F.posexplode("doc.item").alias("i", "it"),
    )
    out = []
    for step in range(depth):
        path = F.when(F.col("parent_path").isNull(), F.col("it.linkId")).otherwise(
            F.concat_ws("/", "parent_path", "it.linkId")
        )
        placed = level.select(
            *keep, "parent_path", path.alias("path"), F.concat("up", F.array("i")).alias("at"), "it"
        )
        out.append(placed)
        if step + 1 < depth:
            level = placed.select(
                *keep, F.col("path").alias("parent_path"), F.col("at").alias("up"), F.posexplode("it.item").alias("i", "it")
            )
    return out


def _tagged(value: Column) -> Column:
    """Scalar struct of a VARIANT; null for objects, arrays and null."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "decimal(38,9)")
    tag = (
        F.when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool")
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "num")
    )
    numeric = F.when(tag == "num", number).when(tag == "bool", F.when(text == "true", 1).otherwise(0))
    return F.when(tag.isNotNull(), scalar(tag, text, numeric))


def _value_of(raw: Column) -> Column:
    """Scalar of an answer's value: a code, a quantity's number, or the value itself."""
    code = F.try_variant_get(raw, "$.code", "string")
    inner = F.try_variant_get(raw, "$.value", "variant")
    is_object = F.schema_of_variant(raw).startswith("OBJECT")
    return F.when(
        is_object, F.when(code.isNotNull(), scalar(F.lit("str"), code)).otherwise(_tagged(inner))
    ).otherwise(_tagged(raw))


def _starting(entries: Column, prefix: str) -> Column:
    return F.map_filter(entries, lambda k, _: k.startswith(prefix))


def read_questionnaires(documents: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(forms, items, errors)`` of documents with columns ``object_key, content`` (JSON text).

    An item in error is left out; with ``whole`` its document is, so no children are orphaned.
    """
    depth = levels_of(documents, json_levels(F.col("content"), "item"))
    fields = (
        "linkId:string,text:string,type:string,required:boolean,repeats:boolean,extension:string,"
        "enableWhen:array<string>,answerOption:array<string>"
    )
    head = "resourceType string, url string, id string, version string, title string, name string, status string"
    schema = f"{head}, item array<{_nested(fields, depth)}>"
    parsed = documents.select("object_key", F.from_json("content", schema).alias("doc"))
    identifier = F.coalesce(F.nullif("doc.url", F.lit("")), F.nullif("doc.id", F.lit("")), F.lit("unknown-questionnaire"))
    parsed = cut(
        parsed.select(
            "object_key", identifier.alias("form_id"), F.coalesce("doc.version", F.lit("unversioned")).alias("version"), "doc"
        ),
        "questionnaires",
    )
    good = F.coalesce(F.col("doc.resourceType") == "Questionnaire", F.lit(False))
    forms = parsed.filter(good).select(
        "object_key",
        "form_id",
        "version",
        F.col("form_id").alias("form_family"),
        F.lit("FHIR R4").alias("ehr_product"),
        F.lit("4.0.1").alias("ehr_version"),
        F.coalesce(F.nullif("doc.title", F.lit("")), F.nullif("doc.name", F.lit("")), F.col("form_id")).alias("title"),
        F.lit(True).alias("source_order_semantic"),
        F.create_map(F.lit("status"), F.coalesce("doc.status", F.lit("unknown"))).alias("metadata"),
    )
    keep = ["object_key", "form_id", "version"]
    rows = None
    for level in _explode_levels(parsed.filter(good), keep, depth):
        part = level.select(
            *keep,
            "path",
            "parent_path",
            F.col("it.linkId").alias("item_id"),
            F.coalesce("it.text", "it.linkId").alias("label"),
            _lookup(ITEM_TYPES, F.col("it.type")).alias("data_type"),
            F.col("at")[F.size("at") - 1].alias("item_order"),
            F.col("at").alias("_at"),
            F.lit(True).alias("order_semantic"),
            F.coalesce("it.required", F.lit(False)).alias("required"),
            F.coalesce("it.repeats", F.lit(False)).alias("repeats"),
            F.lit(None).cast("string").alias("unit"),
            F.lit(None).cast("string").alias("calculation"),
            F.coalesce("it.enableWhen", F.array().cast("array<string>")).alias("_when"),
            F.coalesce("it.answerOption", F.array().cast("array<string>")).alias("_options"),
            F.coalesce("it.extension", F.lit("[]")).alias("_extension"),
        )
        rows = part if rows is None else rows.unionByName(part)
    options = F.transform(
        "_options",
        lambda o: _option(F.from_json(o, "map<string,variant>")),
    )
    rows = rows.withColumn("options", options.cast(f"array<{OPTION}>"))
    items = _with_conditions(rows)
    error = (
        F.when(F.col("item_id").isNull(), "INVALID_FHIR_ITEM")
        .when(~F.col("_extension").isin("[]", "{}", ""), "UNSUPPORTED_FHIR_EXTENSION")
        .when(F.col("data_type").isNull(), "UNSUPPORTED_FHIR_ITEM_TYPE")
        .when(F.col("_bad_condition").isNotNull(), F.col("_bad_condition"))
        .when(F.exists("options", lambda o: o["code"].isNull()), "UNSUPPORTED_FHIR_OPTION")
    )
    items = items.withColumn("error", error)
    problems = parsed.filter(~good).select(
        "object_key",
        F.when(F.col("doc.resourceType").isNull(), "INVALID_FHIR_JSON").otherwise("INVALID_FHIR_RESOURCE").alias("error"),
        F.lit(None).cast("string").alias("path"),
    )
    errors = problems.unionByName(items.filter("error IS NOT NULL").select("object_key", "error", "path"))
    if whole:
        forms = forms.join(errors.select("object_key").distinct(), "object_key", "left_anti")
        # Items tell of each other in one pass; joined with their own errors, they would all be read twice.
        wrong = F.max(F.col("error").isNotNull()).over(Window.partitionBy("object_key"))
        items = items.withColumn("_refused", wrong & F.col("object_key").isNotNull()).filter("NOT _refused").drop("_refused")
        items = items.join(problems.select("object_key").distinct(), "object_key", "left_anti")
    clean = items.filter("error IS NULL").drop("error", "_when", "_options", "_extension", "_bad_condition", "_at")
    return forms, clean, errors


def _option(entries: Column) -> Column:
    coding = F.try_element_at(entries, F.lit("valueCoding"))
    code = F.try_variant_get(coding, "$.code", "string")
    plain = F.coalesce(
        *[F.try_variant_get(F.try_element_at(entries, F.lit(k)), "$", "string") for k in ("valueString", "valueInteger")]
    )
    return F.struct(
        F.coalesce(code, plain).alias("code"),
        F.coalesce(F.try_variant_get(coding, "$.display", "string"), code, plain).alias("display"),
        F.try_variant_get(coding, "$.system", "string").alias("system"),
    )


def _with_conditions(rows: DataFrame) -> DataFrame:
    """Resolves each condition's question to a path of the same form, as far as a walk through the form has come.

    The items of a level are known once their parent is visited, so an item may ask about its siblings, its
    ancestors' siblings and all that lies below earlier items; of a repeated link id the latest counts. As indices
    order items as a walk meets them, that is a running value: questions and registrations of one link id in order.
    """
    keys = ["object_key", "_at"]
    whens = rows.select(*keys, F.posexplode("_when").alias("n", "w")).withColumn(
        "m", F.from_json("w", "map<string,variant>")
    )
    answers = F.map_values(_starting(F.col("m"), "answer"))
    asked = whens.select(
        "object_key",
        F.try_variant_get(F.try_element_at("m", F.lit("question")), "$", "string").alias("question"),
        F.col("_at").alias("time"),
        F.lit(False).alias("known"),
        "n",
        F.lit(None).cast("string").alias("path"),
        _lookup(
            OPERATORS,
            F.coalesce(F.try_variant_get(F.try_element_at("m", F.lit("operator")), "$", "string"), F.lit("=")),
        ).alias("operator"),
        F.when(F.size(answers) == 1, _value_of(answers[0])).alias("expected"),
    )
    last = F.size("_at")
    known = rows.select(
        "object_key", F.col("item_id").alias("question"), F.slice("_at", F.lit(1), last - 1).alias("time"), F.lit(True).alias("known"),
        F.col("_at")[last - 1].alias("n"), "path", F.lit(None).cast("string").alias("operator"), F.lit(None).cast(SCALAR).alias("expected"),
    )
    # A question at the time of a registration comes before it: an item's children are not known to itself.
    walk = Window.partitionBy("object_key", "question").orderBy("time", "known", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = asked.unionByName(known).withColumn("source_item_path", F.last("path", ignorenulls=True).over(walk))
    found = every.filter(~F.col("known")).withColumnRenamed("time", "_at")
    bad = (
        F.when(F.col("source_item_path").isNull(), "INVALID_FHIR_CONDITION")
        .when(F.col("operator").isNull(), "UNSUPPORTED_FHIR_CONDITION")
        .when(F.col("expected").isNull(), "INVALID_FHIR_CONDITION")
    )
    # An item's own conditions: as many as one item of one document declares; the first in error is told.
    grouped = found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("n", "source_item_path", "operator", "expected"))).alias("_c"),
        F.min_by(bad, F.when(bad.isNotNull(), F.col("n"))).alias("_bad_condition"),
    )
    conditions = F.transform(
        "_c", lambda c: F.struct(c["source_item_path"].alias("source_item_path"), c["operator"].alias("operator"), c["expected"].alias("expected"))
    )
    empty = F.array().cast(f"array<{CONDITION}>")
    return (
        rows.join(grouped, keys, "left")
        .withColumn("conditions", F.coalesce(conditions.cast(f"array<{CONDITION}>"), empty))
        .drop("_c")
    )


def read_responses(
    documents: DataFrame, items: DataFrame, form: list[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(responses, answers, errors)`` of QuestionnaireResponse documents.

    ``documents``: ``establishment_id, patient_pseudonym, object_key, content`` and the form
    columns; ``items`` says which paths repeat. Every answer carries its JSON pointer; an item with
    several answers numbers them in its group instance. Nested items win over answers of the same
    item. Items are read as deep as they nest.
    """
    depth = levels_of(documents, json_levels(F.col("content"), "item"))
    schema = f"resourceType string, id string, authored string, item array<{_nested('linkId:string,answer:array<string>', depth)}>"
    parsed = documents.withColumn("doc", F.from_json("content", schema)).withColumn("checksum", F.sha2("content", 256))
    good = F.coalesce(F.col("doc.resourceType") == "QuestionnaireResponse", F.lit(False))
    keep = ["establishment_id", "response_id", *form]
    parsed = cut(
        parsed.withColumn("response_id", F.coalesce("doc.id", "checksum")).drop("content"), "questionnaire-responses"
    )
    authored = F.coalesce("doc.authored", F.lit("1970-01-01T00:00:00+00:00"))
    responses = parsed.filter(good).select(
        *keep,
        "patient_pseudonym",
        "object_key",
        "checksum",
        authored.try_cast("timestamp").alias("authored_at"),
        F.substring(authored, 1, 10).try_cast("date").alias("authored_date"),
        F.lit("SIGNED").alias("lifecycle_status"),
    )
    repeated = broadcast_if_small(items.filter("repeats").select(*form, "path", F.lit(True).alias("repeats")))
    level = parsed.filter(good).select(
        *keep, F.lit(None).cast("string").alias("parent_path"), F.lit("").alias("parent_pointer"),
        F.lit(None).cast("string").alias("parent_instance"), F.array().cast("array<int>").alias("up"),
        F.posexplode("doc.item").alias("i", "it"),
    )
    found = None
    for step in range(depth):
        path = F.when(F.col("parent_path").isNull(), F.col("it.linkId")).otherwise(F.concat_ws("/", "parent_path", "it.linkId"))
        placed = level.withColumn("path", path).join(repeated, [*form, "path"], "left")
        placed = placed.withColumns(
            {
                "item_path": F.col("path"),
                "repeats": F.coalesce("repeats", F.lit(False)),
                "pointer": F.concat("parent_pointer", F.lit("/item/"), F.col("i").cast("string")),
                "at": F.concat("up", F.array("i")),
            }
        ).drop("path")
        # Only what repeats is numbered; the others belong to their parent's instance.
        numbered = canonical.group_instances(placed.filter("repeats"), [*keep[:2], "parent_pointer", "item_path"], position="i")
        single = placed.filter(~F.col("repeats")).withColumn("group_instance", F.col("parent_instance"))
        placed = single.unionByName(numbered.drop("occurrence"))
        last = step + 1 == depth
        if not last:
            # Written once: read for this level's answers and for the next level.
            placed = cut(placed, "level")
        nested = F.lit(False) if last else F.coalesce(F.size("it.item"), F.lit(0)) > 0
        replies = F.coalesce(F.col("it.answer"), F.array().cast("array<string>"))
        shown = F.when(F.size(replies) > 0, replies).otherwise(F.array(F.lit(None).cast("string")))
        part = placed.filter(~nested).select(
            *keep, "item_path", "group_instance", "pointer", "at", F.size(replies).alias("given"),
            F.posexplode(shown).alias("n", "reply"),
        )
        found = part if found is None else found.unionByName(part)
        if not last:
            level = placed.filter(nested).select(
                *keep, F.col("item_path").alias("parent_path"), F.col("pointer").alias("parent_pointer"),
                F.col("group_instance").alias("parent_instance"), F.col("at").alias("up"), F.posexplode("it.item").alias("i", "it"),
            )
    values = F.map_values(_starting(F.from_json("reply", "map<string,variant>"), "value"))
    answered = F.col("given") > 0
    # Each in a step of its own, as both are used more than once.
    rows = found.withColumn("_values", F.when(answered, values))
    rows = rows.withColumn("_answer", F.when(F.size("_values") == 1, _value_of(F.col("_values")[0])))
    answer = F.col("_answer")
    suffixed = canonical.answer_suffix(F.col("group_instance"), F.col("n"), F.col("given"))
    rows = rows.select(
        *keep,
        "item_path",
        suffixed.alias("group_instance"),
        answered.alias("present"),
        F.when(answered, F.concat("pointer", F.lit("/answer/"), F.col("n").cast("string"))).otherwise(F.col("pointer")).alias("json_pointer"),
        F.concat("at", F.array("n")).alias("pos"),
        answer.alias("answer"),
        F.when(F.col("item_path").isNull(), "INVALID_FHIR_RESPONSE")
        .when(answered & (F.size("_values") != 1), "INVALID_FHIR_ANSWER")
        .when(answered & answer.isNull(), "UNSUPPORTED_FHIR_ANSWER")
        .alias("error"),
    )
    # Written once: answers are read as rows, as context and to find what is missing.
    rows = cut(rows, "fhir-answers")
    problems = parsed.filter(~good).select(
        "establishment_id",
        "response_id",
        F.when(F.col("doc.resourceType").isNull(), "INVALID_FHIR_JSON").otherwise("INVALID_FHIR_RESOURCE").alias("error"),
        F.lit(None).cast("string").alias("json_pointer"),
    )
    errors = problems.unionByName(
        rows.filter("error IS NOT NULL").select("establishment_id", "response_id", "error", "json_pointer")
    )
    return responses, rows.filter("error IS NULL").drop("error"), errors


def canonicalize(responses: DataFrame, answers: DataFrame, items: DataFrame, form: list[str]) -> DataFrame:
    """Canonical rows: every answer of a known item, and one row per item nobody answered.

    Unlike structured forms, a repeated group's missing items are filled in only where no instance
    has them, unknown paths are ignored, and values keep the type they came with.
    """
    leaf = broadcast_if_small(
        items.filter("data_type <> 'group'").select(*form, F.col("path").alias("item_path"), "unit", "conditions")
    )
    given = answers.join(leaf, [*form, "item_path"])
    # Both sides are shuffled with a row per response: items are added after they have met.
    named = answers.groupBy(*canonical.RESPONSE_KEY).agg(F.collect_set("item_path").alias("_named"))
    every = responses.select(*canonical.RESPONSE_KEY, *form).join(named, canonical.RESPONSE_KEY, "left").join(leaf, form)
    absent = every.filter(~F.coalesce(F.array_contains("_named", F.col("item_path")), F.lit(False))).drop("_named")
    absent = absent.withColumns(
        {
            "group_instance": F.lit(None).cast("string"),
            "present": F.lit(False),
            "json_pointer": F.lit("/item"),
            "pos": F.lit(None).cast("array<int>"),
            "answer": F.lit(None).cast(SCALAR),
        }
    )
    rows = given.unionByName(absent.select(*given.columns))
    shown = canonical.display_state(rows, answers, items, form)
    rows = shown.join(responses.drop(*form), canonical.RESPONSE_KEY)
    state = answer_state(F.col("present"), F.col("enabled"), F.col("answer.s"), F.col("lifecycle_status"))
    rows = rows.withColumn("state", state).withColumns(
        {
            "value": F.when(F.col("state") == "PRESENT", F.col("answer")),
            "raw_value": F.col("answer.s"),
            "event_id": canonical.answer_id("establishment_id", "response_id", "item_path", "group_instance"),
        }
    )
    return canonical.attach_evidence(
        rows,
        object_key=F.col("object_key"),
        checksum_sha256=F.col("checksum"),
        media_type=F.lit("application/fhir+json"),
        json_pointer=F.col("json_pointer"),
        extraction_method=F.lit("FHIR"),
        extractor_version=F.lit("fhir-r4/1.0.0"),
    )
