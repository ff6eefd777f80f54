"""Canonical answers: one row per response, item and group instance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions.answers import SCALAR, answer_state, coerce, condition_holds, parse_number, text_scalar
from formloom.functions.identity import deterministic_uuid
from formloom.operators.ordering import block_ordinal, null_safe_join
from formloom.session import broadcast_if_small, is_small

EVIDENCE = (
    "struct<object_key:string,checksum_sha256:string,media_type:string,json_pointer:string,"
    "source_locator:string,page:int,text_span_start:int,text_span_end:int,"
    "bounding_box:array<double>,extraction_method:string,extractor_version:string,"
    "confidence:double>"
)
LIFECYCLE_EVENT = (
    "struct<status:string,occurred_at:timestamp,source_sequence:bigint,supersedes_event_id:string>"
)
CHECKSUM = r"^[a-f0-9]{64}$"


def evidence(**fields: Column) -> Column:
    """One evidence reference; fields that are not given are null."""
    names = [part.split(":")[0] for part in EVIDENCE[len("struct<") : -1].split(",")]
    kinds = dict(part.split(":", 1) for part in EVIDENCE[len("struct<") : -1].split(","))
    unknown = set(fields) - set(names)
    if unknown:
        raise ValueError(f"unknown evidence fields {sorted(unknown)}")
    return F.struct(
        *[fields.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names]
    )


def attach_evidence(df: DataFrame, **fields: Column) -> DataFrame:
    """Adds the one-element evidence list of a structured answer."""
    return df.withColumn("evidence", F.array(evidence(**fields)))


def attach_lifecycle(df: DataFrame) -> DataFrame:
    """Adds the lifecycle list; the superseded answer is found through the prior response's id."""
    superseded = F.when(
        F.col("supersedes_response_id").isNotNull(),
        answer_id("establishment_id", "supersedes_response_id", "item_path", "group_instance"),
    )
    step = F.struct(
        F.col("lifecycle_status").alias("status"),
        F.col("authored_at").cast("timestamp").alias("occurred_at"),
        F.col("source_sequence").cast("bigint").alias("source_sequence"),
        superseded.alias("supersedes_event_id"),
    )
    return df.withColumn("lifecycle", F.array(step))


def answer_id(site: str, response: str, path: str, instance: str) -> Column:
    """Identity of one answer."""
    return deterministic_uuid(
        "canonical-answer", site, response, path, F.coalesce(F.nullif(F.col(instance), F.lit("")), F.lit("0"))
    )


def canonicalize_eav(answers: DataFrame) -> DataFrame:
    """Entity-attribute-value rows to canonical answers, without filling in missing items.

    Expects ``establishment_id, response_id, patient_pseudonym, item_path, raw_value, unit,
    group_instance, lifecycle_status, authored_at`` and the four form columns. Every row counts as
    present and displayed; a text value stays a text.
    """
    return answers.withColumn(
        "event_id", answer_id("establishment_id", "response_id", "item_path", "group_instance")
    ).withColumn(
        "state",
        answer_state(F.lit(True), F.lit(True), F.col("raw_value"), F.col("lifecycle_status")),
    ).withColumn("value", F.when(F.col("state") == "PRESENT", text_scalar(F.col("raw_value"))))


EAV_CONTRACT = {
    "response_id": "string",
    "patient_id": "string",
    "item_path": "string",
    "raw_value": "string",
    "authored_at": "timestamp",
    "lifecycle_status": "string",
    "group_instance": "string",
    "unit": "string",
}


def read_eav(df: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """Check a tabular source against the EAV contract and give it the contract's types.

    ``renamed`` maps contract names to source names. A missing required column is an error; the
    last three columns may be absent.
    """
    renamed = renamed or {}
    optional = {"lifecycle_status": F.lit("SIGNED"), "group_instance": F.lit(None), "unit": F.lit(None)}
    columns, missing = [], []
    for name, kind in EAV_CONTRACT.items():
        source = renamed.get(name, name)
        if source in df.columns:
            columns.append(F.col(source).cast(kind).alias(name))
        elif name in optional:
            columns.append(optional[name].cast(kind).alias(name))
        else:
            missing.append(name)
    if missing:
        raise ValueError(f"EAV source lacks {missing}")
    return df.select(*columns, *[c for c in df.columns if c not in {*EAV_CONTRACT, *renamed.values()}])


def group_instances(
    occurrences: DataFrame, keys: list[str], position: str = "pos", repeated: str = "repeats"
) -> DataFrame:
    """Adds ``occurrence`` and ``group_instance`` of repeated items.

    The ordinal counts the same path inside its parent instance in document order; an instance is
    ``path:ordinal`` below its parent's instance, and items that do not repeat inherit it.
    """
    numbered = block_ordinal(occurrences, keys, position, "occurrence")
    local = F.concat_ws(":", F.col("item_path"), F.col("occurrence").cast("string"))
    return numbered.withColumn(
        "group_instance",
        F.when(F.col(repeated), F.concat_ws("/", F.col("parent_instance"), local)).otherwise(
            F.col("parent_instance")
        ),
    )


def answer_suffix(instance: Column, index: Column, answers: Column) -> Column:
    """Instance of one of several answers to the same item."""
    suffix = F.concat(F.lit("answer:"), index.cast("string"))
    return F.when(answers > 1, F.concat_ws("/", instance, suffix)).otherwise(instance)


RESPONSE_KEY = ["establishment_id", "response_id"]
# Rows are sorted by the response first: few sites share one, so its first characters tell most rows apart.
_SORT_KEY = ["response_id", "establishment_id"]


def answer_shape_errors(answers: DataFrame, items: DataFrame, form: list[str]) -> DataFrame:
    """Answers that contradict the form, with the reason.

    Unknown path, value on a group, missing or forbidden group instance, repeated identity; the
    first of these that applies.
    """
    known = items.select(
        *form, F.col("path").alias("item_path"), "data_type", "repeated_root", F.lit(True).alias("_known")
    )
    joined = answers.join(broadcast_if_small(known), [*form, "item_path"], "left")
    key = [*RESPONSE_KEY, "item_path", "group_instance"]
    repeated = answers.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    joined = null_safe_join(joined, repeated, key, "left")
    blank = F.coalesce(F.col("group_instance"), F.lit("")) == ""
    reason = (
        F.when(F.col("_known").isNull(), "UNKNOWN_ITEM_PATH")
        .when(F.col("data_type") == "group", "INVALID_STRUCTURED_VALUE")
        .when(F.col("repeated_root").isNotNull() & blank, "REPEATED_GROUP_CONFLICT")
        .when(
            F.col("repeated_root").isNull() & F.col("group_instance").isNotNull(),
            "REPEATED_GROUP_CONFLICT",
        )
        .when(F.col("_copies").isNotNull(), "DUPLICATE_ANSWER")
    )
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select(
        *answers.columns, "reason"
    )


def expected_keys(
    responses: DataFrame, answers: DataFrame, items: DataFrame, form: list[str]
) -> DataFrame:
    """Every (response, item, group instance) that must have an answer row.

    Items outside repeated groups are expected once per response, items of a repeated group once
    per instance observed in the response, including the instances of their sibling items. All
    columns of ``responses`` are carried along.
    """
    leaf = broadcast_if_small(
        items.filter(F.col("data_type") != "group").withColumnRenamed("path", "item_path")
    )
    single = responses.join(leaf.filter("repeated_root IS NULL"), form).withColumn(
        "group_instance", F.lit(None).cast("string")
    )
    roots = broadcast_if_small(
        items.filter("repeated_root IS NOT NULL AND data_type <> 'group'").select(
            *form, F.col("path").alias("item_path"), "repeated_root"
        )
    )
    instances = (
        answers.filter("group_instance IS NOT NULL")
        .join(roots, [*form, "item_path"])
        .select(*RESPONSE_KEY, "repeated_root", "group_instance")
        .distinct()
    )
    repeated = instances.join(responses, RESPONSE_KEY).join(leaf, [*form, "repeated_root"])
    return single.unionByName(repeated.select(*single.columns))


def densify(
    responses: DataFrame, answers: DataFrame, items: DataFrame, form: list[str]
) -> DataFrame:
    """Expected answers (see ``expected_keys``) with what was answered; ``present`` tells the difference.

    Answers are shuffled and sorted once, by response, with a row per response, and gathered by instance; what is
    missing in an instance is added to its list, so neither the expected rows nor the instances are shuffled or
    joined. A response is one document: its rows have to fit one task.
    """
    leaf = items.filter(F.col("data_type") != "group").withColumnRenamed("path", "item_path")
    small = is_small(leaf)
    known = F.broadcast if small else lambda df: df
    grouped = leaf.filter("repeated_root IS NOT NULL")
    named = grouped.groupBy(*form, "item_path").agg(F.collect_set("repeated_root").alias("_roots"))
    by_root = grouped.groupBy(*form, "repeated_root").agg(F.collect_set("item_path").alias("paths"))
    by_root = by_root.groupBy(*form).agg(F.map_from_entries(F.collect_list(F.struct("repeated_root", "paths"))).alias("_of_root"))
    single = leaf.groupBy(*form).agg(F.collect_set(F.when(F.col("repeated_root").isNull(), F.col("item_path"))).alias("_single"))
    paths = single.join(by_root, form, "left")
    given = _rename_unit(answers).join(known(named), [*form, "item_path"], "left")
    rest = [c for c in given.columns if c not in {*RESPONSE_KEY, *form, "item_path", "group_instance", "_roots"}]
    given = given.select(*RESPONSE_KEY, "group_instance", "_roots", F.struct("item_path", *rest, F.lit(True).alias("present")).alias("_answer"))
    kinds = {f.name: f.dataType for f in given.schema["_answer"].dataType}
    head = [c for c in responses.columns if c not in RESPONSE_KEY]
    # Every response has the place outside its groups, answered or not.
    place = responses.select(
        *RESPONSE_KEY, *[F.lit(None).cast(given.schema[c].dataType).alias(c) for c in given.columns[2:]], F.struct(*head).alias("_head")
    )
    both = given.withColumn("_head", F.lit(None).cast(place.schema["_head"].dataType)).unionByName(place)
    gathered = both.repartition(*RESPONSE_KEY).sortWithinPartitions(*_SORT_KEY, "group_instance").groupBy(*_SORT_KEY, "group_instance").agg(
        F.collect_list("_answer").alias("_given"), F.array_distinct(F.flatten(F.collect_list("_roots"))).alias("_roots"),
        F.collect_list("_head").alias("_heads"),
    )
    outside = F.col("group_instance").isNull()
    heads = F.first(F.when(outside, F.col("_heads")), ignorenulls=True).over(Window.partitionBy(*_SORT_KEY))
    # Grouping keeps keys with a null part together; instances only belong to responses without one.
    whole = F.col(RESPONSE_KEY[0]).isNotNull() & F.col(RESPONSE_KEY[1]).isNotNull()
    rows = gathered.withColumn("_heads", heads).filter(outside | whole).withColumn("_head", F.explode("_heads"))
    rows = rows.select(*RESPONSE_KEY, "_head.*", "group_instance", "_roots", "_given").join(known(paths), form)

    def fits(root: Column) -> Column:
        return F.when(outside, root.isNull()).otherwise(root.isNotNull() & F.array_contains("_roots", root))

    none = F.array().cast("array<string>")
    one = F.coalesce(F.try_element_at("_of_root", F.get("_roots", F.lit(0))), none)
    several = F.flatten(F.transform("_roots", lambda root: F.coalesce(F.try_element_at("_of_root", root), none)))
    wanted = F.when(outside, F.col("_single")).when(F.size("_roots") < 2, one).otherwise(several)
    made = F.transform(
        F.array_except(wanted, F.col("_given.item_path")),
        lambda path: F.struct(
            path.alias("item_path"), *[F.lit(None).cast(kinds[c]).alias(c) for c in rest], F.lit(False).alias("present")
        ),
    )
    every = F.when(F.size("_made") == 0, F.col("_given")).otherwise(F.concat("_given", "_made"))
    rows = rows.withColumn("_made", made).withColumn("_e", F.explode(every)).select(*RESPONSE_KEY, *head, "group_instance", "_roots", "_e.*")
    # Answers the form does not expect where they were given have no row.
    out = rows.join(known(leaf), [*form, "item_path"]).filter(fits(F.col("repeated_root")))
    order = [*form, *RESPONSE_KEY, *[c for c in head if c not in form], *[c for c in leaf.columns if c not in form], "group_instance", *rest, "present"]
    out = out.select(*order)
    # An answer brings its own unit, even a null one; a filled-in row takes the unit of the item.
    if "_answer_unit" in out.columns:
        out = out.withColumn(
            "unit", F.when(F.col("present"), F.col("_answer_unit")).otherwise(F.col("unit"))
        ).drop("_answer_unit")
    return out


def _rename_unit(answers: DataFrame) -> DataFrame:
    return answers.withColumnRenamed("unit", "_answer_unit") if "unit" in answers.columns else answers


def answer_context(answers: DataFrame, sources: DataFrame, form: list[str]) -> DataFrame:
    """Per response and group instance, a map from path to the first ``(pos, answer)`` given there.

    Only the paths in ``sources`` (form columns and ``item_path``) are kept: those that conditions
    name, a bounded number per form, so a map never grows with the data.
    """
    named = answers.join(broadcast_if_small(sources), [*form, "item_path"], "left_semi")
    first = named.groupBy(*RESPONSE_KEY, "group_instance", "item_path").agg(
        F.min_by(F.struct("pos", "answer"), F.col("pos")).alias("seen")
    )
    pairs = F.map_from_entries(F.collect_list(F.struct("item_path", "seen")))
    return first.groupBy(*RESPONSE_KEY, "group_instance").agg(pairs.alias("own"))


def with_context(rows: DataFrame, context: DataFrame) -> DataFrame:
    """Adds ``own`` and ``outer``: the answers of the row's instance and those outside any group."""
    outside = context.filter("group_instance IS NULL").drop("group_instance")
    joined = null_safe_join(rows, context, [*RESPONSE_KEY, "group_instance"], "left")
    return joined.join(outside.withColumnRenamed("own", "outer"), RESPONSE_KEY, "left")


def visible(path: Column) -> Column:
    """The answer at ``path`` seen from a row with context; the first in document order wins."""

    both = F.struct(F.try_element_at("own", path).alias("own"), F.try_element_at("outer", path).alias("outer"))
    return _once(both, lambda b: _earlier(b["own"], b["outer"]))


def _earlier(own: Column, outer: Column) -> Column:
    """The answer of the first of two (pos, answer) in document order, where there are any."""
    pick_own = own.isNotNull() & (outer.isNull() | (own["pos"] <= outer["pos"]))
    return F.when(pick_own, own["answer"]).otherwise(outer["answer"])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def condition_sources(items: DataFrame, form: list[str]) -> DataFrame:
    """The paths that the conditions of each form name."""
    named = items.select(*form, F.explode("conditions.source_item_path").alias("item_path"))
    return named.distinct()


def display_state(
    dense: DataFrame, answers: DataFrame, items: DataFrame, form: list[str], behavior: str = "all"
) -> DataFrame:
    """Adds ``enabled``: the item's display conditions hold for what is visible to it.

    An item sees the answers of its own group instance and those outside any group. Rows and the answers that
    conditions name are shuffled and sorted once, by response, and gathered by instance, where both are looked up. ``answers``
    carries ``pos`` and the typed ``answer``. A response is one document: its rows have to fit one task.
    """
    if behavior not in {"all", "any"}:
        raise ValueError(f"unsupported condition behavior {behavior}")
    rest = [c for c in dense.columns if c not in {*RESPONSE_KEY, "group_instance"}]
    named = answers.join(broadcast_if_small(condition_sources(items, form)), [*form, "item_path"], "left_semi").filter("pos IS NOT NULL")
    entry = F.struct("item_path", F.struct("pos", "answer").alias("seen"))
    named = named.select(*RESPONSE_KEY, "group_instance", entry.alias("_entry"))
    rows = dense.select(*RESPONSE_KEY, "group_instance", F.struct(*rest).alias("_row"))
    both = rows.withColumn("_entry", F.lit(None).cast(named.schema["_entry"].dataType)).unionByName(
        named.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))
    )
    # Sorted first, so that lists are built group by group in one go.
    gathered = both.repartition(*RESPONSE_KEY).sortWithinPartitions(*_SORT_KEY, "group_instance").groupBy(*_SORT_KEY, "group_instance").agg(
        F.collect_list("_row").alias("_rows"), F.collect_list("_entry").alias("_entries")
    )
    gathered = gathered.withColumn("own", _first_seen(F.col("_entries"))).drop("_entries")
    outside = F.first(F.when(F.col("group_instance").isNull(), F.col("own")), ignorenulls=True).over(Window.partitionBy(*_SORT_KEY))
    # Without a whole key a row sees its own instance only.
    whole = F.col(RESPONSE_KEY[0]).isNotNull() & F.col(RESPONSE_KEY[1]).isNotNull()
    seen = gathered.withColumn("outer", F.when(whole, outside)).withColumn("_row", F.explode("_rows"))
    names = [c if c == "group_instance" else f"_row.{c}" for c in dense.columns if c not in RESPONSE_KEY]
    return _with_enabled(seen.select(*RESPONSE_KEY, *names, "own", "outer"), behavior)


def _first_seen(entries: Column) -> Column:
    """Map from path to the first ``(pos, answer)`` of a list of (item_path, (pos, answer)); sorted only if a path comes again."""
    ordered = F.array_sort(entries)
    first = F.transform(ordered, lambda e, i: F.when((i == 0) | (F.get(ordered, i - 1)["item_path"] != e["item_path"]), e))
    again = F.size(F.array_distinct(entries["item_path"])) < F.size(entries)
    return F.map_from_entries(F.when(again, F.array_compact(first)).otherwise(entries))


def display_conflicts(dense: DataFrame, declared: str = "declared_enabled") -> DataFrame:
    """Answers whose declared display state contradicts the form logic."""
    return dense.filter(
        F.col(declared).isNotNull() & (F.col(declared) != F.col("enabled"))
    ).withColumn("reason", F.lit("CONDITIONAL_LOGIC_CONFLICT"))


def type_answers(dense: DataFrame) -> DataFrame:
    """Adds ``answer`` (typed) and ``type_error`` from the raw value and the declared type."""
    # Read once into a column of its own; an expression that names it several times would read it as often.
    number = F.when(F.col("data_type").isin("integer", "decimal") & F.col("raw_type").isin("num", "str"), parse_number(F.col("raw_value")))
    typed = dense.withColumn("_number", number).withColumn(
        "answer", coerce(F.col("raw_type"), F.col("raw_value"), F.col("data_type"), F.col("_number"))
    )
    return typed.drop("_number").withColumn("type_error", _type_error())


def _type_error() -> Column:
    return F.when(F.col("raw_value").isNotNull() & F.col("answer").isNull(), "INVALID_DATA_TYPE")


# Answers of these are left out for their status, whatever their value.
SILENT_STATUSES = ("DRAFT", "VOIDED", "DELETED")


def canonical_stream(
    responses: DataFrame,
    answers: DataFrame,
    items: DataFrame,
    form: list[str],
    behavior: str = "all",
) -> DataFrame:
    """Canonical rows and error rows of structured responses in one stream, told apart by ``reason``.

    ``responses``: key, form columns, ``patient_pseudonym, authored_at, lifecycle_status``; one row per
    key, neither part null. ``answers``: key, form columns, ``item_path, group_instance, raw_type,
    raw_value, pos``, and where the source declares it ``declared_enabled``; other columns are carried.

    An answer with an unknown path, on a group, with a missing or forbidden instance, given twice, or
    against its declared display state becomes a row with the reason, and ``rejected`` marks all rows of
    its response. Display states are only compared where a response has no other error. A value that does not fit its declared type becomes an INVALID row. Answers whose
    response is not there are left out.

    Responses and answers are each shuffled once, by response, sorted once and gathered by instance; repetition,
    context and rejection, that for declared display states too, are told from those lists, and what was expected
    but not answered is added to them, so no answer is copied by a window. A response is one document: its rows
    have to fit one task.
    """
    if behavior not in {"all", "any"}:
        raise ValueError(f"unsupported condition behavior {behavior}")
    leaf, expected = _catalogue(items, form)
    mine = {*RESPONSE_KEY, *form, "item_path", "group_instance"}
    carried = [c for c in answers.columns if c not in mine]
    declared = "declared_enabled" in carried
    # Columns of their own, so that those nobody asks for are not carried.
    head = {f"_head_{c}": c for c in responses.columns if c not in {*RESPONSE_KEY, *form}}
    rows = responses.select(*RESPONSE_KEY, *form, *[F.col(c).alias(name) for name, c in head.items()]).join(
        answers.drop(*form).withColumn("present", F.lit(True)), RESPONSE_KEY, "left"
    )
    rows = rows.join(leaf.drop("_item_unit"), [*form, "item_path"], "left")
    told = F.col("declared_enabled").isNotNull() if declared else F.lit(False)
    # Sorted while the rows are narrow; typing does not undo it, so lists are built group by group in one go.
    rows = rows.withColumn("conditions", F.when(told, F.col("conditions"))).sortWithinPartitions(*_SORT_KEY, "group_instance")
    rows = type_answers(rows)
    rows = _with_context(_gathered(rows, [*form, *head], carried))
    if declared:
        clash = F.exists("_asked", lambda e: e["declared_enabled"] != _enabled(behavior, e["conditions"]))
        rows = rows.withColumn("_clash", ~F.col("_faulty") & F.coalesce(clash, F.lit(False)))
        rows = rows.withColumn("rejected", F.col("_faulty") | F.max("_clash").over(Window.partitionBy(*_SORT_KEY)))
    else:
        rows = rows.withColumn("rejected", F.col("_faulty"))
    rows = _fill_in(rows, expected, form, [*head], [*carried, "answer", "reason", "present"])
    rows = _with_enabled(rows.join(leaf, [*form, "item_path"], "left"), behavior)
    rows = rows.withColumn("type_error", F.when(F.col("present"), _type_error()))
    if declared:
        conflict = F.col("present") & ~F.col("_faulty") & (F.col("declared_enabled") != F.col("enabled"))
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(conflict, F.lit("CONDITIONAL_LOGIC_CONFLICT"))))
    # An answer brings its own unit, even a null one; a filled-in row takes the unit of the item.
    own_unit = F.col("unit") if "unit" in carried else F.lit(None).cast("string")
    rows = rows.withColumn("unit", F.when(F.col("present"), own_unit).otherwise(F.col("_item_unit")))
    rows = rows.select("*", *[F.col(name).alias(c) for name, c in head.items()]).drop(*head, "_faulty", "_item_unit", "_named", "_known")
    state = F.when(
        F.col("type_error").isNotNull() & F.col("enabled") & ~F.col("lifecycle_status").isin(*SILENT_STATUSES),
        F.lit("INVALID"),
    ).otherwise(answer_state(F.col("present"), F.col("enabled"), F.col("answer.s"), F.col("lifecycle_status")))
    rows = rows.withColumn("event_id", answer_id("establishment_id", "response_id", "item_path", "group_instance"))
    return rows.withColumn("state", F.when(F.col("reason").isNull(), state)).withColumn(
        "value", F.when(F.col("state") == "PRESENT", F.col("answer")).cast(SCALAR)
    )


def _catalogue(items: DataFrame, form: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items by path (type, root, unit, conditions, whether a condition names them), and per form the paths
    that are expected, by the root of their group; those outside groups have the empty root."""
    named = condition_sources(items, form).withColumn("_named", F.lit(True))
    known = items.select(
        *form, F.col("path").alias("item_path"), "data_type", "repeated_root", F.col("unit").alias("_item_unit"), "conditions",
        F.lit(True).alias("_known"),
    ).join(named, [*form, "item_path"], "left")
    root = F.coalesce("repeated_root", F.lit("")).alias("root")
    paths = known.filter("data_type <> 'group'").groupBy(*form, root).agg(F.collect_list("item_path").alias("paths"))
    expected = paths.groupBy(*form).agg(F.map_from_entries(F.collect_list(F.struct("root", "paths"))).alias("_expected"))
    # Both come from the same items, so one count bounds both.
    return (F.broadcast(known), F.broadcast(expected)) if is_small(known) else (known, expected)


def _shape_reason() -> Column:
    """Why an answer cannot stand in its form, whatever the other answers are."""
    blank = F.coalesce(F.col("group_instance"), F.lit("")) == ""
    return (
        F.when(F.col("_known").isNull(), "UNKNOWN_ITEM_PATH")
        .when(F.col("data_type") == "group", "INVALID_STRUCTURED_VALUE")
        .when(F.col("repeated_root").isNotNull() & blank, "REPEATED_GROUP_CONFLICT")
        .when(F.col("repeated_root").isNull() & F.col("group_instance").isNotNull(), "REPEATED_GROUP_CONFLICT")
    )


def _gathered(rows: DataFrame, head: list[str], carried: list[str]) -> DataFrame:
    """One row per response and instance, with the first answer to each path there and why it cannot stand, a map
    of those that conditions name, the least and greatest root, and the declared display states with their conditions."""
    grouped = F.col("group_instance").isNotNull() & (F.col("group_instance") != "")
    named = F.coalesce(F.col("_named"), F.lit(False))
    given = F.struct(
        "item_path", *carried, "answer", _shape_reason().alias("reason"), named.alias("_named"),
        F.when(grouped, F.col("repeated_root")).alias("_root"), F.lit(True).alias("present"), F.lit(True).alias("_placed"),
    )
    made = {
        "_given": F.when(F.col("present"), given),
        "_entries": F.when(F.col("present") & named, F.struct("item_path", F.struct("pos", "answer").alias("seen"))),
        "_bad": F.coalesce(F.col("present") & _shape_reason().isNotNull(), F.lit(False)),
        "_root": F.when(F.col("present") & grouped, F.col("repeated_root")),
    }
    lists = ["_given", "_entries"]
    if "declared_enabled" in carried:
        told = F.col("present") & F.col("declared_enabled").isNotNull()
        made["_asked"] = F.when(told, F.struct("declared_enabled", "conditions"))
        lists.append("_asked")
    rows = rows.select(*RESPONSE_KEY, "group_instance", *head, *[c.alias(n) for n, c in made.items()])
    gathered = rows.groupBy(*_SORT_KEY, "group_instance").agg(
        *[F.first(c).alias(c) for c in head], *[F.collect_list(c).alias(c) for c in lists], F.max("_bad").alias("_bad"),
        F.min("_root").alias("_root"), F.max("_root").alias("_last_root"),
    )
    gathered = gathered.withColumn("_repeated", F.size(F.array_distinct("_given.item_path")) < F.size("_given"))
    gathered = gathered.withColumn("_given", F.when(F.col("_repeated"), _first_given(F.col("_given"))).otherwise(F.col("_given")))
    firsts = F.transform(F.filter("_given", lambda e: e["_named"]), lambda e: F.struct(e["item_path"], F.struct(e["pos"], e["answer"])))
    entries = F.when(F.col("_repeated"), firsts.cast(gathered.schema["_entries"].dataType)).otherwise(F.col("_entries"))
    return gathered.select(
        *RESPONSE_KEY, "group_instance", *head, *[c for c in lists if c != "_entries"], "_root", "_last_root",
        F.map_from_entries(entries).alias("own"), (F.col("_bad") | F.col("_repeated")).alias("_bad"),
    )


def _first_given(given: Column) -> Column:
    """The first answer to each path of a list, with a reason if there is another one."""
    places = F.transform(given, lambda e, i: F.struct(e["item_path"].alias("path"), e["pos"].alias("pos"), i.alias("i")))

    def firsts(ordered: Column) -> Column:
        def marked(place: Column, i: Column) -> Column:
            first = (i == 0) | ~F.get(ordered, i - 1)["path"].eqNullSafe(place["path"])
            again = (i + 1 < F.size(ordered)) & F.get(ordered, i + 1)["path"].eqNullSafe(place["path"])
            return F.when(first, F.struct(place["i"].alias("i"), again.alias("again")))

        def answer(place: Column) -> Column:
            reason = F.when(place["again"], F.lit("DUPLICATE_ANSWER"))
            return F.get(given, place["i"]).withField("reason", F.coalesce(F.get(given, place["i"])["reason"], reason))

        return F.transform(F.array_compact(F.transform(ordered, marked)), answer)

    return _once(F.array_sort(places), firsts)


def _with_context(instances: DataFrame) -> DataFrame:
    """Adds what an instance shows and what it sees of its response, and whether it is the first there and has an answer that cannot stand."""
    whole = Window.partitionBy(*_SORT_KEY)
    outside = F.col("group_instance").isNull()
    nothing = F.create_map().cast(instances.schema["own"].dataType)
    # The place outside groups comes first where it is there.
    lead = F.when(~F.max(outside).over(whole), F.min("group_instance").over(whole))
    return instances.select(
        "*",
        F.coalesce(F.first(F.when(outside, F.col("own")), ignorenulls=True).over(whole), nothing).alias("outer"),
        F.first(F.when(outside, F.col("_given.item_path")), ignorenulls=True).over(whole).alias("_given_outside"),
        F.col("group_instance").eqNullSafe(lead).alias("_first"),
        F.max("_bad").over(whole).alias("_faulty"),
    )


# So many conditions of an item are told by compiled expressions, any others by walking the list.
_COMPILED = 2


def _with_enabled(rows: DataFrame, behavior: str) -> DataFrame:
    """Adds ``enabled`` (see ``_enabled``) in place of ``own`` and ``outer``."""
    asked = [F.get("conditions", F.lit(i)) for i in range(_COMPILED)]
    met = {}
    for i, c in enumerate(asked):
        met |= {f"_own{i}": F.try_element_at("own", c["source_item_path"]), f"_outer{i}": F.try_element_at("outer", c["source_item_path"])}
    n = F.coalesce(F.size("conditions"), F.lit(0))
    # Only what the compiled part has not seen is carried further.
    kept = {name: F.when(n > _COMPILED, F.col(name)) for name in ("own", "outer")}
    columns = [c for c in rows.columns if c not in kept]
    rows = rows.withColumns(met).select(
        *columns, *[c.alias(name) for name, c in kept.items()],
        *[_earlier(F.col(f"_own{i}"), F.col(f"_outer{i}")).alias(f"_seen{i}") for i in range(_COMPILED)],
    )
    holds = [condition_holds(F.col(f"_seen{i}"), c["operator"], c["expected"]) for i, c in enumerate(asked)]
    holds.append(_enabled(behavior, F.slice("conditions", _COMPILED + 1, F.greatest(n - _COMPILED, F.lit(0)))))
    enabled = n <= 0
    if behavior == "all":
        every = holds[0]
        for i, test in enumerate(holds[1:], 1):
            every = every & ((n <= i) | test)
        enabled = enabled | every
    else:
        for i, test in enumerate(holds):
            enabled = enabled | ((n > i) & test)
    return rows.select(*columns, enabled.alias("enabled"))


def _enabled(behavior: str, conditions: Column | None = None) -> Column:
    """Whether the display conditions of a row hold for what it sees."""
    conditions = F.col("conditions") if conditions is None else conditions
    fold = F.forall if behavior == "all" else F.exists
    holds = fold(
        conditions,
        lambda c: _once(visible(c["source_item_path"]), lambda seen: condition_holds(seen, c["operator"], c["expected"])),
    )
    return F.coalesce(F.when(F.size(conditions) > 0, holds), F.lit(True))


def _fill_in(instances: DataFrame, expected: DataFrame, form: list[str], head: list[str], kept: list[str]) -> DataFrame:
    """Rows of answers, and of the items nobody answered in an instance that is there."""
    none = F.array().cast("array<string>")
    kinds = {f.name: f.dataType for f in instances.schema["_given"].dataType.elementType}

    def missing(paths: Column, answered: Column, placed: bool) -> Column:
        """``placed`` tells whether the rows belong to the instance and not outside all groups."""
        known = {"present": F.lit(False), "_placed": F.lit(placed)}

        def row(path: Column) -> Column:
            return F.struct(*[(path if c == "item_path" else known.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in kinds.items()])

        return F.transform(F.array_except(F.coalesce(paths, none), F.coalesce(answered, none)), row)

    roots = F.array_distinct(F.array_compact(F.col("_given")["_root"]))
    several = F.flatten(F.transform(roots, lambda root: F.coalesce(F.try_element_at("_expected", root), none)))
    # Almost always an instance has one root, which needs no walk through its answers.
    single = F.try_element_at("_expected", F.col("_root"))
    inside = F.when(F.col("_root").isNull(), none).when(F.col("_root") == F.col("_last_root"), single).otherwise(several)
    outside = F.when(F.col("_first"), F.try_element_at("_expected", F.lit("")))
    added = F.concat(missing(inside, F.col("_given")["item_path"], True), missing(outside, F.col("_given_outside"), False))
    every = F.when(F.size("_added") == 0, F.col("_given")).otherwise(F.concat("_given", "_added"))
    nothing = F.create_map().cast(instances.schema["own"].dataType)
    # What is added outside all groups to a group does not see that group.
    placed = F.col("e._placed") | F.col("group_instance").isNull()
    return instances.join(expected, form, "left").withColumn("_added", added).withColumn("e", F.explode(every)).select(
        *RESPONSE_KEY, *form, *head, "e.item_path", F.when(F.col("e._placed"), F.col("group_instance")).alias("group_instance"),
        *[f"e.{c}" for c in kept], F.when(placed, F.col("own")).otherwise(nothing).alias("own"), "outer", "_faulty", "rejected",
    )


def canonicalize_structured(
    responses: DataFrame,
    answers: DataFrame,
    items: DataFrame,
    form: list[str],
    behavior: str = "all",
) -> DataFrame:
    """The canonical rows of ``canonical_stream``: those of responses without an error."""
    stream = canonical_stream(responses, answers, items, form, behavior)
    return stream.filter(~F.col("rejected")).drop("rejected", "reason")


def canonical_errors(stream: DataFrame) -> DataFrame:
    """The error rows of ``canonical_stream``, one per answer that breaks a rule."""
    return stream.filter("reason IS NOT NULL").select(*RESPONSE_KEY, "item_path", "group_instance", "pos", "reason")


def invariant_violations(canonical: DataFrame) -> DataFrame:
    """Rows that break the contract of a canonical answer, one per broken rule."""
    has_value = F.col("value").isNotNull()
    each = F.col("evidence")

    def broken(test) -> Column:
        return F.coalesce(F.exists(each, test), F.lit(False))

    rules = {
        "PRESENT_REQUIRES_VALUE": (F.col("state") == "PRESENT") & ~has_value,
        "STATE_FORBIDS_VALUE": ~F.col("state").isin("PRESENT", "INVALID") & has_value,
        "EVIDENCE_REQUIRED": F.coalesce(F.size(each), F.lit(0)) < 1,
        "CHECKSUM_FORMAT": broken(lambda e: ~F.coalesce(e["checksum_sha256"].rlike(CHECKSUM), F.lit(False))),
        "SPAN_PAIRING": broken(
            lambda e: e["text_span_start"].isNull() != e["text_span_end"].isNull()
        ),
        "SPAN_ORDER": broken(lambda e: e["text_span_end"] <= e["text_span_start"]),
        "PAGE_RANGE": broken(lambda e: e["page"] < 1),
        "BOX_SHAPE": broken(lambda e: F.size(e["bounding_box"]) != 4),
        "CONFIDENCE_RANGE": broken(lambda e: ~e["confidence"].between(0, 1)),
    }
    flagged = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return canonical.select("event_id", "state", F.explode(flagged).alias("violation"))


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """Batch manifests with unpaired objects, malformed checksums, a reversed period or a bad count."""
    rules = {
        "CHECKSUM_ARITY": F.size("object_keys") != F.size("object_checksums"),
        "CHECKSUM_FORMAT": F.exists("object_checksums", lambda c: ~c.rlike(CHECKSUM)),
        "PERIOD_ORDER": F.col("source_period_end") < F.col("source_period_start"),
        "RECORD_COUNT": F.col("record_count") < 0,
    }
    flagged = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return manifests.select("manifest_id", F.explode(flagged).alias("violation"))


def current_view(canonical: DataFrame) -> DataFrame:
    """Answers that still stand."""
    return canonical.filter(~F.col("state").isin("SUPERSEDED", "VOIDED", "DELETED"))
