"""Form registry: item trees, fingerprints, drift and version binding.

Items are one row each, keyed by the form columns and ``path``; ``parent_path`` carries the tree.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.identity import canonical_json, multiset_digest
from formloom.functions.text import collapse_whitespace
from formloom.operators.ordering import group_index, null_safe_join, previous_row
from formloom.session import broadcast_if_small, cut

def flatten_items(items: DataFrame, form: list[str]) -> DataFrame:
    """Adds ``depth`` and ``repeated_root``, the nearest repeating item at or above each item.

    Levels are joined parent by parent until one is empty; items under a missing parent are not
    reached and keep a null depth, and so do items whose parents form a circle.
    """
    own_root = F.when(F.col("repeats"), F.col("path"))
    level = cut(
        items.filter("parent_path IS NULL").select(*form, "path", F.lit(0).alias("depth"), own_root.alias("repeated_root")), "items"
    )
    reached = level
    for depth in itertools.count(1):
        parents = level.select(
            *form, F.col("path").alias("parent_path"), F.col("repeated_root").alias("_inherited")
        )
        level = cut(
            items.join(parents, [*form, "parent_path"]).select(
                *form, "path", F.lit(depth).alias("depth"), F.coalesce(own_root, F.col("_inherited")).alias("repeated_root")
            ),
            "items",
        )
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return items.join(reached, [*form, "path"], "left")


def _options(column: str) -> Column:
    return F.coalesce(F.to_json(column), F.lit("[]"))


def fingerprint_forms(
    forms: DataFrame, items: DataFrame, form: list[str]
) -> DataFrame:
    """``forms`` with ``source_fingerprint`` and ``compatibility_fingerprint``.

    Items are ordered among their siblings by ``item_order`` where the parent (or the form) says
    order matters, else by path. The position is part of each item's hash, and the hashes are
    folded without an order, so a form of any size is never gathered. The compatibility
    fingerprint leaves out EHR version, form id, version, title, metadata and the order of items
    that do not depend on it.
    """
    parents = items.select(
        *form, F.col("path").alias("parent_path"), F.col("order_semantic").alias("_by_order")
    )
    heads = forms.select(*form, "source_order_semantic")
    placed = items.join(parents, [*form, "parent_path"], "left").join(heads, form)
    by_order = F.when(F.col("parent_path").isNull(), F.col("source_order_semantic")).otherwise(
        F.coalesce("_by_order", F.lit(True))
    )
    rank_key = F.when(by_order, F.col("item_order").cast("bigint")).otherwise(F.lit(0))
    placed = placed.withColumn("_rank", rank_key)
    placed = group_index(placed, [*form, "parent_path"], "_rank", "path", name="_position")
    shared = {
        "item_id": "item_id",
        "path": "path",
        "parent_path": "parent_path",
        "position": "_position",
        "label": collapse_whitespace(F.col("label")),
        "data_type": "data_type",
        "required": "required",
        "repeats": "repeats",
        "unit": "unit",
        "calculation": "calculation",
        "options": _options("options"),
        "conditions": _options("conditions"),
    }
    order = F.col("item_order").cast("bigint")
    complete = canonical_json(**shared, order=order, order_semantic="order_semantic")
    compatible = canonical_json(**shared, order=F.when(F.col("order_semantic"), order))
    bags = (
        placed.withColumns({"_c": F.sha2(complete, 256), "_k": F.sha2(compatible, 256)})
        .groupBy(*form)
        .agg(multiset_digest("_c").alias("_complete"), multiset_digest("_k").alias("_compatible"))
    )
    names = ("ehr_product", "ehr_version", "form_id", "form_family", "version", "title")
    source = canonical_json(
        **{n: n for n in names},
        source_order_semantic="source_order_semantic",
        metadata=F.to_json(F.array_sort(F.map_entries("metadata"))),
        items="_complete",
    )
    compatibility = canonical_json(ehr_product="ehr_product", form_family="form_family", items="_compatible")
    return (
        forms.join(bags, form, "left")
        .withColumn("source_fingerprint", F.sha2(source, 256))
        .withColumn("compatibility_fingerprint", F.sha2(compatibility, 256))
        .drop("_complete", "_compatible")
    )


def form_violations(items: DataFrame, form: list[str]) -> DataFrame:
    """Items that break the shape of a form, with the reason."""
    parents = items.filter("parent_path IS NOT NULL").select(*form, F.col("parent_path").alias("path")).distinct()
    flagged = items.select(*form, "path", "data_type").join(
        parents.withColumn("_has_children", F.lit(True)), [*form, "path"], "left"
    )
    has = F.col("_has_children").isNotNull()
    shape = flagged.select(
        *form,
        "path",
        F.when((F.col("data_type") == "group") & ~has, "GROUP_WITHOUT_CHILDREN")
        .when((F.col("data_type") != "group") & has, "CHILDREN_OF_NON_GROUP")
        .alias("violation"),
    ).filter("violation IS NOT NULL")
    repeated = (
        items.groupBy(*form, "path").count().filter("count > 1").select(*form, "path", F.lit("DUPLICATE_PATH").alias("violation"))
    )
    orphan = items.filter("parent_path IS NOT NULL").join(
        items.select(*form, F.col("path").alias("parent_path")).distinct(), [*form, "parent_path"], "left_anti"
    ).select(*form, "path", F.lit("MISSING_PARENT").alias("violation"))
    return shape.unionByName(repeated).unionByName(orphan)


def form_drift(forms: DataFrame) -> DataFrame:
    """Each version against the one before it: did the source or compatibility fingerprint change.

    ``forms`` carries ``form_id, version`` and both fingerprints.
    """
    kept = forms.select("form_id", "version", "source_fingerprint", "compatibility_fingerprint")
    paired = previous_row(
        kept, ["form_id"], ["version"], ["version", "source_fingerprint", "compatibility_fingerprint"]
    )
    return paired.filter("prev_version IS NOT NULL").select(
        "form_id",
        F.col("prev_version").alias("from_version"),
        F.col("version").alias("to_version"),
        (F.col("source_fingerprint") != F.col("prev_source_fingerprint")).alias("source_changed"),
        (F.col("compatibility_fingerprint") != F.col("prev_compatibility_fingerprint")).alias("compatibility_changed"),
    )


def item_drift(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items added, removed or changed between the version pairs of ``form_drift``."""
    body = F.sha2(
        canonical_json(
            label=collapse_whitespace(F.col("label")),
            data_type="data_type",
            required="required",
            repeats="repeats",
            unit="unit",
            parent="parent_path",
            options=_options("options"),
            conditions=_options("conditions"),
        ),
        256,
    )
    hashed = items.select("form_id", "version", "path", body.alias("body"))
    versions = pairs.select("form_id", "from_version", "to_version")
    old = versions.join(hashed.withColumnRenamed("version", "from_version"), ["form_id", "from_version"])
    new = versions.join(hashed.withColumnRenamed("version", "to_version"), ["form_id", "to_version"])
    key = ["form_id", "from_version", "to_version", "path"]
    joined = old.withColumnRenamed("body", "old_body").join(new.withColumnRenamed("body", "new_body"), key, "full_outer")
    change = (
        F.when(F.col("old_body").isNull(), "ADDED")
        .when(F.col("new_body").isNull(), "REMOVED")
        .when(F.col("old_body") != F.col("new_body"), "CHANGED")
    )
    return joined.select(*key, change.alias("change")).filter("change IS NOT NULL")


def forms_by_family(forms: DataFrame) -> DataFrame:
    """Versions of each form in order, with their number; the nested listing in long form."""
    distinct = forms.select("form_family", "form_id", "version").distinct()
    placed = group_index(distinct, ["form_family", "form_id"], "version", name="version_index")
    sizes = distinct.groupBy("form_family", "form_id").agg(F.count(F.lit(1)).alias("versions"))
    return null_safe_join(placed, sizes, ["form_family", "form_id"], "inner")


def bind_form_version(responses: DataFrame, registered: DataFrame, form: list[str]) -> DataFrame:
    """Responses with the registered form they name; ``binding`` is BOUND or the failure.

    Registrations are counted per form key first, so a response never multiplies.
    """
    known = registered.groupBy(*form).agg(
        F.count(F.lit(1)).alias("_matches"), F.min("registration_id").alias("registration_id")
    )
    joined = responses.join(broadcast_if_small(known), form, "left")
    matches = F.coalesce("_matches", F.lit(0))
    binding = F.when(matches == 0, "UNKNOWN_FORM_VERSION").when(matches > 1, "AMBIGUOUS_FORM_VERSION").otherwise("BOUND")
    return joined.withColumn("binding", binding).withColumn(
        "registration_id", F.when(F.col("binding") == "BOUND", F.col("registration_id"))
    ).drop("_matches")


def search_forms(forms: DataFrame, text: str) -> DataFrame:
    """Forms whose title and id contain the text, whatever its case."""
    haystack = F.lower(F.concat_ws(" ", "title", "form_id"))
    return forms.filter(haystack.contains(text.lower())).orderBy("form_id", "version")


def form_detail(forms: DataFrame, form_id: str, version: str) -> DataFrame:
    return forms.filter((F.col("form_id") == form_id) & (F.col("version") == version))
