"""Form registry on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.operators import forms
from formloom.plans.registry import Source, query
from formloom.plans.sqltext import sql_bag
from formloom.session import cut

FORM = ["form_id", "version"]


def part_items(src: Source) -> DataFrame:
    """Item rows of the forms made of parts."""
    option = F.struct(
        F.col("option_code").alias("code"), F.lower("option_code").alias("display"), F.lit(None).cast("string").alias("system")
    )
    none = F.lit(None).cast("array<struct<source_item_path:string,operator:string,expected:string>>")
    return src.view("b_forms").withColumns(
        {
            "options": F.when(F.col("option_code").isNotNull(), F.array(option)).otherwise(F.array().cast("array<struct<code:string,display:string,system:string>>")),
            "conditions": none,
            "calculation": F.lit(None).cast("string"),
        }
    )


def part_forms(src: Source) -> DataFrame:
    return src.view("b_forms").select("form_id", "form_family", "version").distinct().withColumns(
        {
            "ehr_product": F.lit("Parts"),
            "ehr_version": F.lit("1"),
            "title": F.concat(F.lit("Form "), F.col("form_family"), F.lit(" v"), F.col("version")),
            "source_order_semantic": F.col("version") != "1",
            "metadata": F.create_map(F.lit("status"), F.lit("active")),
        }
    )


@query(
    "d1_flatten_items",
    "b_forms",
    sql="""SELECT c.form_id, c.version, c.path, CASE WHEN c.parent_path IS NULL THEN 0 ELSE 1 END AS depth,
        CASE WHEN c.repeats THEN c.path WHEN p.repeats THEN p.path END AS repeated_root
      FROM b_forms c LEFT JOIN b_forms p ON p.form_id = c.form_id AND p.version = c.version AND p.path = c.parent_path""",
)
def d1_flatten_items(src: Source) -> DataFrame:
    return forms.flatten_items(part_items(src), FORM).select(*FORM, "path", "depth", "repeated_root")


def _item_json(order: str, semantic: bool) -> str:
    def text(name: str) -> str:
        return f"CASE WHEN {name} IS NULL THEN 'null' ELSE '\"' || {name} || '\"' END"

    parts = [
        ("calculation", "'null'"),
        ("conditions", "'\"[]\"'"),
        ("data_type", text("data_type")),
        ("item_id", text("item_id")),
        ("label", text("label_text")),
        (
            "options",
            "CASE WHEN option_code IS NULL THEN '\"[]\"' ELSE '\"[{\\\"code\\\":\\\"' || option_code || "
            "'\\\",\\\"display\\\":\\\"' || lower(option_code) || '\\\"}]\"' END",
        ),
        ("order", order),
    ]
    if semantic:
        parts.append(("order_semantic", "CAST(order_semantic AS VARCHAR)"))
    parts += [
        ("parent_path", text("parent_path")),
        ("path", text("path")),
        ("position", "CAST(position AS VARCHAR)"),
        ("repeats", "CAST(repeats AS VARCHAR)"),
        ("required", "CAST(required AS VARCHAR)"),
        ("unit", text("unit")),
    ]
    body = " || ',' || ".join(f"'\"{name}\":' || {sql}" for name, sql in parts)
    return f"sha256('{{' || {body} || '}}')"


FINGERPRINT_SQL = f"""
    placed AS (SELECT c.*, trim(regexp_replace(c.label, '\\s+', ' ', 'g')) AS label_text,
        row_number() OVER (PARTITION BY c.form_id, c.version, c.parent_path ORDER BY
          CASE WHEN c.parent_path IS NULL THEN CASE WHEN c.version <> '1' THEN c.item_order ELSE 0 END
               WHEN p.order_semantic THEN c.item_order ELSE 0 END, c.path COLLATE "BINARY") - 1 AS position
      FROM b_forms c LEFT JOIN b_forms p ON p.form_id = c.form_id AND p.version = c.version AND p.path = c.parent_path),
    hashed AS (SELECT form_id, form_family, version, {_item_json("CAST(item_order AS VARCHAR)", True)} AS c,
        {_item_json("CASE WHEN order_semantic THEN CAST(item_order AS VARCHAR) ELSE 'null' END", False)} AS k FROM placed),
    bags AS (SELECT form_id, form_family, version, {sql_bag('c')} AS bag_c, {sql_bag('k')} AS bag_k
             FROM hashed GROUP BY form_id, form_family, version),
    fp AS (SELECT form_id, form_family, version,
        sha256('{{"ehr_product":"Parts","ehr_version":"1","form_family":"' || form_family || '","form_id":"' || form_id ||
          '","items":"' || bag_c || '","metadata":"[{{\\"key\\":\\"status\\",\\"value\\":\\"active\\"}}]","source_order_semantic":' ||
          CASE WHEN version <> '1' THEN 'true' ELSE 'false' END || ',"title":"Form ' || form_family || ' v' || version ||
          '","version":"' || version || '"}}') AS source_fingerprint,
        sha256('{{"ehr_product":"Parts","form_family":"' || form_family || '","items":"' || bag_k || '"}}') AS compatibility_fingerprint
      FROM bags)""".replace(' COLLATE "BINARY"', "")


def fingerprinted(src: Source) -> DataFrame:
    return forms.fingerprint_forms(part_forms(src), part_items(src), FORM)


@query(
    "d2_fingerprint_forms",
    "b_forms",
    sql=f"WITH {FINGERPRINT_SQL} SELECT form_id, version, source_fingerprint, compatibility_fingerprint FROM fp",
)
def d2_fingerprint_forms(src: Source) -> DataFrame:
    return fingerprinted(src).select(*FORM, "source_fingerprint", "compatibility_fingerprint")


@query(
    "d3_validate_forms",
    sql="""
    WITH i AS (SELECT p_brand AS form_id, CAST(p_size % 3 AS VARCHAR) AS version, 'I' || (p_partkey % 600) AS path,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'I' || ((p_partkey * 7) % 600) END AS parent_path,
        CASE WHEN p_partkey % 3 = 0 THEN 'group' ELSE 'string' END AS data_type FROM part),
    par AS (SELECT DISTINCT form_id, version, parent_path AS path FROM i WHERE parent_path IS NOT NULL),
    s AS (SELECT i.*, par.path IS NOT NULL AS has FROM i LEFT JOIN par USING (form_id, version, path))
    SELECT form_id, version, path, CASE WHEN data_type = 'group' THEN 'GROUP_WITHOUT_CHILDREN' ELSE 'CHILDREN_OF_NON_GROUP' END AS violation
      FROM s WHERE (data_type = 'group') <> has
    UNION ALL SELECT form_id, version, path, 'DUPLICATE_PATH' FROM i GROUP BY 1, 2, 3 HAVING count(*) > 1
    UNION ALL SELECT form_id, version, path, 'MISSING_PARENT' FROM i WHERE parent_path IS NOT NULL AND NOT EXISTS
      (SELECT 1 FROM i p WHERE p.form_id = i.form_id AND p.version = i.version AND p.path = i.parent_path)""",
)
def d3_validate_forms(src: Source) -> DataFrame:
    key = F.col("p_partkey")

    def path(number: Column) -> Column:
        return F.concat(F.lit("I"), (number % 600).cast("string"))

    items = src.table("part").select(
        F.col("p_brand").alias("form_id"),
        (F.col("p_size") % 3).cast("string").alias("version"),
        path(key).alias("path"),
        F.when(key % 5 != 0, path(key * 7)).alias("parent_path"),
        F.when(key % 3 == 0, "group").otherwise("string").alias("data_type"),
    )
    return forms.form_violations(items, FORM)


@query(
    "d4_form_drift",
    "b_forms",
    sql=f"""WITH {FINGERPRINT_SQL}, w AS (SELECT form_id, version,
        lag(version) OVER x AS pv, lag(source_fingerprint) OVER x AS ps, lag(compatibility_fingerprint) OVER x AS pk,
        source_fingerprint, compatibility_fingerprint FROM fp WINDOW x AS (PARTITION BY form_id ORDER BY version))
    SELECT form_id, pv AS from_version, version AS to_version, source_fingerprint <> ps AS source_changed,
      compatibility_fingerprint <> pk AS compatibility_changed FROM w WHERE pv IS NOT NULL""",
)
def d4_form_drift(src: Source) -> DataFrame:
    return forms.form_drift(fingerprinted(src))


@query(
    "d4_item_drift",
    "b_forms",
    sql="""
    WITH v AS (SELECT DISTINCT form_id, version FROM b_forms),
    w AS (SELECT form_id, version AS to_version, lag(version) OVER (PARTITION BY form_id ORDER BY version) AS from_version FROM v),
    pairs AS (SELECT * FROM w WHERE from_version IS NOT NULL),
    o AS (SELECT p.*, b.path, (b.label, b.data_type, b.required, b.repeats, b.unit, b.parent_path, b.option_code) AS body
          FROM pairs p JOIN b_forms b ON b.form_id = p.form_id AND b.version = p.from_version),
    n AS (SELECT p.*, b.path, (b.label, b.data_type, b.required, b.repeats, b.unit, b.parent_path, b.option_code) AS body
          FROM pairs p JOIN b_forms b ON b.form_id = p.form_id AND b.version = p.to_version)
    SELECT coalesce(o.form_id, n.form_id) AS form_id, coalesce(o.from_version, n.from_version) AS from_version,
      coalesce(o.to_version, n.to_version) AS to_version, coalesce(o.path, n.path) AS path,
      CASE WHEN o.path IS NULL THEN 'ADDED' WHEN n.path IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change
    FROM o FULL OUTER JOIN n ON o.form_id = n.form_id AND o.from_version = n.from_version AND o.to_version = n.to_version AND o.path = n.path
    WHERE o.path IS NULL OR n.path IS NULL OR o.body IS DISTINCT FROM n.body""",
)
def d4_item_drift(src: Source) -> DataFrame:
    pairs = cut(forms.form_drift(fingerprinted(src)), "drift")
    return forms.item_drift(part_items(src), pairs)


@query(
    "d5_forms_by_family",
    "b_forms",
    sql="""WITH v AS (SELECT DISTINCT form_family, form_id, version FROM b_forms)
    SELECT *, row_number() OVER (PARTITION BY form_family, form_id ORDER BY version) - 1 AS version_index,
      count(*) OVER (PARTITION BY form_family, form_id) AS versions FROM v""",
)
def d5_forms_by_family(src: Source) -> DataFrame:
    return forms.forms_by_family(src.view("b_forms"))


@query(
    "d6_bind_form_version",
    "b_forms",
    sql="""WITH g AS (SELECT form_id, version, p.path AS registration_id FROM b_forms p WHERE parent_path IS NULL AND path <> 'PROMO'
        AND (form_id <> 'form-Brand#3' OR version <> '2')),
    k AS (SELECT form_id, version, count(*) AS n, min(registration_id) AS registration_id FROM g
          WHERE registration_id IN ('ECONOMY', 'STANDARD') GROUP BY 1, 2),
    r AS (SELECT o_orderkey AS response_id, 'form-Brand#' || (o_custkey % 30) AS form_id, CAST(o_orderkey % 3 AS VARCHAR) AS version FROM orders)
    SELECT response_id, CASE WHEN k.n IS NULL THEN 'UNKNOWN_FORM_VERSION' WHEN k.n > 1 THEN 'AMBIGUOUS_FORM_VERSION' ELSE 'BOUND' END AS binding,
      CASE WHEN k.n = 1 THEN registration_id END AS registration_id FROM r LEFT JOIN k USING (form_id, version)""",
)
def d6_bind_form_version(src: Source) -> DataFrame:
    registered = src.view("b_forms").filter(
        "parent_path IS NULL AND path IN ('ECONOMY', 'STANDARD') AND (form_id <> 'form-Brand#3' OR version <> '2')"
    ).select(*FORM, F.col("path").alias("registration_id"))
    responses = src.table("orders").select(
        F.col("o_orderkey").alias("response_id"),
        F.concat(F.lit("form-Brand#"), (F.col("o_custkey") % 30).cast("string")).alias("form_id"),
        (F.col("o_orderkey") % 3).cast("string").alias("version"),
    )
    return forms.bind_form_version(responses, registered, FORM).select("response_id", "binding", "registration_id")


@query(
    "d6_bind_all_groups",
    "b_forms",
    sql="""WITH g AS (SELECT form_id, version, path AS registration_id FROM b_forms WHERE parent_path IS NULL AND (length(path) + length(version || form_id)) % 5 = 0),
    k AS (SELECT form_id, version, count(*) AS n, min(registration_id) AS registration_id FROM g GROUP BY 1, 2),
    r AS (SELECT o_orderkey AS response_id, 'form-Brand#' || (o_custkey % 30) AS form_id, CAST(o_orderkey % 3 AS VARCHAR) AS version FROM orders)
    SELECT response_id, CASE WHEN k.n IS NULL THEN 'UNKNOWN_FORM_VERSION' WHEN k.n > 1 THEN 'AMBIGUOUS_FORM_VERSION' ELSE 'BOUND' END AS binding,
      CASE WHEN k.n = 1 THEN registration_id END AS registration_id FROM r LEFT JOIN k USING (form_id, version)""",
)
def d6_bind_all_groups(src: Source) -> DataFrame:
    """Registrations derived from keys over the groups of all forms; which forms lack one follows from the keys."""
    key = (F.length("path") + F.length(F.concat("version", "form_id"))) % 5
    registered = src.view("b_forms").filter(F.col("parent_path").isNull() & (key == 0)).select(*FORM, F.col("path").alias("registration_id"))
    responses = src.table("orders").select(
        F.col("o_orderkey").alias("response_id"),
        F.concat(F.lit("form-Brand#"), (F.col("o_custkey") % 30).cast("string")).alias("form_id"),
        (F.col("o_orderkey") % 3).cast("string").alias("version"),
    )
    return forms.bind_form_version(responses, registered, FORM).select("response_id", "binding", "registration_id")


@query(
    "d7_search_forms",
    "b_forms",
    sql="""WITH f AS (SELECT DISTINCT form_id, version, 'Form ' || form_family || ' v' || version AS title FROM b_forms)
    SELECT form_id, version, title FROM f WHERE contains(lower(title || ' ' || form_id), 'brand#1') ORDER BY form_id, version""",
)
def d7_search_forms(src: Source) -> DataFrame:
    return forms.search_forms(part_forms(src), "BRAND#1").select("form_id", "version", "title")


@query(
    "d7_form_detail",
    "b_forms",
    sql="""SELECT DISTINCT form_id, version, 'Form ' || form_family || ' v' || version AS title FROM b_forms
      WHERE form_id = 'form-Brand#1' AND version = '1'""",
)
def d7_form_detail(src: Source) -> DataFrame:
    return forms.form_detail(part_forms(src), "form-Brand#1", "1").select("form_id", "version", "title")
