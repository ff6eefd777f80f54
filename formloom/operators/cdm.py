"""Constraints of the common data model, all checked at once.

The model's field list is a parameter: the published field-level CSV, the published DDL files, or the fields of
the tables this package fills. Rows of all tables are unpivoted into (role, target, constraint, value) entries:
a value used by a reference, a value offered by a key, a null where none may be. They are counted per distinct
entry on the map side, then uses and keys meet by (target, value). However many references there are, that is
two shuffles, and a value used by every row is one entry per task.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.operators import omop

CATALOG = "table string, column string, data_type string, required boolean, primary_key boolean, references_table string, references_column string"


class Field(NamedTuple):
    """One field of the model."""

    table: str
    column: str
    data_type: str
    required: bool = False
    primary_key: bool = False
    references_table: str | None = None
    references_column: str | None = None


def filled_fields() -> list[Field]:
    """The fields of the tables this package fills."""
    references = {(t, c): (rt, rc) for t, c, rt, rc in omop.foreign_keys()}
    found = []
    for table in omop.CDM_COLUMNS:
        for f in omop.cdm_schema(table):
            target = references.get((table, f.name), (None, None))
            found.append(Field(table, f.name, f.dataType.simpleString(), not f.nullable, f.name == f"{table}_id", *target))
    return found


_NAME = r'"?(\w+)"?'
_TABLE = r"(?:[@\w]+\.)?" + _NAME


def read_ddl(spark: SparkSession, *paths: str) -> DataFrame:
    """Catalog (one row per field) of published DDL files: tables, primary keys and references, in any order.

    Statements end with a semicolon. What is no table, key or reference is passed over.
    """
    # A comment ends with its line.
    text = F.regexp_replace("value", r"--[^\n]*", " ")
    clean = spark.read.text(list(paths), wholetext=True).select(F.explode(F.split(text, ";")).alias("s"))
    create = rf"(?is)^\s*CREATE\s+TABLE\s+{_TABLE}\s*\((.*)\)\s*$"
    alter = rf"(?is)^\s*ALTER\s+TABLE\s+{_TABLE}\s+ADD\s+CONSTRAINT\s+\w+\s+"
    key = alter + rf"PRIMARY\s+KEY\s*\(\s*{_NAME}\s*\)"
    reference = alter + rf"FOREIGN\s+KEY\s*\(\s*{_NAME}\s*\)\s*REFERENCES\s+{_TABLE}\s*\(\s*{_NAME}\s*\)"

    def part(pattern: str, group: int) -> Column:
        return F.lower(F.regexp_extract("s", pattern, group))

    # Commas inside parentheses belong to a type.
    lines = clean.filter(F.col("s").rlike(create)).select(part(create, 1).alias("table"), F.explode(F.split(part(create, 2), r",(?![^(]*\))")).alias("line"))
    line = rf"(?s)^\s*{_NAME}\s+(\w+)"
    fields = lines.select(
        "table", F.regexp_extract("line", line, 1).alias("column"), F.regexp_extract("line", line, 2).alias("data_type"),
        F.col("line").rlike(r"not\s+null").alias("required"),
    ).filter("column <> ''")
    keys = clean.filter(F.col("s").rlike(key)).select(part(key, 1).alias("table"), part(key, 2).alias("column"), F.lit(True).alias("primary_key"))
    references = clean.filter(F.col("s").rlike(reference)).select(
        part(reference, 1).alias("table"), part(reference, 2).alias("column"),
        part(reference, 3).alias("references_table"), part(reference, 4).alias("references_column"),
    )
    joined = fields.join(keys, ["table", "column"], "left").join(references, ["table", "column"], "left")
    return joined.withColumn("primary_key", F.coalesce("primary_key", F.lit(False))).select(*[c.split(" ")[0] for c in CATALOG.split(", ")])


def fields_of(catalog: DataFrame) -> list[Field]:
    """The fields of a catalog; their number depends on the model alone."""
    names = [c.split(" ")[0] for c in CATALOG.split(", ")]
    return [Field(*row) for row in catalog.select(*names).orderBy("table", "column").collect()]


# Type names of the published model by the kind of value they hold.
KINDS = {
    "integer": ("integer", "int", "bigint", "smallint", "tinyint"),
    "number": ("numeric", "float", "double", "decimal", "real"),
    "text": ("varchar", "text", "string", "char"),
    "date": ("date",),
    "moment": ("timestamp", "datetime"),
}


def kind_of(data_type: str) -> str:
    name = data_type.lower().split("(")[0]
    return next((kind for kind, names in KINDS.items() if name in names), name)


def schema_findings(fields: list[Field], table: str, schema: T.StructType) -> list[tuple[str, str, str]]:
    """(finding, column, detail) of a schema against the model; to be asked before a table is conformed to it."""
    want = {f.column: f for f in fields if f.table == table}
    have = {f.name.lower(): f.dataType.simpleString() for f in schema}
    if not want:
        return [("UNKNOWN_TABLE", "", table)]
    found = [("MISSING_REQUIRED" if f.required else "MISSING_OPTIONAL", name, f.data_type) for name, f in want.items() if name not in have]
    found += [("UNEXPECTED", name, have[name]) for name in have if name not in want]
    found += [
        ("TYPE", name, f"{have[name]} instead of {f.data_type}")
        for name, f in want.items()
        if name in have and kind_of(have[name]) != kind_of(f.data_type)
    ]
    return sorted(found)


def unchecked_references(tables: dict[str, DataFrame], fields: list[Field]) -> list[tuple[str, str]]:
    """References of the given tables whose target table was not given."""
    return [(f.table, f.column) for f in fields if f.table in tables and f.references_table and f.references_table not in tables]


def constraint_entries(tables: dict[str, DataFrame], fields: list[Field]) -> DataFrame:
    """(role, target, constraint, value): what every row uses, offers and lacks."""
    offered = {(f.references_table, f.references_column) for f in fields if f.references_table}
    parts = []
    for name, df in tables.items():
        present = {c.lower(): c for c in df.columns}
        entries = []
        for f in fields:
            if f.table != name or f.column not in present:
                continue
            value, here = F.col(present[f.column]).cast("string"), F.lit(f"{name}.{f.column}")
            nothing = F.lit(None).cast("string")

            def entry(role: str, target: Column, text: Column) -> Column:
                return F.struct(F.lit(role).alias("role"), target.alias("target"), here.alias("constraint"), text.alias("value"))

            if f.primary_key or (name, f.column) in offered:
                entries.append(entry("PRIMARY_KEY" if f.primary_key else "OFFERED", here, value))
            if f.references_table in tables:
                target = F.lit(f"{f.references_table}.{f.references_column}")
                entries.append(F.when(value.isNotNull(), entry("REFERENCE", target, value)))
            if f.required and not f.primary_key:
                entries.append(F.when(value.isNull(), entry("NOT_NULL", here, nothing)))
        if entries:
            parts.append(df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*"))
    return reduce(DataFrame.unionAll, parts)


def check_constraints(tables: dict[str, DataFrame], fields: list[Field]) -> DataFrame:
    """(kind, table, column, value, rows) of every breach: keys that are null or repeat, references to nothing,
    nulls in required columns."""
    counted = constraint_entries(tables, fields).groupBy("target", "value", "role", "constraint").agg(F.count(F.lit(1)).alias("rows"))
    # At most one entry per constraint of the model meets in a group.
    met = counted.groupBy("target", "value").agg(
        F.collect_list(F.struct("role", "constraint", "rows")).alias("all"), F.max(F.col("role").isin("PRIMARY_KEY", "OFFERED")).alias("known")
    )
    wrong = F.filter(
        "all",
        lambda e: (e["role"] == "NOT_NULL")
        | ((e["role"] == "REFERENCE") & ~F.col("known"))
        | ((e["role"] == "PRIMARY_KEY") & (F.col("value").isNull() | (e["rows"] > 1))),
    )
    return met.select("value", F.explode(wrong).alias("e")).select(
        F.col("e.role").alias("kind"),
        F.substring_index("e.constraint", ".", 1).alias("table"),
        F.substring_index("e.constraint", ".", -1).alias("column"),
        "value",
        F.col("e.rows").alias("rows"),
    )
