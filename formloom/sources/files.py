"""Raw evidence objects and vocabulary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The header of each vocabulary file.
VOCABULARY_FILES = {
    "DOMAIN.csv": ("domain_id", "domain_name", "domain_concept_id"),
    "VOCABULARY.csv": (
        "vocabulary_id",
        "vocabulary_name",
        "vocabulary_reference",
        "vocabulary_version",
        "vocabulary_concept_id",
    ),
    "CONCEPT_CLASS.csv": ("concept_class_id", "concept_class_name", "concept_class_concept_id"),
    "CONCEPT.csv": (
        "concept_id",
        "concept_name",
        "domain_id",
        "vocabulary_id",
        "concept_class_id",
        "standard_concept",
        "concept_code",
        "valid_start_date",
        "valid_end_date",
        "invalid_reason",
    ),
}
OPTIONAL_VALUES = {"vocabulary_reference", "vocabulary_version", "standard_concept", "invalid_reason"}


def read_evidence(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(object_key, size, checksum_sha256, modified_at) of every raw object below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.col("path").alias("object_key"),
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("checksum_sha256"),
        F.col("modificationTime").alias("modified_at"),
    )


def _is_integer(column: str) -> bool:
    return column == "concept_id" or column.endswith("_concept_id")


def _is_date(column: str) -> bool:
    return column.endswith("_date")


def _date(value: Column) -> Column:
    """Compact or ISO date, else null."""
    compact = F.when(value.rlike(r"^[0-9]{8}$"), F.try_to_date(value, "yyyyMMdd"))
    iso = F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(value, "yyyy-MM-dd"))
    return F.coalesce(compact, iso)


def read_vocabulary(spark: SparkSession, directory: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, errors)`` of one tab-separated vocabulary file.

    The header of every part file must match exactly (a byte order mark is allowed). Rows with a missing required
    value, a malformed integer or date, or too many fields become errors naming the column.
    """
    columns = VOCABULARY_FILES[name]
    path = f"{directory.rstrip('/')}/{name}"
    reader = spark.read.option("sep", "\t").option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    wrong = wrong_headers(reader, path, columns)
    if wrong:
        raise ValueError(f"{name}: header {wrong[0]['found']} of {wrong[0]['file']} instead of {columns}")
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _corrupt string"
    raw = (
        reader.option("header", "true")
        .option("enforceSchema", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .schema(schema)
        .csv(path)
    )
    return type_vocabulary(raw, name)


def wrong_headers(reader, path: str, columns: tuple[str, ...]) -> list:
    """Up to five (file, found) whose first line is not the header; a snapshot may come in several part files.

    The first line is the first row of the split that starts a file; splits are read in order by one task each.
    """
    names = [f"c{i}" for i in range(len(columns) + 1)]
    rows = reader.option("header", "false").schema(", ".join(f"{n} string" for n in names)).csv(path)
    starts = rows.select(
        F.array(*names).alias("found"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    ).filter("start = 0")
    firsts = starts.groupBy("file").agg(F.min_by("found", "at").alias("found"))
    clean = F.transform("found", lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), "^\ufeff", ""))
    want = F.array(*[F.lit(c) for c in columns], F.lit(""))
    return firsts.select("file", clean.alias("found")).filter(F.col("found") != want).orderBy("file").limit(5).collect()


def type_vocabulary(raw: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, errors)`` of string rows of a vocabulary file."""
    columns = VOCABULARY_FILES[name]
    trimmed = raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in columns], *[c for c in raw.columns if c == "_corrupt"])
    typed, problems = [], []
    for c in columns:
        value = F.col(c)
        if _is_integer(c):
            number = F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))
            typed.append(number.alias(c))
            problems.append(F.when(value.isNotNull() & number.isNull(), F.lit(f"invalid_integer:{c}")))
        elif _is_date(c):
            typed.append(_date(value).alias(c))
            problems.append(F.when(value.isNotNull() & _date(value).isNull(), F.lit(f"invalid_date:{c}")))
        else:
            typed.append(value.alias(c))
        if c not in OPTIONAL_VALUES:
            problems.append(F.when(value.isNull(), F.lit(f"empty_value:{c}")))
    if "_corrupt" in raw.columns:
        problems.insert(0, F.when(F.col("_corrupt").isNotNull(), F.lit("wrong_field_count")))
    checked = trimmed.withColumn("error", F.coalesce(*problems))
    rows = checked.filter("error IS NULL").select(*typed)
    errors = checked.filter("error IS NOT NULL").select(F.lit(name).alias("file"), F.col(columns[0]).alias("key"), "error")
    return rows, errors
