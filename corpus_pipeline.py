"""Corpus pipeline: language ID, exact dedup, near-duplicate join, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return
the columns of documents. ``run`` writes every stage as Parquet in the shared folder and reads it again.

Edge cases are those of the operators: nulls, empty texts, ties, repeated rows, empty tables and extra
columns with clashing names are allowed in every stage. A text without letters, or one that is unlike the
texts of every learned language, goes in the first stage; of equal texts one row stays; of a group of near
duplicates (five words, similarity 0.8) the row of its smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm import exact_dedup, language_id, ngram_join, packing
from formloom.llm.queries import tokenizer_path
from formloom.session import cut

# Texts count as near duplicates from this Jaccard similarity of their shingles of five words.
NEAR = ngram_join.Setting(words=5, percent=80)
# How unlike its language a text may be; wide, so that clean texts with odd passages stay.
UNLIKE = language_id.Margin(nats=1.5, deviations=4.0)

_ROW = "_near_row"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are like texts of a language, learned from the labels of all rows."""
    predicted = language_id.predict(docs, language_id.fit(docs))
    return predicted.filter(language_id.typical(UNLIKE)).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, a null id being the last."""
    # Whole texts: a third smaller than with the default codec.
    rows = cut(docs.withColumn(_ROW, F.monotonically_increasing_id()), "near-rows", codec="zstd")
    classes = ngram_join.row_classes(rows.select(F.col(_ROW).alias("id"), "text"), NEAR)
    own = rows.select(F.col(_ROW).alias("id"), F.col("doc_id").cast("long").alias("doc"))
    placed = cut(classes.join(own, "id").select("id", "doc", "component_id"), "near-placed")
    first = F.min(F.struct(F.col("doc").isNull(), "doc", "id")).alias("first")
    kept = placed.groupBy("component_id").agg(first).select(F.col("first.id").alias(_ROW))
    return rows.join(kept, _ROW, "left_semi").select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of one length, as pieces of documents."""
    return packing.pack_texts(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# Model scores and token ids cannot be computed in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None
