"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalized text is cut at places its content chooses (a pair of characters out of a class), so a
passage shared by many documents gives the same chunks wherever it stands. Chunks are deduplicated
once over the whole corpus to learn which 64-bit chunk hashes name exactly one chunk text; those
hashes are verified identifiers. Documents are then compared by their ordered identifier lists, some
thirty times shorter than the texts. Chunks whose hash names several texts (a few thousand are to be
expected among 10^11 chunks) are compared by their text in addition, so equal lists mean equal texts.

Defined results: a null or empty text, and one of white space only, has the empty recipe, and all of
those are equal. Rows without an id come last among equals. Rows that repeat an id and a text are one
document and share its verdict; ``deduplicate`` returns one row of each group. An empty table gives an
empty table. Other columns are carried inside one struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.session import cut

SPACE = r"[\x20\x09-\x0D]"
MIN_CHARS, MAX_CHARS = 128, 1024



def _cut_class() -> str:
    """Every eighth code point of the Latin blocks may take part in a cut.

    Those of one byte are looked up in a table, the others one by one, so their range is tested first.
    """
    low, high = ("".join(f"\\u{point:04X}" for point in range(first, end, 8)) for first, end in ((0x23, 0x100), (0x103, 0x250)))
    return f"{low}[\\u0100-\\u024F&&[{high}]]"


_CUT_CLASS = _cut_class()
CHUNK = f"(?s).{{{MIN_CHARS - 2},{MAX_CHARS - 2}}}?[{_CUT_CLASS}]{{2}}|.{{1,{MAX_CHARS}}}"


def normalized(text: Column) -> Column:
    """The text that decides equality: white space deleted, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def chunks(normal: Column) -> Column:
    """Content-defined chunks whose concatenation is the text."""
    return F.regexp_extract_all(normal, F.lit(CHUNK), F.lit(0))


# Parts over which the rows of one group of equal texts are dealt.
PARTS = 32


def ambiguous_hashes(docs: DataFrame, text: str, hash_of: Callable[[Column], Column]) -> list[int]:
    """Hashes that name more than one chunk text, from all chunks of all documents.

    About ``chunks ** 2 / 2 ** 65`` values: none up to billions of chunks, some thousand at 100 TB.
    """
    occurrences = docs.select(F.explode(chunks(normalized(F.col(text)))).alias("chunk"))
    distinct = occurrences.distinct().select(hash_of(F.col("chunk")).alias("h"))
    return [row["h"] for row in distinct.groupBy("h").count().filter("count > 1").select("h").collect()]


def _recipe(normal: Column, ambiguous: list[int], hash_of: Callable[[Column], Column]) -> Column:
    """Ordered identifiers, and the texts of those chunks whose hash does not identify them."""
    parts = chunks(normal)
    spelled = F.filter(parts, lambda c: hash_of(c).isin(ambiguous)) if ambiguous else F.array().cast("array<string>")
    return F.struct(F.transform(parts, lambda c: hash_of(c)).alias("ids"), spelled.alias("spelled"))


def exact_groups(
    docs: DataFrame, text: str = "text", id: str = "doc_id", hash_of: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the most code points in its original text stays, then the smallest id.
    The whole texts move once, as distinct chunks; everything after that moves recipes.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    ambiguous = ambiguous_hashes(docs, "text", hash_of)
    normal = docs.withColumn("normal", normalized(F.col("text")))
    recipes = cut(
        normal.select(
            "id",
            F.length(F.coalesce("text", F.lit(""))).alias("points"),
            _recipe(F.col("normal"), ambiguous, hash_of).alias("recipe"),
            F.sha2(F.col("normal"), 256).alias("text_sha256"),
            F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).alias("part"),
        ),
        "recipes",
    )
    best = F.min(F.struct(-F.col("points"), F.col("id").isNull(), F.col("id").alias("id")))
    winners = recipes.groupBy("recipe").agg(best["id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Rows alone in their group need no partner; the winner of a larger group meets its rows in several parts.
    shared = winners.filter("group_size > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return recipes.join(shared, ["recipe", "part"], "left").select(
        F.col("id").alias(id),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.size("recipe.ids").alias("n_chunks"),
    )


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows that stay, exactly one of each group, with the columns they came with.

    The whole row takes part in the minimum, so each task sends at most one row of a group.
    """
    ambiguous = ambiguous_hashes(docs, text, F.xxhash64)
    rows = docs.select(
        F.struct(*[docs[name] for name in docs.columns]).alias("row"),
        _recipe(normalized(F.col(text)), ambiguous, F.xxhash64).alias("recipe"),
        F.struct(
            -F.length(F.coalesce(F.col(text), F.lit(""))), F.col(id).isNull(), F.col(id)
        ).alias("order"),
    )
    return rows.groupBy("recipe").agg(F.min_by("row", "order").alias("row")).select("row.*")
