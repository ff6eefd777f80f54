"""Positions and running totals over a total order, without a single-task window.

A window partitioned by a hot key (or by nothing) puts that whole group into one task. Here rows
are range-partitioned on the order instead, so a group of any size spreads over many tasks; only
one row per range partition is combined in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.session import cut

_ROW_BITS = 33


def _ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Sorted rows with ``_part`` and ``_row``; written once because both depend on the partition."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = cut(ordered.withColumn("_mid", F.monotonically_increasing_id()), "ranged")
    return tagged.withColumn("_part", F.shiftright("_mid", _ROW_BITS)).withColumn(
        "_row", F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)
    )


def _before(per_part: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Running measures of all earlier range partitions; one row per partition goes in and out."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", *[m.over(earlier).alias(name) for name, m in measures.items()])


def global_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """Adds the 0-based position in the total order given by ``order``."""
    rows = _ranged(df, list(order))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _before(sizes, {"_start": F.sum("_n")})
    # As many rows as range partitions, so the broadcast side is bounded by the shuffle width.
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.coalesce("_start", F.lit(0)) + F.col("_row"))
        .drop("_mid", "_part", "_row", "_start")
    )


def group_index(
    df: DataFrame, keys: list[str], *order: Column | str, name: str = "idx"
) -> DataFrame:
    """Adds the 0-based position inside each key group; ``keys`` and ``order`` form a total order."""
    if not keys:
        return global_index(df, *order, name=name)
    indexed = cut(global_index(df, *keys, *order, name="_global"), "indexed")
    starts = indexed.groupBy(*keys).agg(F.min("_global").alias("_first"))
    return null_safe_join(indexed, starts, keys, "inner").withColumn(
        name, F.col("_global") - F.col("_first")
    ).drop("_global", "_first")


def previous_row(df: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """Adds ``prev_<column>`` of the preceding row of the same group, null at its start."""
    indexed = cut(group_index(df, keys, *order, name="_pos"), "positions")
    shifted = indexed.select(
        *keys, (F.col("_pos") + 1).alias("_pos"), *[F.col(c).alias(f"prev_{c}") for c in carry]
    )
    return null_safe_join(indexed, shifted, [*keys, "_pos"], "left").drop("_pos")


def running(
    df: DataFrame,
    order: list[Column | str],
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
    index: str | None = None,
) -> DataFrame:
    """Adds running sums and maxima (``{new: source}``) over a total order, current row included."""
    sums, maxima = sums or {}, maxima or {}
    rows = _ranged(df, order)
    local = Window.partitionBy("_part").orderBy("_mid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    per_part = rows.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(source).alias(f"_s_{new}") for new, source in sums.items()],
        *[F.max(source).alias(f"_m_{new}") for new, source in maxima.items()],
    )
    carry = _before(
        per_part,
        {"_start": F.sum("_n")}
        | {f"_s_{new}": F.sum(f"_s_{new}") for new in sums}
        | {f"_m_{new}": F.max(f"_m_{new}") for new in maxima},
    )
    out = rows.join(F.broadcast(carry), "_part")
    for new, source in sums.items():
        out = out.withColumn(
            new, F.sum(source).over(local) + F.coalesce(F.col(f"_s_{new}"), F.lit(0))
        )
    for new, source in maxima.items():
        out = out.withColumn(new, F.greatest(F.max(source).over(local), F.col(f"_m_{new}")))
    if index:
        out = out.withColumn(index, F.coalesce("_start", F.lit(0)) + F.col("_row"))
    helpers = [c for c in out.columns if c in {"_mid", "_part", "_row", "_start"}]
    helpers += [f"_s_{new}" for new in sums] + [f"_m_{new}" for new in maxima]
    return out.drop(*helpers)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where null meets null; keys are kept once, from the left."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def block_ordinal(
    df: DataFrame, keys: list[str], position: str, name: str, block: int = 65_536
) -> DataFrame:
    """0-based ordinal inside each key group by an integer ``position`` unique in the group.

    Positions are cut into blocks: rows are numbered inside a block of at most ``block`` rows and
    shifted by the counts of earlier blocks, so a group is never numbered by one task.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / F.lit(block)).cast("bigint"))
    inside = Window.partitionBy(*keys, "_block").orderBy(position)
    numbered = blocked.withColumn("_rank", F.row_number().over(inside) - 1)
    if blocked.filter("_block <> 0 OR _block IS NULL").isEmpty():
        # No group goes beyond its first block, so nothing has to be shifted.
        return numbered.withColumn(name, F.col("_rank").cast("bigint")).drop("_block", "_rank")
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return (
        null_safe_join(numbered, starts, [*keys, "_block"], "inner")
        .withColumn(name, F.col("_start") + F.col("_rank"))
        .drop("_block", "_rank", "_start")
    )
