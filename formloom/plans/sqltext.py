"""Fragments of checking SQL shared by several queries (DuckDB dialect)."""

from __future__ import annotations

from formloom.functions.identity import NAMESPACE_HEX


def sql_uuid(kind: str, *parts: str) -> str:
    """SQL for the name-based identifier of ``kind`` over SQL expressions."""
    text = " || ".join([f"'{kind}'"] + [f"chr(31) || CAST({p} AS VARCHAR)" for p in parts])
    digest = f"sha1(unhex('{NAMESPACE_HEX}') || encode({text}))"
    return (
        f"(substr({digest},1,8) || '-' || substr({digest},9,4) || '-5' || substr({digest},14,3) "
        f"|| '-' || translate(substr({digest},17,1),'0123456789abcdef','89ab89ab89ab89ab') "
        f"|| substr({digest},18,3) || '-' || substr({digest},21,12))"
    )


def sql_fact_id(identifier: str) -> str:
    return f"(CAST('0x' || substr({identifier},1,8) AS BIGINT) % 2000000000 + 1)"


def sql_bag(row_hash: str) -> str:
    """SQL of the order-free digest of a bag of SHA-256 hex strings."""
    lanes = " || ':' || ".join(
        f"CAST(coalesce(sum(CAST('0x' || substr({row_hash},{start},15) AS BIGINT)),0) AS VARCHAR)"
        for start in (1, 16, 31, 46)
    )
    return f"sha256({lanes} || ':' || CAST(count({row_hash}) AS VARCHAR))"


def sql_ratio(numerator: str, denominator: str) -> str:
    """Half-even ratio to four places as DOUBLE, from exact integers."""
    a, b = f"(CAST({numerator} AS HUGEINT) * 10000)", f"nullif(CAST({denominator} AS HUGEINT), 0)"
    return (
        f"(({a} // {b} + CASE WHEN 2 * ({a} % {b}) > {b} OR (2 * ({a} % {b}) = {b} "
        f"AND ({a} // {b}) % 2 = 1) THEN 1 ELSE 0 END) / 10000.0)"
    )
