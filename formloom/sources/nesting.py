"""How deep the items of documents nest, so that no reader needs a limit of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions.exact import let


# Levels that are read off a document by taking its innermost pairs away.
_PEELED = 6


def _deepest(marks: Column) -> Column:
    """Greatest number of open ``s`` among opening marks ``s`` and ``a`` that ``]`` closes.

    Taking away all innermost pairs of ``s`` takes one level off. What is not gone after some levels (deeper, arrays
    in arrays in arrays, or marks that do not pair) is walked mark by mark.
    """

    def bare(rest: Column) -> Column:
        return F.replace(F.replace(rest, F.lit("a]"), F.lit("")), F.lit("a]"), F.lit(""))

    def peeled(rest: Column, level: int) -> Column:
        if level > _PEELED:
            return F.lit(None).cast("int")
        below = lambda r: F.when(~F.contains(r, F.lit("a]")), peeled(F.replace(r, F.lit("s]"), F.lit("")), level + 1))
        return let(bare(rest), lambda r: F.when(r == "", F.lit(level)).otherwise(below(r)))

    return let(marks, lambda m: F.coalesce(peeled(m, 0), _walked(m)))


def _walked(marks: Column) -> Column:
    """The same, mark by mark."""
    state = F.struct(F.lit("").alias("open"), F.lit(0).alias("most"))

    def step(s: Column, mark: Column) -> Column:
        kept = F.when(mark == "]", F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)).otherwise(F.concat(s["open"], mark))
        here = F.length(F.regexp_replace(kept, "a", ""))
        return F.struct(kept.alias("open"), F.greatest(s["most"], here).alias("most"))

    return F.aggregate(F.filter(F.split(marks, ""), lambda m: m != ""), state, step, lambda s: s["most"])


def json_levels(content: Column, key: str) -> Column:
    """Levels of arrays under ``key`` that lie inside one another."""
    opened = F.regexp_replace(content, rf'"{key}"\s*:\s*\[', "\x01")
    bare = F.regexp_replace(opened, r'"(?:[^"\\]++|\\.)*+"', "")
    marks = F.regexp_replace(bare, r"[^\x01\[\]]", "")
    return _deepest(F.translate(marks, "\x01[", "sa"))


def xml_levels(content: Column, tag: str) -> Column:
    """Levels of elements of that name inside one another."""
    tags = F.regexp_extract_all(content, F.lit(rf"""<{tag}(?=[\s>/])(?:[^<>"']|"[^"]*"|'[^']*')*>|</{tag}\s*>"""), F.lit(0))
    paired = F.transform(tags, lambda t: F.when(t.startswith("</"), "]").when(t.endswith("/>"), "s]").otherwise("s"))
    return _deepest(F.array_join(paired, ""))


def levels_of(documents: DataFrame, levels: Column) -> int:
    """The most levels of any document, at least one; a single number comes to the driver."""
    return max(documents.agg(F.max(levels)).first()[0] or 1, 1)
