"""Exact decimal arithmetic beyond one column's scale.

A number is a struct ``(u, scale)``: the whole number ``u`` (38 digits at most) times ten to the minus ``scale``.
Products and sums are exact or null, never rounded: both sides are brought to one scale first, and what needs more
than 38 digits is out of reach.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom.functions.text import strip

WHOLE = "decimal(38,0)"
# Ten to the power of this many needs all digits there are.
MOST_SCALE = 37
_NUMBER = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]{1,4}))?$"


def _power(n: Column) -> Column:
    """Ten to the power of ``n`` as a whole number; null where it has too many digits or ``n`` is negative."""
    return F.when(n.between(0, MOST_SCALE), F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).try_cast(WHOLE))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def number(text: Column) -> Column:
    """The number a text holds, in plain or exponent notation; null where it holds none or too many digits."""
    return let(strip(text), lambda t: let(_parts(t), lambda p: let(_read(p), _scaled)))


def _parts(t: Column) -> Column:
    """Sign, digits before and after the point, and exponent; null where the text is no number."""

    def named(c: Column) -> Column:
        exponent = F.when(c[3] == "", 0).otherwise(c[3].try_cast("int"))
        return F.when(c.isNotNull(), F.struct(c[0].alias("sign"), c[1].alias("whole"), c[2].alias("part"), exponent.alias("exponent")))

    # One pass cuts all four; none of them can hold the separator.
    return let(F.when(t.rlike(_NUMBER) & (t != ""), F.split(F.regexp_replace(t, _NUMBER, "$1,$2,$3,$4"), ",")), named)


def _read(p: Column) -> Column:
    """The digits of a text without zeros at the end of its fraction, and their scale, which may be negative."""
    fraction = F.regexp_replace(p["part"], "0+$", "")
    digits = F.concat(p["whole"], fraction)
    whole = F.concat(p["sign"], F.when(digits == "", "0").otherwise(digits)).try_cast(WHOLE)
    there = F.length(p["whole"]) + F.length(p["part"]) > 0
    return F.struct(F.when(there, whole).alias("u"), (F.length(fraction) - p["exponent"]).alias("scale"))


def _scaled(r: Column) -> Column:
    """A negative scale becomes zeros; zero itself has no scale."""
    raised = F.when(r["scale"] < 0, F.try_multiply(r["u"], _power(-r["scale"]))).otherwise(r["u"])
    unscaled = F.when(r["u"] == 0, r["u"]).otherwise(raised)
    kept = F.when(r["u"] == 0, F.lit(0)).otherwise(F.greatest(r["scale"], F.lit(0)))
    return F.when(unscaled.isNotNull() & (kept <= 2 * MOST_SCALE), F.struct(unscaled.alias("u"), kept.alias("scale")))


def multiply(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: _made(F.try_multiply(p["a"]["u"], p["b"]["u"]).try_cast(WHOLE), p["a"]["scale"] + p["b"]["scale"]))


def add(a: Column, b: Column) -> Column:
    def total(p: Column) -> Column:
        scale = F.greatest(p["a"]["scale"], p["b"]["scale"])

        def raised(x: Column) -> Column:
            # Zero fits any scale.
            return F.when((x["u"] == 0) | (x["scale"] == scale), x["u"]).otherwise(F.try_multiply(x["u"], _power(scale - x["scale"])))

        both = p["a"].isNotNull() & p["b"].isNotNull()
        return _made(F.when(both, F.try_add(raised(p["a"]), raised(p["b"])).try_cast(WHOLE)), scale)

    return let(F.struct(a.alias("a"), b.alias("b")), total)


def _made(u: Column, scale: Column) -> Column:
    return F.when(u.isNotNull(), F.struct(u.alias("u"), scale.alias("scale")))


def plain(value: Column) -> Column:
    """Text without exponent and without zeros at the end of the fraction."""

    def text(v: Column) -> Column:
        # The absolute value of a decimal keeps 34 digits only, its text all of them.
        digits = F.ltrim(v["u"].cast("string"), F.lit("-"))
        padded = let(digits, lambda d: F.lpad(d, F.greatest(F.length(d), v["scale"] + 1), "0"))

        def pointed(p: Column) -> Column:
            whole = p.substr(F.lit(1), F.length(p) - v["scale"])
            fraction = F.when(v["scale"] > 0, p.substr(F.length(p) - v["scale"] + 1, v["scale"])).otherwise("")
            # Zero has no sign.
            return F.concat(F.when(v["u"] < 0, "-").otherwise(""), whole, F.lit("."), fraction)

        return F.when(v.isNotNull(), F.regexp_replace(let(padded, pointed), r"\.?0*$", ""))

    def trimmed(v: Column) -> Column:
        return F.when(v["scale"] > 0, text(v)).otherwise(v["u"].cast("string"))

    return let(value, trimmed)
