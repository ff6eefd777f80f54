"""Unicode-aware text helpers; Spark's own one-argument ``trim`` only removes the plain space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space in text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one space, none remain at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WHITE_SPACE}]+", " "))


def fold(text: Column) -> Column:
    """Comparison form: stripped and lower-cased."""
    return F.lower(strip(text))
