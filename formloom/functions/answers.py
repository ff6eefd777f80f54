"""Answer states, tagged scalar values, coercion and display conditions as column expressions.

A scalar answer is a struct ``(t, s, num)``: the tag (``str``, ``num``, ``bool``, ``date``, ``ts``),
its text form, and its number where it has one (booleans count as 0 and 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom.functions import exact
from formloom.functions.text import fold, strip

SCALAR = "struct<t:string,s:string,num:decimal(38,9)>"
NUMBER = "decimal(38,9)"


def _long(text: Column) -> Column:
    """Whether a text has more decimals than that, or an exponent; the pattern is only tried where it could fit."""
    return ((F.length(text) > 10) & text.rlike(r"\.[0-9]{10}")) | text.contains("e") | text.contains("E")


# State names, lexicons and lifecycle names exchanged with other systems.
STATES = (
    "PRESENT",
    "EXPLICITLY_ABSENT",
    "UNKNOWN",
    "NOT_RECORDED",
    "NOT_APPLICABLE",
    "NOT_DISPLAYED_BY_FORM_LOGIC",
    "INVALID",
    "VOIDED",
    "SUPERSEDED",
    "DELETED",
)
LIFECYCLE = ("DRAFT", "SIGNED", "CORRECTED", "VOIDED", "DELETED")
NEGATIVE_WORDS = ("false", "non", "no")
UNKNOWN_WORDS = ("unknown", "inconnu")
NOT_APPLICABLE_WORDS = ("n/a", "not-applicable")
DATA_TYPES = (
    "boolean",
    "integer",
    "decimal",
    "string",
    "text",
    "date",
    "datetime",
    "coding",
    "group",
)
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "exists")


def answer_state(
    present: Column,
    enabled: Column,
    raw_text: Column,
    lifecycle: Column,
    *,
    negative: tuple[str, ...] = NEGATIVE_WORDS,
    unknown: tuple[str, ...] = UNKNOWN_WORDS,
    not_applicable: tuple[str, ...] = NOT_APPLICABLE_WORDS,
) -> Column:
    """Explicit state of one answer; lifecycle wins over form logic, which wins over the value.

    Only a null or an exactly empty text is "not recorded": blanks are an answer.
    """
    words = {w: state for state, those in (("NOT_APPLICABLE", not_applicable), ("UNKNOWN", unknown), ("EXPLICITLY_ABSENT", negative)) for w in those}
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair]).cast("map<string,string>")
    return (
        F.when(lifecycle == "DELETED", F.lit("DELETED"))
        .when(lifecycle == "VOIDED", F.lit("VOIDED"))
        .when(lifecycle == "DRAFT", F.lit("NOT_RECORDED"))
        .when(~enabled, F.lit("NOT_DISPLAYED_BY_FORM_LOGIC"))
        .when(~present | raw_text.isNull() | (raw_text == ""), F.lit("NOT_RECORDED"))
        # One look at the folded text tells all words apart.
        .otherwise(F.coalesce(F.try_element_at(known, fold(raw_text)), F.lit("PRESENT")))
    )


def scalar(tag: Column, text: Column, number: Column | None = None) -> Column:
    num = F.lit(None).cast(NUMBER) if number is None else number.cast(NUMBER)
    return F.struct(tag.alias("t"), text.alias("s"), num.alias("num"))


def text_scalar(text: Column) -> Column:
    """A text answer, or null."""
    return F.when(text.isNotNull(), scalar(F.lit("str"), text))


def number_scalar(number: Column) -> Column:
    value = number.cast(NUMBER)
    return F.when(value.isNotNull(), scalar(F.lit("num"), value.cast("string"), value))


def exact_scalar(value: Column) -> Column:
    """A number of ``exact`` as a scalar. Up to nine decimals its text has all nine; with more, as many as it needs,
    and the number column is rounded. Null where the number column cannot hold its size.
    """


    def made(n: Column) -> Column:
        shown = F.when(_long(n["text"]), n["text"]).otherwise(n["rounded"].cast("string"))
        return F.when(n["rounded"].isNotNull(), scalar(F.lit("num"), shown, n["rounded"]))

    return exact.let(exact.plain(value), lambda text: exact.let(F.struct(text.alias("text"), text.try_cast(NUMBER).alias("rounded")), made))


def plain_number(number: Column) -> Column:
    """Decimal as text without trailing zeros: 12.500000000 becomes 12.5."""
    text = number.cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")
    return F.when(text.contains("."), trimmed).otherwise(text)


def parse_number(text: Column) -> Column:
    """Finite decimal from text, else null. Only a text that is none as it stands is stripped first."""
    return F.coalesce(text.try_cast(NUMBER), strip(text).try_cast(NUMBER))


def coerce(raw_type: Column, raw_text: Column, data_type: Column, number: Column | None = None) -> Column:
    """Typed scalar of a raw JSON value, null where it does not fit the declared type.

    ``raw_type`` is ``str``, ``num`` or ``bool``. Callers tell a rejected value from a missing one
    by comparing the result with ``raw_text``. ``number`` is the ``parse_number`` of the text where the
    caller has it in a column, so that it is read once; it is only looked at for numeric types.
    """
    is_bool, is_num, is_str = (raw_type == tag for tag in ("bool", "num", "str"))
    lowered = F.lower(raw_text)
    number = parse_number(raw_text) if number is None else number
    # Only what the number column would round takes the longer way.
    precise = F.when(_long(raw_text), exact_scalar(exact.number(raw_text))).otherwise(number_scalar(number))
    null = F.lit(None).cast(SCALAR)

    boolean = F.when(
        (is_bool | is_str) & lowered.isin("true", "false"),
        scalar(F.lit("bool"), lowered, F.when(lowered == "true", 1).otherwise(0)),
    )
    integral = (is_str & strip(raw_text).rlike(r"^[+-]?[0-9]+$")) | (
        is_num & (number == F.floor(number)) & ~raw_text.rlike(r"\.[0-9]*[1-9]|[eE]-")
    )
    # Where 38 digits do not hold a text's decimals it is rejected rather than rounded.
    integer = F.when(integral & number.isNotNull(), precise)
    decimal = F.when((is_num | is_str) & number.isNotNull(), precise)
    text = F.when(is_str, text_scalar(raw_text))
    compact = F.when(raw_text.rlike(r"^[0-9]{8}$"), F.try_to_date(raw_text, "yyyyMMdd"))
    dashed = F.when(
        raw_text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(raw_text, "yyyy-MM-dd")
    )
    day = F.coalesce(compact, dashed)
    date = F.when(is_str & day.isNotNull(), scalar(F.lit("date"), day.cast("string")))
    zoned = raw_text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ].*(Z|[+-][0-9]{2}:?[0-9]{2})$")
    instant = F.when(zoned, raw_text.try_cast("timestamp"))
    moment = F.when(is_str & instant.isNotNull(), scalar(F.lit("ts"), instant.cast("string")))
    return (
        F.when(raw_text.isNull(), null)
        .when(data_type == "boolean", boolean)
        .when(data_type == "integer", integer)
        .when(data_type == "decimal", decimal)
        .when(data_type.isin("string", "text", "coding"), text)
        .when(data_type == "date", date)
        .when(data_type == "datetime", moment)
        .otherwise(null)
    )


def condition_holds(actual: Column, operator: Column, expected: Column) -> Column:
    """One display condition over two tagged scalars; never null.

    Equality compares numbers with numbers (booleans included) and texts with texts of the same
    tag. Ordering reads both sides as decimals and is false where either is not one.
    """
    has = actual.isNotNull()
    numeric = actual["t"].isin("num", "bool") & expected["t"].isin("num", "bool")
    same_tag = actual["t"] == expected["t"]
    # Texts of numbers are exact where they have more decimals than the number column.
    longer = (actual["t"] == "num") & (expected["t"] == "num") & (_long(actual["s"]) | _long(expected["s"]))
    alike = F.when(longer, exact.plain(exact.number(actual["s"])).eqNullSafe(exact.plain(exact.number(expected["s"])))).otherwise(F.lit(True))
    equal = F.when(numeric, (actual["num"] == expected["num"]) & alike).otherwise(
        same_tag & (actual["s"] == expected["s"])
    )
    left = F.when(actual["t"] != "bool", F.coalesce(actual["num"], parse_number(actual["s"])))
    right = F.when(expected["t"] != "bool", F.coalesce(expected["num"], parse_number(expected["s"])))
    result = (
        F.when(operator == "exists", has == (expected["num"] == 1))
        .when(~has, F.lit(False))
        .when(operator == "eq", equal)
        .when(operator == "ne", ~equal)
        .when(operator == "gt", left > right)
        .when(operator == "gte", left >= right)
        .when(operator == "lt", left < right)
        .when(operator == "lte", left <= right)
    )
    return F.coalesce(result, F.lit(False))
