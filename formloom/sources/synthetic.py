"""Arithmetic test data: every row is a function of its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTITION_ROWS = 50_000
# The cycles the generated answers run through.
STATE_CYCLE = (
    "PRESENT",
    "EXPLICITLY_ABSENT",
    "UNKNOWN",
    "NOT_RECORDED",
    "NOT_APPLICABLE",
    "NOT_DISPLAYED_BY_FORM_LOGIC",
)
PUBLISHED_STATES = 3
UNIT_CYCLE = ("none", "kg", "mm[Hg]", "Cel")
SITES = ("site-a", "site-b", "site-c", "site-d")
SITE_ROWS = 50_000
# Fixed value: first half of every event key.
EVENT_KEY_HEAD = "6BA7B8119DAD51D1"


def _cycle(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _div(column: Column, by: int) -> Column:
    return F.call_function("div", column, F.lit(by))


def synthetic_patients(numbers: DataFrame, seed: int, number: str = "id") -> DataFrame:
    """Patients from row numbers: id, birth year and site depend on number and seed only."""
    n = F.col(number)
    return numbers.select(
        F.lit(True).alias("synthetic"),
        F.format_string(f"synthetic-{seed}-%06d", n).alias("patient_id"),
        (F.lit(1940) + (n * 17 + seed) % 70).cast("int").alias("birth_year"),
        _cycle(SITES, n).alias("site"),
    )


def synthetic_answers(numbers: DataFrame, partition_rows: int = PARTITION_ROWS, number: str = "id") -> DataFrame:
    """Answer events from row numbers; only present answers carry a number."""
    n = F.col(number)
    key = F.unhex(F.concat(F.lit(EVENT_KEY_HEAD), F.lpad(F.hex(n), 16, "0")))
    return numbers.select(
        key.alias("clinical_event_id"),
        _div(n, 20).alias("patient_number"),
        (n % 20).cast("smallint").alias("item_code"),
        _cycle(STATE_CYCLE, n).alias("answer_state"),
        F.when(n % len(STATE_CYCLE) == 0, (n % 4000) / 10).alias("value_as_number"),
        _cycle(UNIT_CYCLE, _div(n, 5)).alias("unit"),
        _cycle(SITES, _div(n, SITE_ROWS)).alias("establishment"),
        _div(n, partition_rows).cast("int").alias("partition"),
    )


def decision_of(state: Column) -> Column:
    """Publication decision of a generated answer: the first three states are published."""
    return F.when(state.isin(*STATE_CYCLE[:PUBLISHED_STATES]), "PUBLISH").otherwise("OMIT")
