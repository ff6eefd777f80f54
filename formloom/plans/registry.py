"""Registry of the queries that are checked against SQL on the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from formloom.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@dataclass(frozen=True)
class Source:
    """The driver tables of one scale-factor folder and the bridge views over them."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table with its rows dealt evenly: a file read in one or two pieces may hold what grows into many documents."""
        return self.dealt(self.table(name))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """The rows dealt evenly over the tasks of a shuffle."""
        tasks = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return rows.repartition(tasks)

    def view(self, name: str) -> DataFrame:
        from formloom.plans.bridge import SPARK_VIEWS, VIEWS

        return self.sql(SPARK_VIEWS.get(name, VIEWS[name]))

    def sql(self, text: str) -> DataFrame:
        """SQL in which ``{orders}`` stands for the driver table of that name."""
        used = {name: self.table(name) for name in TABLES if "{" + name + "}" in text}
        return self.spark.sql(text, **used)


Query = Callable[[Source], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, *views: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may refer to the listed bridge views by name."""

    def register(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = (function, _oracle(views, sql) if sql else None)
        return function

    return register


def _oracle(views: tuple[str, ...], sql: str) -> str:
    from formloom.plans.bridge import VIEWS

    body = sql.strip()
    if not views:
        return body
    plain = {name: name for name in TABLES}
    with_views = ", ".join(f"{name} AS ({VIEWS[name].format(**plain).strip()})" for name in views)
    for keyword in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(keyword):
            return f"{keyword}{with_views}, {body[len(keyword):]}"
    return f"WITH {with_views} {body}"


def load() -> None:
    """Import every module that registers queries."""
    from formloom.plans import (  # noqa: F401
        answers,
        catalog,
        documents,
        forms,
        identity,
        intake,
        lineage,
        omop,
        releases,
        sources,
        streams,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(function: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: function(Source(configure(spark), folder.rstrip("/")))

    return {name: bind(function) for name, (function, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
