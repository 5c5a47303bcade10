"""All registered queries of the engine and their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(name: str, sql: str | None = None):
    """Register a query under ``name``, with SQL that gives the same rows where there is some."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def shared_sql(name: str, sql: str, tables: str, duck: str | None = None) -> None:
    """A query whose text both engines run; ``duck`` where the other engine spells it differently."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessera.session import Engine

        views(spark, sf_dir, *tables.split())
        return Engine(spark).sql(sql)

    register(name, duck or sql)(run)


# the modules register their queries
from . import queries_events, queries_functions, queries_incremental, queries_lake, queries_relational, queries_sql, queries_statements  # noqa: E402, F401
