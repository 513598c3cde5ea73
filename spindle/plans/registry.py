"""Queries of the engine's own operators over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS contracts FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts by year of registration."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.where("o_orderdate is not null").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("contracts"))


def archive_query(sql: str | None = None):
    """As query(), for a function of the archive's views; its SQL may name the views."""

    def add(f):
        from ..sources.archive import Archive, with_views

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Archive(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"spindle.plans.{name}")


MODULES = ["acts", "decisions", "library", "records", "rules", "surface"]
