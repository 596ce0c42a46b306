"""Registered queries: a Spark build and, where SQL can say it, the equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadloom.plans.views import VIEWS, sql_text
from leadloom.session import ship_package

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


# tables whose rows carry the work; the others are small dimensions
FACTS = {"orders", "lineitem", "events", "documents", "pages", "conversations"}
# views of such dimensions that are expensive per row
WIDE_VIEWS = {"detail_pages", "listing_pages", "api_items", "api_bodies", "paging"}
# tasks per core for them
WIDE_TASKS = 4


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over `spark.leadloom.spread` tasks where that is set: for small tables of one file each,
    which a scan cannot split. Unset, scans stay as their files are."""
    tasks = int(df.sparkSession.conf.get("spark.leadloom.spread", "0"))
    return df.repartition(tasks) if tasks else df


def spread_wide(df: DataFrame) -> DataFrame:
    """The short rows of a dimension dealt over all cores, before pages or bodies are made of them: a scan gives
    the whole file, however many rows it has, to one task or few."""
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.leadloom.spread", "0")) or WIDE_TASKS * spark.sparkContext.defaultParallelism
    return df.repartition(tasks)


class Tables:
    """Given tables and the views derived from them, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(df) if name in FACTS else df
        if name in VIEWS:
            text = VIEWS[name]
            used = {x: getattr(self, x) for x in [*TABLES, *VIEWS] if "{" + x + "}" in text}
            if name in WIDE_VIEWS:
                used.update({x: self.wide(x) for x in used if x != "nation"})
            return self.spark.sql(text, **used)
        raise AttributeError(name)

    def wide(self, name: str) -> DataFrame:
        """A given table whose rows become pages or bodies."""
        return spread_wide(getattr(self, name))


Build = Callable[[Tables], DataFrame]
BUILDS: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; `{view}` names in the SQL are derived views, resolved to subqueries."""
    def add(fn: Build) -> Build:
        if name in BUILDS:
            raise ValueError(f"query {name} is registered twice")
        BUILDS[name] = fn
        if sql is not None:
            SQL[name] = sql_text(sql)
        return fn

    return add


def as_query(fn: Build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(Tables(spark, folder))

    return run
