"""Registered queries by family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadloom.plans import companies, functions, io, jobs, pages  # noqa: F401
from leadloom.plans.registry import BUILDS, SQL, as_query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: as_query(fn) for name, fn in BUILDS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
