from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadloom.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "8g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Value of a column expression over one row of keyword columns."""
    from pyspark.sql import functions as F

    def run(expr, **cols):
        df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, (list, dict)) else _lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
        return df.select(expr.alias("v")).first()["v"]

    def _lit(v):
        if isinstance(v, dict):
            return F.create_map(*[F.lit(x) for kv in v.items() for x in kv]).cast("map<string,string>")
        return F.array(*[F.lit(x) for x in v]).cast("array<string>")

    return run
