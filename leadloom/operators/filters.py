"""Row and column filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.text import _c, clean_str, contains_any, is_blank, trim_ws

# Seller names that are page messages, and the texts of "no such seller" pages.
PLACEHOLDER_RE = r"(?i)not found|error|unknown"
NOT_FOUND_TEXTS = [
    "Helaas kan de verkoper niet worden gevonden",
    "Unfortunately, the seller could not be found",
    "Leider konnte der Verkäufer nicht gefunden werden",
]
# Case-sensitive tokens that make a cell count as empty when columns are judged.
EMPTY_CELLS = ["", "nan", "None", "N/A", "null"]


def drop_unnamed(df: DataFrame, name: str) -> DataFrame:
    return df.filter(~is_blank(name))


def drop_placeholder_sellers(df: DataFrame, name: str) -> DataFrame:
    return df.filter(~F.rlike(F.col(name), F.lit(PLACEHOLDER_RE)) & (F.length(clean_str(name)) >= 2))


def drop_empty_sellers(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keep rows in which at least one of the fields is filled."""
    filled = F.lit(False)
    for f in fields:
        filled = filled | (F.coalesce(F.col(f).cast("string"), F.lit("")) != "")
    return df.filter(filled)


def not_found_page(name: Column | str, html: Column | str) -> Column:
    """True for pages saying that the seller does not exist (in the name or a heading)."""
    page = _c(html)
    hit = contains_any(F.coalesce(_c(name), F.lit("")), NOT_FOUND_TEXTS)
    headings = [f"<{h}>{t}</{h}>" for t in NOT_FOUND_TEXTS for h in ("h1", "h2")]
    return hit | F.coalesce(contains_any(page, headings), F.lit(False))


def not_found_pages(df: DataFrame, name: str, html: str) -> DataFrame:
    return df.filter(not_found_page(name, html))


def drop_errors(details: DataFrame, error: str = "error") -> DataFrame:
    return details.filter(F.coalesce(F.col(error), F.lit("")) != "404")


def actionable_requests(df: DataFrame, request_num: int | None = None) -> DataFrame:
    """New requests, or exactly the named one."""
    return df.filter(F.col("status") == "New" if request_num is None else F.col("request_num") == request_num)


def enabled_profiles(df: DataFrame, cap: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    out = df.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    if cap is None:
        return out
    return out.orderBy(*order_by).limit(cap)


def column_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table (column, nulls, empties, rows) in one pass over the data."""
    parts = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        parts.append(F.count_if(F.col(c).isNull()).alias(f"n{i}"))
        parts.append(F.count_if(trim_ws(F.col(c).cast("string")).isin(*EMPTY_CELLS)).alias(f"e{i}"))
    wide = df.agg(*parts)
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.col(f"e{i}").alias("empties"))
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*cells)), "rows")


def sparse_columns(fill: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Add `sparse`: null share or empty-token share reaches the threshold (not their sum), or all null."""
    return fill.withColumn(
        "sparse",
        (F.col("rows") == 0)
        | (F.col("nulls") == F.col("rows"))
        | (F.try_divide("nulls", "rows") >= threshold)
        | (F.try_divide("empties", "rows") >= threshold),
    )


def drop_sparse_columns(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Drop nearly empty string columns, clean the remaining strings. One aggregate decides."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    verdict = sparse_columns(column_fill(df, strings), threshold)
    sparse = {r["column"] for r in verdict.filter(F.coalesce("sparse", F.lit(True))).select("column").collect()}
    return df.select(*[
        clean_str(c).alias(c) if c in strings else F.col(c) for c in df.columns if c not in sparse
    ])
