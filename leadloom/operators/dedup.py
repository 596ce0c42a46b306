"""First-wins deduplication of raw items and leads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import _c, trim_ws
from leadloom.operators.ordered import keep_first, limit_items


def lower_trim(c: Column | str) -> Column:
    return F.lower(trim_ws(F.coalesce(_c(c), F.lit(""))))


def item_key(item: Column | str) -> Column:
    """Identity of a raw item: its detail link, else name and all filled values in key order."""
    m = _c(item)
    link = F.element_at(m, F.lit("detail_link"))
    filled = F.filter(
        F.array_sort(F.map_entries(m)),
        lambda e: (e["key"] != "detail_link") & e["value"].isNotNull() & (e["value"] != ""),
    )
    values = F.array_join(F.transform(filled, lambda e: lower_trim(e["value"])), "|")
    return F.when(F.coalesce(link, F.lit("")) != "", link).otherwise(
        F.concat(lower_trim(F.element_at(m, F.lit("name"))), F.lit("||"), values)
    )


def dedup_items(
    items: DataFrame, item: str, order_by: Sequence[str], job: Sequence[str] = (), max_items: int | None = None
) -> DataFrame:
    """First item per identity over all pages of a job; an item limit applies before."""
    if max_items is not None:
        items = limit_items(items, max_items, order_by, job)
    # the shuffle key is a digest: item texts can be long
    keyed = items.withColumn("_key", F.sha2(item_key(item), 256))
    return keep_first(keyed, [*job, "_key"], order_by).drop("_key")


def lead_key() -> tuple[Column, Column]:
    site = F.when(F.coalesce(F.col("website"), F.lit("")) != "", F.col("website")).otherwise(F.col("source_url"))
    return lower_trim("name").alias("_k1"), lower_trim(site).alias("_k2")


def dedup_leads(leads: DataFrame, order_by: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """First lead per (name, website or source URL), case and outer space ignored."""
    k1, k2 = lead_key()
    keyed = leads.select("*", k1, k2)
    return keep_first(keyed, [*scope, "_k1", "_k2"], order_by).drop("_k1", "_k2")


def dedup_by(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    return keep_first(df, [key], order_by)


def resume_union(previous: DataFrame, new: DataFrame, order_by: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Earlier leads first, then new ones, deduplicated."""
    both = previous.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)), allowMissingColumns=True)
    return dedup_leads(both, ["_run", *order_by], scope).drop("_run")
