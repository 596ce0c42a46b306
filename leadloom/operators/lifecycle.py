"""Job and cache lifecycle as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import age_hours, fixed_text, slugify

# Job statuses.
PLANNING_STATUSES = ["pending", "planning", "plan_review", "preview"]
ACTIVE_STATUSES = ["pending", "planning", "scraping", "parsing", "output"]
INTERRUPTED = "Job was interrupted by a server restart or process exit."


def status_to_stage(status: Column) -> Column:
    return (
        F.when(status.isin(*PLANNING_STATUSES), F.lit("planning"))
        .when(status == "scraping", F.lit("scraping"))
        .when(status == "parsing", F.lit("parsing"))
        .otherwise(F.lit("output"))
    )


def recover_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Interrupted jobs become partial (pending URLs left) or failed, with timeline and failure entries.

    Jobs (id, status, error, n_pending, timeline array, failures array<struct>).
    """
    active = F.col("status").isin(*ACTIVE_STATUSES)
    new_status = F.when(~active, F.col("status")).when(F.col("n_pending") > 0, F.lit("partial")).otherwise(F.lit("failed"))
    stamp = now.cast("string")
    lines = F.array(
        F.concat(stamp, F.lit(" status="), F.col("status"), F.lit(" reason=interrupted_previous_process")),
        F.concat(stamp, F.lit(" status="), new_status, F.lit(" reason=recovered_from_interrupted_process")),
    )
    failure = F.struct(
        F.lit("unknown").alias("category"), status_to_stage(F.col("status")).alias("stage"),
        F.lit(INTERRUPTED).alias("message"), F.lit(True).alias("retryable"), F.col("status").alias("previous_status"),
    )
    failed_now = active & (F.col("n_pending") <= 0)
    return jobs.select(
        *[c for c in jobs.columns if c not in ("status", "error", "timeline", "failures")],
        new_status.alias("status"),
        F.when(failed_now, F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit(INTERRUPTED))).otherwise(F.col("error")).alias("error"),
        F.when(active, F.concat("timeline", lines)).otherwise(F.col("timeline")).alias("timeline"),
        F.when(active, F.array_append("failures", failure)).otherwise(F.col("failures")).alias("failures"),
        active.alias("recovered"),
    )


def final_status(score: Column, n_pending: Column, min_score: float = 0.0, enforce: bool = False) -> Column:
    """struct(status, quality_failure, message) after the quality gate and the pending check."""
    bar = max(0.0, float(min_score))
    s = F.coalesce(score, F.lit(0.0))
    below = (F.lit(bar) > 0) & (s < F.lit(bar))
    status = F.when(below & F.lit(enforce), F.lit("partial")).when(n_pending > 0, F.lit("partial")).otherwise(F.lit("completed"))
    message = F.when(below, F.concat(F.lit("Quality score "), fixed_text(s, 3), F.lit(f" below configured threshold {bar:.3f}")))
    return F.struct(status.alias("status"), below.alias("quality_failure"), message.alias("message"))


def plan_template_stats(jobs: DataFrame) -> DataFrame:
    """Template list of finished jobs: file name, name, URL, method, record count."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return jobs.select(
        slugify("name").alias("filename"), text(F.col("name")).alias("name"), text(F.col("request.url")).alias("url"),
        F.col("extraction_method"), F.coalesce(F.size("result.records"), F.lit(0)).alias("records_scraped"),
        text(F.col("id")).alias("source_job_id"), text(F.col("status")).alias("source_job_status"),
    )


def cache_inventory(cache: DataFrame, now: Column) -> DataFrame:
    """(key, url, age_hours) of cached entries, sorted by key."""
    return cache.select(
        "key", F.coalesce(F.col("url"), F.lit("?")).alias("url"), F.round(age_hours("cached_at", now), 1).alias("age_hours")
    ).orderBy("key")


def added_fields(a: Column, b: Column) -> tuple[Column, Column]:
    """(names only in plan b with a selector, merged field map in which plan a wins)."""
    usable = F.map_filter(b, lambda k, v: v.isNotNull() & (v != "") & ~F.map_contains_key(a, k))
    return F.array_except(F.map_keys(b), F.map_keys(a)), F.map_concat(usable, a)
