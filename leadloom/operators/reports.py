"""Run reports: summaries, regressions, trends and top lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import fixed_text, trim_ws
from leadloom.operators.ordered import limit_items, order_key


@dataclass(frozen=True)
class Thresholds:
    """Default regression gates; a gate opens only above its value."""

    pass_rate_drop: float = 0.10
    empty_pages_increase: float = 2.0
    switches_increase: float = 1.0
    scalar_drop: float = 0.10
    structured_drop: float = 0.10
    new_failures: int = 0


# Verdict texts of the pass rule.
ACTIVE_PASS_STATUSES = ["completed", "partial"]


def evaluate_pass(
    status: Column, count: Column, quality: Column, min_records: Column, min_quality: Column, allow_partial: Column
) -> Column:
    """struct(passed, reason, count) of a finished job against its profile; first failing check wins."""
    st = F.lower(F.coalesce(status, F.lit("")))
    n = F.coalesce(count, F.lit(0))
    need = F.coalesce(min_records, F.lit(1))
    bar = F.coalesce(min_quality, F.lit(0.0))
    q = F.coalesce(quality, F.lit(0.0))
    reason = (
        F.when(st == "failed", F.lit("job failed"))
        .when((st == "partial") & ~F.coalesce(allow_partial, F.lit(True)), F.lit("partial not allowed by profile"))
        .when(~st.isin(*ACTIVE_PASS_STATUSES), F.concat(F.lit("unexpected final status="), st))
        .when(n < need, F.format_string("record_count %d < expected minimum %d", n, need))
        .when((bar > 0) & (q < bar), F.concat(F.lit("quality_score "), fixed_text(q, 3), F.lit(" < expected minimum "), fixed_text(bar, 3)))
        .otherwise(F.lit("ok"))
    )
    return F.struct((reason == "ok").alias("passed"), reason.alias("reason"), n.alias("count"))


def failed_profiles(results: DataFrame, report: str) -> DataFrame:
    return results.filter(~F.coalesce(F.col("passed"), F.lit(False))).select(
        report, F.coalesce(F.nullif(F.col("profile_name"), F.lit("")), F.lit("unknown-profile")).alias("profile_name")
    )


def summarize_run(results: DataFrame, report: str, summary: bool = False) -> DataFrame:
    """Totals, pass rate and averages per report.

    `summary` uses the totals stored in the report (summary_total, summary_passed,
    summary_failed) where present.
    """
    passed = F.count_if(F.coalesce(F.col("passed"), F.lit(False)))
    rows = F.count("*")
    if summary:
        # stored totals are part of every row of the report
        total = F.coalesce(F.max("summary_total"), rows)
        ok = F.coalesce(F.max("summary_passed"), F.lit(0))
        failed = F.coalesce(F.max("summary_failed"), F.greatest(total - ok, F.lit(0)))
    else:
        total, ok = rows, passed
        failed = rows - passed
    avg = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0)))
    return results.groupBy(report).agg(
        total.alias("total"),
        ok.alias("passed"),
        failed.alias("failed"),
        F.coalesce(F.try_divide(ok, total), F.lit(0.0)).alias("pass_rate"),
        avg("empty_pages").alias("avg_empty_pages"),
        avg("method_switches").alias("avg_method_switches"),
        avg("scalar_ratio").alias("avg_parser_scalar_ratio"),
        avg("structured_ratio").alias("avg_parser_structured_ratio"),
    )


def new_failures(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Failed profiles of the current report that did not fail before."""
    return current.select("profile_name").subtract(previous.select("profile_name"))


def with_previous(summaries: DataFrame, report: str, metrics: Sequence[str]) -> DataFrame:
    """Previous report's metrics next to the current ones. There is one summary row per report, so that the rows
    of all reports fit one task."""
    w = Window.orderBy(report)
    return summaries.withColumns({f"prev_{m}": F.lag(m).over(w) for m in [report, *metrics]})


METRICS = [
    "pass_rate", "avg_empty_pages", "avg_method_switches", "avg_parser_scalar_ratio", "avg_parser_structured_ratio",
]


def regression_issues(gates: Thresholds = Thresholds()) -> Column:
    """Texts of the violated gates for a row with current and `prev_` metrics and `new_failed` names."""
    drop = lambda m: F.col(f"prev_{m}") - F.col(m)
    rise = lambda m: F.col(m) - F.col(f"prev_{m}")
    checks = [
        ("pass_rate_drop", drop("pass_rate"), gates.pass_rate_drop),
        ("avg_empty_pages_increase", rise("avg_empty_pages"), gates.empty_pages_increase),
        ("avg_method_switches_increase", rise("avg_method_switches"), gates.switches_increase),
        ("avg_parser_scalar_drop", drop("avg_parser_scalar_ratio"), gates.scalar_drop),
        ("avg_parser_structured_drop", drop("avg_parser_structured_ratio"), gates.structured_drop),
    ]
    texts = [
        F.when(v > F.lit(limit), F.concat(F.lit(f"{n}="), fixed_text(v, 3), F.lit(f" exceeds threshold {limit:.3f}"))) for n, v, limit in checks
    ]
    texts.append(F.when(
        F.size("new_failed") > gates.new_failures,
        F.concat(F.lit("new_failed_profiles="), F.array_join("new_failed", ", "),
                 F.lit(f" exceeds allowed count {gates.new_failures}")),
    ))
    return F.array_compact(F.array(*texts))


def compare_runs(results: DataFrame, report: str, gates: Thresholds = Thresholds()) -> DataFrame:
    """Each report against the one before it by name: (ok, issues)."""
    pairs = with_previous(summarize_run(results, report), report, METRICS).filter(F.col(f"prev_{report}").isNotNull())
    failed = failed_profiles(results, report).distinct()
    before = failed.select(F.col(report).alias("_r"), F.col("profile_name").alias("_p"))
    names = pairs.select(report, f"prev_{report}")
    fresh = (
        failed.join(names, report)
        .join(before, (F.col(f"prev_{report}") == F.col("_r")) & (F.col("profile_name") == F.col("_p")), "left_anti")
        .groupBy(F.col(report).alias("_r2"))
        .agg(F.array_sort(F.collect_set("profile_name")).alias("new_failed"))
    )
    joined = pairs.join(fresh, F.col(report) == F.col("_r2"), "left").withColumn(
        "new_failed", F.coalesce("new_failed", F.array().cast("array<string>"))
    ).drop("_r2")
    return joined.withColumn("issues", regression_issues(gates)).withColumn("ok", F.size("issues") == 0)


def trend_table(results: DataFrame, report: str) -> DataFrame:
    """Metrics per report with the change against the previous report."""
    out = with_previous(summarize_run(results, report), report, METRICS)
    return out.withColumns({f"delta_{m}": F.col(m) - F.col(f"prev_{m}") for m in METRICS})


def issue_summary(results: DataFrame, report: str, order_by: Sequence[str], limit: int, stored: DataFrame | None = None) -> DataFrame:
    """Totals per report and its first `limit` failed profile names.

    `stored` (report, total, passed, failed) has the totals that reports carry: they stand as written, a
    missing total or passed is 0, a missing failed what is left. Without it the rows are counted.
    """
    failed = results.filter(~F.coalesce(F.col("passed"), F.lit(False)))
    first = limit_items(failed, limit, order_by, [report]).withColumn("_rn", F.struct(*order_by))
    name = F.coalesce(F.nullif(F.col("profile_name"), F.lit("")), F.lit("unknown-profile"))
    names = first.groupBy(F.col(report).alias("_r")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", name.alias("n")))), lambda x: x["n"]).alias("failed_profiles")
    )
    if stored is None:
        totals = results.groupBy(report).agg(
            F.count("*").alias("total"),
            F.count_if(~F.coalesce(F.col("passed"), F.lit(False))).alias("failed"),
        )
    else:
        total, passed = (F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("total", "passed"))
        left = F.coalesce(F.col("failed").cast("bigint"), F.greatest(total - passed, F.lit(0)))
        totals = stored.select(report, total.alias("total"), left.alias("failed"))
    return totals.join(names, F.col(report) == F.col("_r"), "left").drop("_r").withColumn(
        "failed_profiles", F.coalesce("failed_profiles", F.array().cast("array<string>"))
    )


def top_counter_rows(rows: DataFrame, key: str, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return rows.filter(F.col(key) > 0).orderBy(F.desc(key), *order_by).limit(n)


def lowest_rows(rows: DataFrame, key: str, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return rows.orderBy(F.coalesce(F.col(key), F.lit(0.0)), *order_by).limit(n)


def top_failure_reasons(rows: DataFrame, reason: str, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """Most frequent reasons; equal counts in order of first appearance."""
    text = trim_ws(F.coalesce(F.col(reason), F.lit("")))
    named = rows.withColumn("reason", F.when(text == "", F.lit("unspecified")).otherwise(text))
    return (
        named.groupBy("reason")
        .agg(F.count("*").alias("count"), F.min(order_key(order_by)).alias("_first"))
        .orderBy(F.desc("count"), "_first")
        .limit(n)
        .drop("_first")
    )


def by_priority(requests: DataFrame, order_by: Sequence[str], priority: str = "priority") -> DataFrame:
    """Urgent before normal before the rest; sheet order within."""
    p = F.col(priority)
    rank = F.when(p == "Urgent", 0).when(p == "Normal", 1).otherwise(2)
    return requests.withColumn("priority_rank", rank).orderBy("priority_rank", *order_by)


def jobs_recent_first(jobs: DataFrame, created: str, tie: Sequence[str] = ()) -> DataFrame:
    return jobs.orderBy(F.desc(created), *tie)


# Revenue answers that carry no figure.
NO_REVENUE = ["not found", "error", ""]


def top_verifiable(results: DataFrame, order_by: Sequence[str], n: int = 50) -> DataFrame:
    """First results with medium or high confidence, a usable revenue and no verification yet."""
    revenue = F.coalesce(F.col("total_annual_revenue"), F.lit(""))
    source = F.coalesce(F.col("revenue_source"), F.lit(""))
    return results.filter(
        F.col("confidence").isin("high", "medium") & ~revenue.isin(*NO_REVENUE) & ~F.contains(source, F.lit("verified"))
    ).orderBy(*order_by).limit(n)
