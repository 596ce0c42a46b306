"""Completeness, confidence and quality figures over leads and jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.nested import map_from_entries_last
from leadloom.functions.text import clamp01, is_blank, trim_ws
from leadloom.operators.ordered import with_positions

# Field tiers and weights of the quality score.
CORE_FIELDS = ["name", "website", "country"]
IMPORTANT_FIELDS = ["city", "email", "phone", "description"]
OPTIONAL_FIELDS = ["address", "postal_code", "product_categories", "brands", "logo_url", "social_media"]
CORE_WEIGHT, IMPORTANT_WEIGHT, OPTIONAL_WEIGHT = 0.5, 0.35, 0.15

# Fields behind parser confidence, preview score and contact check.
CONFIDENCE_SCALARS = [
    "name", "website", "email", "phone", "country", "city", "address", "description", "marketplace_name", "source_url",
]
CONFIDENCE_STRUCTURED = ["product_categories", "brands", "social_media"]
PREVIEW_FIELDS = [
    "name", "website", "email", "phone", "country", "city", "address", "description", "logo_url",
    "marketplace_name", "store_url",
]
CONTACT_FIELDS = ["name", "email", "phone", "website", "address", "city", "country"]

# Report sentences.
MSG_CORE = "Core field '{}' has low coverage ("
MSG_REQUESTED = "Requested field '{}' has low coverage ("
MSG_REQUESTED_TAIL = " — it may not be visible on the listing page (try detail page scraping)"
MSG_FEW = " records extracted — may indicate pagination or selector issues"
MSG_DUPLICATES = " potential duplicate records detected"
MSG_EMAIL = "Low email coverage — consider enabling detail page scraping to find contact info"
MSG_WEBSITE = "Low website coverage — detail pages or structured data may contain website URLs"
MSG_DESCRIPTION = "Low description coverage — enable detail page scraping for richer data"
MSG_GOOD = "Good quality — data is ready for export"
MSG_MODERATE = "Moderate quality — review warnings and consider tweaking the scraping plan"
MSG_LOW = "Low quality — verify the URL, selectors, and try a different extraction method"
MSG_NO_CANDIDATE = "no extraction method could find items on this page"
MSG_LITTLE_CONTACT = "the extracted record contains very little contact data"

# Default cost guess per call when a provider reports none.
COST_CHEAP, COST_OTHER = 0.002, 0.006
CHEAP_METHODS = ["css", "auto"]


def is_filled(df: DataFrame, field: str) -> Column:
    """Truthy and not blank: non-blank text, non-empty list or map, non-zero number."""
    if field not in df.columns:
        return F.lit(False)
    t = df.schema[field].dataType
    c = F.col(field)
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.coalesce(F.cardinality(c) > 0, F.lit(False))
    if isinstance(t, T.StringType):
        return ~is_blank(c)
    if isinstance(t, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def _covered(df: DataFrame, field: str) -> Column:
    """Filled, with the extra map as fallback where the field itself is falsy."""
    filled = is_filled(df, field)
    if "raw_extra" not in df.columns or not isinstance(df.schema["raw_extra"].dataType, T.MapType):
        return filled
    own = F.col(field) if field in df.columns else F.lit(None)
    # a whitespace-only text is truthy, so it hides the fallback
    falsy = ~filled
    if field in df.columns and isinstance(df.schema[field].dataType, T.StringType):
        falsy = own.isNull() | (own == "")
    return filled | (falsy & ~is_blank(F.element_at(F.col("raw_extra"), F.lit(field))))


def _share(cond: Column) -> Column:
    return F.coalesce(F.round(F.count_if(cond) / F.count("*"), 3), F.lit(0.0))


def coverage_wide(
    leads: DataFrame, fields: Sequence[str], keys: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    return leads.groupBy(*keys).agg(
        F.count("*").alias("total_records"), *[_share(_covered(leads, f)).alias(f) for f in fields], *extra
    )


def field_coverage(leads: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, field, coverage): share of records with a usable value, three decimals."""
    wide = coverage_wide(leads, fields, keys)
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).alias("coverage")) for f in fields]
    return wide.select(*keys, F.inline(F.array(*cells)))


def _mean(fields: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f) for f in fields]) / F.lit(float(max(len(fields), 1)))


def quality_report(
    leads: DataFrame, keys: Sequence[str] = (), fields_wanted: str | None = None, extra: Sequence[Column] = ()
) -> DataFrame:
    """Coverage per field and overall score per job; requested fields replace the tiers."""
    if fields_wanted:
        fields = list(dict.fromkeys(f.strip() for f in fields_wanted.split(",") if f.strip()))
        score = _mean(fields)
    else:
        fields = CORE_FIELDS + IMPORTANT_FIELDS + OPTIONAL_FIELDS
        score = (
            _mean(CORE_FIELDS) * F.lit(CORE_WEIGHT)
            + _mean(IMPORTANT_FIELDS) * F.lit(IMPORTANT_WEIGHT)
            + _mean(OPTIONAL_FIELDS) * F.lit(OPTIONAL_WEIGHT)
        )
    wide = coverage_wide(leads, fields, keys, extra)
    return wide.withColumn("overall_score", F.when(F.col("total_records") > 0, score).otherwise(F.lit(0.0)))


def _percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def quality_messages(
    leads: DataFrame, keys: Sequence[str] = (), fields_wanted: str | None = None
) -> DataFrame:
    """Quality report with `warnings` and `recommendations` lists."""
    name = F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.lower(trim_ws("name")))
    # the distinct count rides on the same aggregation: rows are first folded per (keys, name)
    names = [F.count(name).alias("_named"), F.countDistinct(name).alias("_unique")]
    both = quality_report(leads, keys, fields_wanted, names)
    warnings = []
    if fields_wanted:
        for f in [x.strip() for x in fields_wanted.split(",") if x.strip()]:
            warnings.append(F.when(
                F.col(f) < 0.3,
                F.concat(F.lit(MSG_REQUESTED.format(f)), _percent(F.col(f)), F.lit(")" + MSG_REQUESTED_TAIL)),
            ))
    else:
        for f in CORE_FIELDS:
            warnings.append(F.when(F.col(f) < 0.5, F.concat(F.lit(MSG_CORE.format(f)), _percent(F.col(f)), F.lit(")"))))
    total = F.col("total_records")
    warnings.append(F.when(total < 5, F.concat(F.lit("Only "), total.cast("string"), F.lit(MSG_FEW))))
    duplicates = F.col("_named") - F.col("_unique")
    warnings.append(F.when(
        F.col("_unique") < F.col("_named") * F.lit(0.9), F.concat(F.lit("~"), duplicates.cast("string"), F.lit(MSG_DUPLICATES))
    ))
    advice = []
    if not fields_wanted:
        advice += [
            F.when(F.col("email") < 0.3, F.lit(MSG_EMAIL)),
            F.when(F.col("website") < 0.3, F.lit(MSG_WEBSITE)),
            F.when(F.col("description") < 0.2, F.lit(MSG_DESCRIPTION)),
        ]
    score = F.col("overall_score")
    advice.append(F.when(score >= 0.7, MSG_GOOD).when(score >= 0.4, MSG_MODERATE).otherwise(MSG_LOW))
    return both.withColumns({
        "warnings": F.array_compact(F.array(*warnings)), "recommendations": F.array_compact(F.array(*advice)),
    }).drop("_named", "_unique")


def parser_confidence(leads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Confidence of a parse from scalar, structured and name completeness."""
    scalars = sum([is_filled(leads, f).cast("int") for f in CONFIDENCE_SCALARS], F.lit(0))
    structured = sum([is_filled(leads, f).cast("int") for f in CONFIDENCE_STRUCTURED], F.lit(0))
    n = F.count("*")
    agg = leads.groupBy(*keys).agg(
        n.alias("record_count"),
        F.coalesce(F.sum(scalars), F.lit(0)).alias("non_empty_fields"),
        (n * len(CONFIDENCE_SCALARS)).alias("total_fields"),
        F.coalesce(F.sum(structured), F.lit(0)).alias("structured_non_empty"),
        (n * len(CONFIDENCE_STRUCTURED)).alias("structured_total"),
        F.count_if(is_filled(leads, "name")).alias("name_present"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    scalar, struct = ratio("non_empty_fields", "total_fields"), ratio("structured_non_empty", "structured_total")
    names = ratio("name_present", "record_count")
    score = F.lit(0.2) + F.lit(0.6) * scalar + F.lit(0.15) * struct + F.lit(0.05) * names
    return agg.withColumns({
        "score": clamp01(score),
        "scalar_ratio": F.round(scalar, 4),
        "structured_ratio": F.round(struct, 4),
        "name_ratio": F.round(names, 4),
    })


def preview_score(leads: DataFrame) -> Column:
    """One point per filled core field, less for filled lists and links."""
    points = sum([F.when(is_filled(leads, f), F.lit(1.0)).otherwise(F.lit(0.0)) for f in PREVIEW_FIELDS], F.lit(0.0))
    for field, value in (("product_categories", 0.75), ("brands", 0.75), ("social_media", 0.5)):
        points = points + F.when(is_filled(leads, field), F.lit(value)).otherwise(F.lit(0.0))
    return points


def planning_confidence(has_fields: Column, js_with_wait: Column, has_pagination: Column) -> Column:
    bonus = lambda c: F.when(c, F.lit(0.05)).otherwise(F.lit(0.0))
    return clamp01(F.when(has_fields, F.lit(0.85)).otherwise(F.lit(0.55)) + bonus(js_with_wait) + bonus(has_pagination))


def scraping_confidence(items: Column) -> Column:
    return F.when(items >= 10, F.lit(0.9)).when(items > 0, F.lit(0.7)).otherwise(F.lit(0.2))


def output_confidence(records: Column) -> Column:
    return F.when(records > 0, F.lit(0.9)).otherwise(F.lit(0.35))


def job_counters(progress: DataFrame, job: str) -> DataFrame:
    """Counters per job from progress events (stage, page_items)."""
    page = F.col("stage") == "scraping_pages"
    items = F.coalesce(F.col("page_items"), F.lit(0))
    return progress.groupBy(job).agg(
        F.count_if(page).alias("pages_processed"),
        F.coalesce(F.sum(F.when(page, F.greatest(items, F.lit(0)))), F.lit(0)).cast("bigint").alias("items_extracted"),
        F.count_if(page & (items == 0)).alias("empty_pages"),
        F.count_if(F.col("stage") == "method_fallback").alias("method_fallbacks"),
        F.count_if(F.col("stage") == "method_switch").alias("method_switches"),
    )


def provider_cost() -> Column:
    """Reported cost, or the default guess for calls of the main provider."""
    guess = F.when(F.col("provider") == "openai", F.when(F.col("method").isin(*CHEAP_METHODS), F.lit(COST_CHEAP)).otherwise(F.lit(COST_OTHER)))
    return F.round(F.coalesce(F.col("estimated_cost_usd"), guess), 6)


def provider_summary(events: DataFrame, job: str) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return events.groupBy(job).agg(
        F.count("*").alias("event_count"),
        F.round(F.coalesce(F.sum(provider_cost()), F.lit(0.0)), 6).alias("estimated_total_cost_usd"),
        total("input_tokens").alias("estimated_input_tokens"),
        total("output_tokens").alias("estimated_output_tokens"),
    )


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) for each table."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def fill_stats(df: DataFrame, columns: Sequence[str], ignored: Sequence[str] = ("",)) -> DataFrame:
    """(column, filled, total): usable values per column."""
    aggs = [
        F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*ignored)).alias(f"f{i}") for i, c in enumerate(columns)
    ]
    wide = df.agg(F.count("*").alias("total"), *aggs)
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("filled")) for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*cells)), "total")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def scrape_outcomes(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """found, empty, errors and processed counts of tagged results."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy(*keys).agg(
        is_("ok").alias("found"), is_("empty").alias("empty"), is_("error").alias("errors"), F.count("*").alias("processed")
    )


def script_complexity() -> Column:
    """Reasons why a page looks complex, from (n_candidates, container_count, field_hit_ratio, contact_filled)."""
    containers, ratio = F.col("container_count"), F.col("field_hit_ratio")
    return F.array_compact(F.array(
        F.when(F.col("n_candidates") == 0, F.lit(MSG_NO_CANDIDATE)),
        F.when(
            (containers >= 0) & (containers < 3),
            F.concat(F.lit("CSS selectors matched only "), containers.cast("string"), F.lit(" item containers")),
        ),
        F.when(
            (ratio >= 0) & (ratio < 0.3),
            F.concat(F.lit("only "), _percent(ratio), F.lit(" of field selectors found data")),
        ),
        F.when((F.col("n_candidates") == 1) & (F.col("contact_filled") < 2), F.lit(MSG_LITTLE_CONTACT)),
    ))


def items_per_page(items: DataFrame, url: str, order_by: Sequence[str], item: str, detail_url: str, detail_html: str) -> DataFrame:
    """(url, kind, pos, detail_url, value): all that was scraped from a listing URL, as rows.

    Rows of kind `item` are its items, numbered from 1 in order; rows of kind `detail` its detail pages, one per
    detail URL with its last page. Nothing is gathered per URL, so that a busy one is as good as any other.
    """
    none = lambda kind: F.lit(None).cast(kind)
    listed = with_positions(items, [url], order_by, "pos").select(
        url, F.lit("item").alias("kind"), "pos", none("string").alias("detail_url"), F.col(item).alias("value")
    )
    filled = items.filter((F.coalesce(F.col(detail_url), F.lit("")) != "") & (F.coalesce(F.col(detail_html), F.lit("")) != ""))
    details = filled.groupBy(url, F.col(detail_url).alias("detail_url")).agg(F.max_by(F.col(detail_html), F.struct(*order_by)).alias("value"))
    return listed.unionByName(details.select(url, F.lit("detail").alias("kind"), none("bigint").alias("pos"), "detail_url", "value"))
