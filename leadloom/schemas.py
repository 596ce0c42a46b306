"""Table and record schemas."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L = T.StringType(), T.DoubleType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


LEAD_SCALARS = [
    "name", "country", "city", "address", "postal_code", "website", "store_url", "email", "phone",
    "description", "marketplace_name", "booth", "hall", "logo_url", "source_url",
]

LEAD_SCHEMA = _struct(
    **{n: S for n in LEAD_SCALARS},
    product_categories=T.ArrayType(S),
    brands=T.ArrayType(S),
    social_media=T.MapType(S, S),
    raw_extra=T.MapType(S, S),
)

RUN_REPORT_SCHEMA = _struct(
    summary=_struct(total=L, passed=L, failed=L),
    results=T.ArrayType(
        _struct(
            profile_name=S, status=S, reason=S, passed=T.BooleanType(),
            diagnostics=_struct(counters=T.MapType(S, L), parser_metrics=T.MapType(S, D)),
        )
    ),
)

JOB_SCHEMA = _struct(
    id=S,
    status=S,
    created_at=S,
    updated_at=S,
    error=S,
    request=_struct(url=S, fields_wanted=S),
    extraction_method=S,
    pending_detail_urls=T.ArrayType(S),
    result=_struct(records=T.ArrayType(T.MapType(S, S))),
    quality_report=_struct(overall_score=D),
    diagnostics=_struct(status_timeline=T.ArrayType(S), counters=T.MapType(S, L)),
)

REQUEST_COLUMNS = [
    "request_num", "date", "submitted_by", "source_type", "event_name", "url", "country", "priority",
    "fields_wanted", "notes", "status", "results_link", "companies_found", "completed_date", "processor_notes",
]

COMPANY_ATTRIBUTES = [
    "slug", "company_type", "description", "country", "city", "address", "postal_code", "state", "website",
    "email", "phone", "fax", "logo_url", "parent_group", "vertical", "sub_vertical", "org_size", "employee_count",
]

TABLES = {
    "companies": ["company_id", "name", "name_normalized", *COMPANY_ATTRIBUTES, "created_at", "updated_at"],
    "company_socials": ["company_id", "platform", "url"],
    "contacts": ["company_id", "first_name", "last_name", "email", "job_title", "seniority", "department",
                 "linkedin_url", "mobile", "direct_tel", "office_tel", "source"],
    "events": ["event_id", "name", "name_normalized", "year", "city", "country", "website"],
    "event_exhibitors": ["company_id", "event_id", "hall", "stand", "booth", "product_categories", "brands",
                         "detail_url", "source_url", "extra_data"],
    "marketplaces": ["marketplace_id", "name", "website"],
    "marketplace_sellers": ["company_id", "marketplace_id", "seller_id", "rating", "rating_out_of", "review_count",
                            "vat_number", "kvk_number", "shipped_from", "source_url", "extra_data"],
    "company_financials": ["company_id", "year", "source", "total_gmv_eur", "net_sales_1p_eur", "gmv_3p_eur",
                           "growth_yoy", "total_annual_revenue", "ecom_revenue", "revenue_source", "confidence",
                           "buyers", "orders_total", "aov_eur", "conversion_rate", "rank_global", "rank_filtered",
                           "main_country", "main_category", "extra_data"],
    "store_metrics": ["company_id", "store_name", "slug", "year", "total_gmv_eur", "net_sales_1p", "gmv_3p",
                      "growth_yoy", "main_country", "main_category", "rank_global", "rank_filtered", "extra_data"],
    "reference_rankings": ["ranking_type", "name", "year", "rank_global", "rank_filtered", "revenue_eur",
                           "growth_yoy", "extra_data"],
    "scrape_log": ["source_type", "source_name", "file_path", "row_count", "rows_imported", "scraped_at",
                   "imported_at", "notes"],
}
