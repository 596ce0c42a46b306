"""Queries over joins, quality figures, running windows, run reports and job lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import text as X
from leadloom.functions import urls as U
from leadloom.functions.nested import map_to_text
from leadloom.operators import joins as J
from leadloom.operators.dom import attr, first_inside, node_text, page_dom, select
from leadloom.operators import lifecycle as L
from leadloom.operators import ordered as O
from leadloom.operators import quality as Q
from leadloom.operators import reports as R
from leadloom.plans import duck as D
from leadloom.plans.companies import lead_records
from leadloom.plans.registry import query

NOW = "TIMESTAMP '1999-06-01 00:00:00'"
NOW_NTZ = NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")


# --- joins -------------------------------------------------------------------------------


@query(
    "jn1_attach_detail_page",
    f"SELECT ord, cust, '=' || c_name AS detail_page_data FROM {{leads}} JOIN customer ON cust = c_custkey WHERE c_acctbal > 0 UNION ALL SELECT ord, cust, NULL FROM {{leads}} JOIN customer ON cust = c_custkey WHERE c_acctbal <= 0",
)
def _(t):
    details = t.customer.filter("c_acctbal > 0").select(F.concat(F.lit("/c/"), "c_custkey").alias("url"), F.concat(F.lit("="), "c_name").alias("text"))
    items = t.leads.select("ord", "cust", F.concat(F.lit("/c/"), "cust").alias("detail_link"))
    return J.attach_detail_page(items, details).select("ord", "cust", "detail_page_data")


@query(
    "jn2_attach_detail_api",
    """SELECT ord, CASE WHEN c_acctbal > 0 THEN '{"name":"' || c_name || '","seg":"' || c_mktsegment || '"}' END AS detail_api_data FROM {leads} JOIN customer ON cust = c_custkey""",
)
def _(t):
    body = F.create_map(F.lit("name"), "c_name", F.lit("seg"), "c_mktsegment", F.lit("updatedAt"), F.lit("2024"))
    api = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), body.alias("body"))
    return J.attach_detail_api(t.leads.select("ord", F.col("cust").alias("detail_api_id")), api).select("ord", "detail_api_data")


@query(
    "jn3_attach_structured",
    """WITH s AS (SELECT conv_id AS job, sum(length(text)) AS n, min(text) AS body FROM conversations GROUP BY conv_id) SELECT c.conv_id, c.turn, s.body AS structured_data FROM conversations c JOIN s ON c.conv_id = s.job""",
)
def _(t):
    structured = t.conversations.groupBy("conv_id").agg(F.min("text").alias("structured_json"))
    return J.attach_structured(t.conversations.select("conv_id", "turn"), structured, "conv_id")


@query("jn4_merge_listing_detail", "SELECT o_orderkey AS ord, coalesce(nullif(l.website, ''), 'https://detail/' || CAST(o_orderkey AS VARCHAR)) AS website, coalesce(l.email, 'd@x.org') AS email FROM orders JOIN {leads} l ON o_orderkey = l.ord")
def _(t):
    detail = t.orders.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("https://detail/"), "o_orderkey").alias("website"), F.lit("d@x.org").alias("email"))
    return J.merge_listing_detail(t.leads.select("ord", "website", "email"), detail, "ord", ["website", "email"])


@query("jn5_listing_detail_flatten", "SELECT id, replace(name, 'b', 'B') AS title, type || ', ' || brand AS stands, CASE WHEN id % 3 = 0 THEN '' ELSE 'DE' END AS country_iso FROM {api_items}")
def _(t):
    listing = t.api_items.select("id", F.when(F.col("id") % 3 != 0, "DE").alias("country_iso"))
    columns = {"title": F.replace(F.get_json_object("body", "$.values.name"), F.lit("b"), F.lit("B")), "stands": F.array_join(F.from_json(F.get_json_object("body", "$.tags"), "array<string>"), ", ")}
    return J.listing_detail_flatten(listing, t.api_items, "id", columns)


@query(
    "jn6_three_way_export",
    """SELECT c_custkey AS slug, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'D ' || c_name END AS company_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE n_name END AS country, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'https://w' || CAST(c_custkey AS VARCHAR) || '.example.com' END AS website,
      CASE c_custkey % 7 WHEN 0 THEN 'https://linkedin.com/company/own' WHEN 1 THEN 'e' || CAST(c_custkey AS VARCHAR) ELSE 'e' || CAST(c_custkey AS VARCHAR) END AS linkedin, '' AS description, n_name AS parent_group, '' AS vertical, '' AS sub_vertical, c_mktsegment AS org_size
      FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 11 <> 0""",
)
def _(t):
    base = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("slug", F.col("c_custkey"))
    listing = base.select("slug", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("country"))
    k = F.col("c_custkey")
    detail = base.select(
        "slug", F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("D "), "c_name")).alias("name"), F.when(k % 3 != 0, F.col("n_name")).alias("country"),
        F.when(k % 5 == 0, "https://www.Instagram.com/x").otherwise(F.concat(F.lit("https://w"), k, F.lit(".example.com"))).alias("website"),
        F.when(k % 7 == 0, "https://linkedin.com/company/own").when(k % 7 == 1, "https://linkedin.com/company/37122179").otherwise("").alias("linkedin"),
        F.lit(None).cast("string").alias("description"), F.when(k % 11 == 0, "404").alias("error"),
    )
    enrichment = base.select(
        "slug", F.concat(F.lit("e"), k).alias("linkedin_url"), F.col("n_name").alias("parent_group"), F.lit("").alias("vertical"), F.lit("").alias("sub_vertical"), F.col("c_mktsegment").alias("org_size")
    )
    return J.three_way_export(listing, detail, enrichment, "slug", "37122179", X.SOCIAL_DOMAINS)


@query(
    "jn6_three_way_export_lists",
    """SELECT s_suppkey AS slug, CASE WHEN s_suppkey % 2 = 0 THEN 'H1; H2' ELSE 'L' || CAST(s_nationkey AS VARCHAR) END AS halls, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name || '; ' || s_name END AS emails, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'Talk | Talk' END AS events,
      CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'https://instagram.com/' || s_name END AS instagram, 'https://d/' || CAST(s_suppkey AS VARCHAR) AS detail_url, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'rival' END AS competitor_info FROM supplier""",
)
def _(t):
    k, no_list = F.col("s_suppkey"), F.lit(None).cast("array<string>")
    text = F.lit(None).cast("string")
    base = t.supplier.withColumn("slug", k)
    listing = base.select(
        "slug", F.col("s_name").alias("name"), text.alias("country"), F.concat(F.lit("https://d/"), k).alias("detail_url"),
        F.array(F.concat(F.lit("L"), "s_nationkey")).alias("halls"),
    )
    detail = base.filter(k % 3 != 0).select(
        "slug", text.alias("name"), text.alias("country"), text.alias("website"), text.alias("linkedin"), text.alias("description"), text.alias("error"),
        F.when(k % 2 == 0, F.array(F.lit("H1"), F.lit("H2"), F.lit("H1"))).otherwise(no_list).alias("halls"), F.array("s_name", "s_name").alias("emails"),
        F.array(F.lit("Talk"), F.lit("Talk")).alias("events"), F.concat(F.lit("https://instagram.com/"), "s_name").alias("instagram"),
    )
    places = listing.withColumn("halls", F.when(F.col("slug") % 2 == 0, F.array(F.lit("H1"), F.lit("H2"))).otherwise(F.col("halls")))
    enrichment = base.filter(k % 5 != 0).select("slug", text.alias("linkedin_url"), *[text.alias(c) for c in ("parent_group", "vertical", "sub_vertical", "org_size")], F.lit("rival").alias("competitor_info"))
    out = J.three_way_export(places, detail, enrichment, "slug", "37122179", X.SOCIAL_DOMAINS)
    return out.select("slug", "halls", "emails", "events", "instagram", "detail_url", "competitor_info")


@query("jn7_left_enrich", "SELECT ord, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'Fashion' END AS vertical, CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS size FROM {leads} JOIN customer ON cust = c_custkey")
def _(t):
    lookup = t.customer.filter("c_acctbal > 0").select(F.concat(F.lit(" "), F.lower("c_name")).alias("name"), F.col("c_mktsegment").alias("vertical"), F.col("c_nationkey").cast("string").alias("size"))
    leads = t.leads.select("ord", F.concat(F.lit("Customer#"), F.lpad("cust", 9, "0"), F.lit("  ")).alias("name"))
    return J.left_enrich(leads, lookup, "name", ["vertical", "size"], True, {"vertical": "Fashion"}).select("ord", "vertical", "size")


@query("jn9_rules_join", "SELECT request_num, CASE WHEN contains(url, 'diy') THEN 'diy' WHEN contains(url, 'electro') THEN 'electronics' WHEN contains(url, 'seller') THEN 'generic' END AS rule FROM {requests}")
def _(t):
    rules = t.spark.createDataFrame([(0, "diy", "diy"), (1, "electronics", "electro"), (2, "generic", "seller"), (3, "never", "zzz")], "priority int, name string, pattern string")
    return J.rules_join(t.requests.select("request_num", "url"), rules, "url").select("request_num", "rule")


@query("jn10_pending_only", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.pending_only(t.customer.select("c_custkey"), done, "c_custkey")


@query("jn11_crm_new_only", "SELECT ord FROM {leads} WHERE cust NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(t):
    crm = t.customer.filter("c_acctbal > 5000").select(F.upper(F.replace("c_name", F.lit("#"), F.lit("   #"))).alias("name"))
    return J.crm_new_only(t.leads, crm).select("ord")


@query(
    "jn12_cache_lookup",
    f"""SELECT c_custkey AS id, round(date_diff('microsecond', m, {NOW}) / 3600000000, 4) AS age_hours, m IS NOT NULL AND date_diff('microsecond', m, {NOW}) / 3600000000 <= 8760 AS hit, CASE WHEN date_diff('microsecond', m, {NOW}) / 3600000000 <= 8760 THEN 'p' || CAST(c_custkey AS VARCHAR) END AS payload
      FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders WHERE o_orderdate < {NOW} GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
def _(t):
    last = t.orders.filter(f"o_orderdate < {NOW_NTZ}").groupBy("o_custkey").agg(F.max("o_orderdate").alias("cached_at"))
    site = lambda c: F.concat(F.lit("https://C"), c, F.lit(".example.com/shop"))
    cache = last.select(U.domain_key(site("o_custkey")).alias("key"), "cached_at", F.concat(F.lit("p"), "o_custkey").alias("payload"))
    urls = t.customer.select(F.col("c_custkey").alias("id"), F.concat(site("c_custkey"), F.lit("/?x=1")).alias("url"))
    return J.cache_lookup(urls, cache, F.expr(NOW_NTZ), 8760).select("id", F.round("age_hours", 4).alias("age_hours"), "hit", "payload")


@query(
    "jn13_conditional_headers",
    "SELECT id, concat_ws('|', 'If-Modified-Since=' || nullif(retry_after, 'soon'), 'If-None-Match=' || etag) AS headers FROM {responses} WHERE kind IN ('click', 'view') UNION ALL SELECT id, '' FROM {responses} WHERE kind NOT IN ('click', 'view')",
)
def _(t):
    url = F.concat(F.lit("https://x.example.com/"), "id")
    fresh = F.col("kind").isin("click", "view")
    cache = t.responses.select(
        U.url_key(url).alias("key"), "etag", F.when(F.col("retry_after") == "soon", "").otherwise(F.col("retry_after")).alias("last_modified"),
        F.when(fresh, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).otherwise(F.expr("TIMESTAMP_NTZ '2023-01-01 00:00:00'")).alias("cached_at"),
    )
    out = J.conditional_headers(t.responses.select("id", url.alias("url")), cache, F.expr("TIMESTAMP_NTZ '2024-01-01 23:00:00'"), 24)
    return out.select("id", map_to_text(F.col("headers")).alias("headers"))


@query("jn14_fan_back", "SELECT id, url, 'body of ' || url AS response FROM {responses}")
def _(t):
    calls = t.responses.select("id", "url")
    fetched = J.distinct_calls(calls, "url").withColumn("response", F.concat(F.lit("body of "), "url"))
    return J.fan_back(calls, fetched, "url")


@query("jn16_share_donor_link", "WITH d AS (SELECT cust, arg_min(store_url, ord) FILTER (WHERE store_url <> '') AS donor FROM {leads} GROUP BY cust) SELECT ord, coalesce(nullif(store_url, ''), donor, store_url) AS detail_link FROM {leads} JOIN d USING (cust)")
def _(t):
    previews = t.leads.select("ord", "cust", F.col("store_url").alias("detail_link"))
    return J.share_donor_link(previews, "cust", ["ord"]).select("ord", "detail_link")


@query("jn17_normalize_country", "SELECT ord, CASE WHEN n_regionkey = 1 THEN 'Land ' || CAST(n_nationkey AS VARCHAR) ELSE country END AS country FROM {leads} LEFT JOIN nation ON country = n_name")
def _(t):
    lookup = t.nation.filter("n_regionkey = 1").select(F.concat(F.lit(" "), F.lower("n_name")).alias("local"), F.concat(F.lit("Land "), "n_nationkey").alias("english"))
    return J.normalize_country(t.leads.select("ord", "country"), lookup)


@query(
    "jn8_backfill_links",
    """SELECT page_id, 0 AS idx, s_name AS name, '/e/' || CAST(page_id AS VARCHAR) AS detail_link FROM {listing_pages} JOIN supplier ON page_id = s_suppkey UNION ALL SELECT page_id, 1, 'Second ' || n_name, 'e/second' FROM {listing_pages} JOIN supplier ON page_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT page_id, 2, 'more', NULL FROM {listing_pages} UNION ALL SELECT page_id, 3, 'kept', '/own' FROM {listing_pages}""",
)
def _(t):
    dom = page_dom(t.listing_pages)
    names = select("h3.company-name")
    item = lambda i, n, link: F.struct(F.lit(i).alias("idx"), n.alias("name"), link.alias("detail_link"))
    none = F.lit(None).cast("string")
    items = dom.select("page_id", F.inline(F.array(
        item(0, node_text(F.get(names, F.lit(0))), none), item(1, node_text(F.get(names, F.lit(1))), none),
        item(2, F.lit("more"), none), item(3, F.lit("kept"), F.lit("/own")),
    )))
    boxes = dom.withColumns({"_b": select(".exhibitor-card"), "_a": select("a.detail-link")}).select(
        "page_id", F.posexplode(F.transform("_b", lambda b: F.struct(node_text(b).alias("text"), attr(first_inside(F.col("_a"), b), "href").alias("link")))).alias("idx", "_x")
    ).select("page_id", "idx", "_x.*")
    return J.backfill_links(items, boxes)


# --- quality -----------------------------------------------------------------------------

TEXT = ["name", "website", "country", "city", "email", "phone", "description", "address", "postal_code", "logo_url"]
FILLED = {
    **{f: f"NOT {D.blank(f)}" for f in [*TEXT, "marketplace_name", "store_url", "source_url"]},
    "product_categories": "cats_text <> ''", "brands": "coalesce(brands_text, '') <> ''",
    "social_media": "(social_linkedin IS NOT NULL OR social_facebook IS NOT NULL)", "status": "extra_status IS NOT NULL",
}
SHARE = {f: f"round(count(*) FILTER (WHERE {c}) / count(*), 3)" for f, c in FILLED.items()}
ALL = Q.CORE_FIELDS + Q.IMPORTANT_FIELDS + Q.OPTIONAL_FIELDS
SCORE = "((name + website + country) / 3 * 0.5::DOUBLE + (city + email + phone + description) / 4 * 0.35::DOUBLE + (address + postal_code + product_categories + brands + logo_url + social_media) / 6 * 0.15::DOUBLE)"
WIDE = "w AS (SELECT job, count(*) AS total_records, " + ", ".join(f"{SHARE[f]} AS {f}" for f in ALL) + " FROM {leads} GROUP BY job)"


@query("ag1_field_coverage", " UNION ALL ".join(f"SELECT job, '{f}' AS field, {SHARE[f]} AS coverage FROM {{leads}} GROUP BY job" for f in [*ALL, "status"]))
def _(t):
    return Q.field_coverage(lead_records(t), [*ALL, "status"], ["job"])


@query("ag2_quality_report", f"WITH {WIDE} SELECT *, round({SCORE}, 6) AS overall_score FROM w")
def _(t):
    return Q.quality_report(lead_records(t), ["job"]).withColumn("overall_score", F.round("overall_score", 6))


@query("ag2_quality_report_requested", f"SELECT job, count(*) AS total_records, {SHARE['email']} AS email, {SHARE['status']} AS status, round(({SHARE['email']} + {SHARE['status']}) / 2, 6) AS overall_score FROM {{leads}} GROUP BY job")
def _(t):
    return Q.quality_report(lead_records(t), ["job"], "email, status").withColumn("overall_score", F.round("overall_score", 6))


def _pct(c: str) -> str:
    return f"CAST(CAST(round_even({c} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"


@query(
    "ag3_quality_messages",
    f"WITH {WIDE}, n AS (SELECT job, count(*) FILTER (WHERE name <> '') AS named, count(DISTINCT lower({D.trim('name')})) FILTER (WHERE name <> '') AS uniq FROM {{leads}} GROUP BY job) SELECT job, concat_ws(' # ', "
    + ", ".join(f"CASE WHEN {f} < 0.5 THEN '{Q.MSG_CORE.format(f).replace(chr(39), chr(39) * 2)}' || {_pct(f)} || ')' END" for f in Q.CORE_FIELDS)
    + f", CASE WHEN total_records < 5 THEN 'Only ' || CAST(total_records AS VARCHAR) || '{Q.MSG_FEW}' END, CASE WHEN uniq < named * 0.9 THEN '~' || CAST(named - uniq AS VARCHAR) || '{Q.MSG_DUPLICATES}' END) AS warnings, concat_ws(' # ', "
    + f"CASE WHEN email < 0.3 THEN '{Q.MSG_EMAIL}' END, CASE WHEN website < 0.3 THEN '{Q.MSG_WEBSITE}' END, CASE WHEN description < 0.2 THEN '{Q.MSG_DESCRIPTION}' END, CASE WHEN {SCORE} >= 0.7 THEN '{Q.MSG_GOOD}' WHEN {SCORE} >= 0.4 THEN '{Q.MSG_MODERATE}' ELSE '{Q.MSG_LOW}' END) AS recommendations FROM w JOIN n USING (job)",
)
def _(t):
    m = Q.quality_messages(lead_records(t), ["job"])
    return m.select("job", F.array_join("warnings", " # ").alias("warnings"), F.array_join("recommendations", " # ").alias("recommendations"))


def _count(fields: list[str]) -> str:
    return " + ".join(f"CASE WHEN {FILLED[f]} THEN 1 ELSE 0 END" for f in fields)


@query(
    "ag4_parser_confidence",
    f"""WITH r AS (SELECT job, {_count(Q.CONFIDENCE_SCALARS)} AS s, {_count(Q.CONFIDENCE_STRUCTURED)} AS z, CASE WHEN {FILLED['name']} THEN 1 ELSE 0 END AS n FROM {{leads}}),
      a AS (SELECT job, count(*) AS c, CAST(sum(s) AS BIGINT) AS s, CAST(sum(z) AS BIGINT) AS z, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY job)
    SELECT job, c AS record_count, s AS non_empty_fields, c * 10 AS total_fields, z AS structured_non_empty, c * 3 AS structured_total, n AS name_present, round(0.2::DOUBLE + 0.6::DOUBLE * (s / (c * 10)) + 0.15::DOUBLE * (z / (c * 3)) + 0.05::DOUBLE * (n / c), 6) AS score,
      round(s / (c * 10), 4) AS scalar_ratio, round(z / (c * 3), 4) AS structured_ratio, round(n / c, 4) AS name_ratio FROM a""",
)
def _(t):
    return Q.parser_confidence(lead_records(t), ["job"]).withColumn("score", F.round("score", 6))


PREVIEW = " + ".join(f"CASE WHEN {FILLED[f]} THEN 1::DOUBLE ELSE 0::DOUBLE END" for f in Q.PREVIEW_FIELDS) + "".join(
    f" + CASE WHEN {FILLED[f]} THEN {p}::DOUBLE ELSE 0::DOUBLE END" for f, p in (("product_categories", 0.75), ("brands", 0.75), ("social_media", 0.5))
)


@query("ag5_preview_score", f"SELECT ord, {PREVIEW} AS score FROM {{leads}}")
def _(t):
    df = lead_records(t)
    return df.select("ord", Q.preview_score(df).alias("score"))


@query(
    "ag6_stage_confidence",
    """SELECT id, round(CASE WHEN n_records > 2 THEN 0.85 ELSE 0.55 END::DOUBLE + CASE WHEN n_pending > 0 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN st = 'O' THEN 0.05 ELSE 0 END::DOUBLE, 6) AS planning, CASE WHEN n_records * 3 >= 10 THEN 0.9 WHEN n_records > 0 THEN 0.7 ELSE 0.2 END::DOUBLE AS scraping, CASE WHEN n_records > 0 THEN 0.9 ELSE 0.35 END::DOUBLE AS output FROM {jobs}""",
)
def _(t):
    n = F.col("n_records")
    return t.jobs.select(
        "id", F.round(Q.planning_confidence(n > 2, F.col("n_pending") > 0, F.col("st") == "O"), 6).alias("planning"),
        Q.scraping_confidence(n * 3).alias("scraping"), Q.output_confidence(n).alias("output"),
    )


@query(
    "ag7_job_counters",
    """SELECT job, count(*) FILTER (WHERE stage = 'scraping_pages') AS pages_processed, CAST(coalesce(sum(greatest(page_items, 0)) FILTER (WHERE stage = 'scraping_pages'), 0) AS BIGINT) AS items_extracted,
      count(*) FILTER (WHERE stage = 'scraping_pages' AND page_items = 0) AS empty_pages, count(*) FILTER (WHERE stage = 'method_fallback') AS method_fallbacks, CAST(0 AS BIGINT) AS method_switches FROM {progress} GROUP BY job""",
)
def _(t):
    return Q.job_counters(t.progress, "job")


@query(
    "ag8_provider_summary",
    """SELECT job, count(*) AS event_count, round(coalesce(sum(coalesce(estimated_cost_usd, CASE WHEN provider = 'openai' THEN CASE WHEN method IN ('css', 'auto') THEN 0.002 ELSE 0.006 END END)), 0), 6) AS estimated_total_cost_usd,
      CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS estimated_input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS estimated_output_tokens FROM {calls} GROUP BY job""",
)
def _(t):
    return Q.provider_summary(t.calls, "job")


@query("ag11_fill_stats", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ('', 'nan', 'N/A')) AS filled, count(*) AS total FROM {{leads}}" for c in ("website", "social_linkedin", "country", "phone")))
def _(t):
    return Q.fill_stats(t.leads, ["website", "social_linkedin", "country", "phone"], ["", "nan", "N/A"])


@query("ag12_value_counts", "SELECT marketplace_name, count(*) AS n FROM {leads} GROUP BY marketplace_name")
def _(t):
    return Q.value_counts(t.leads, "marketplace_name")


@query("ag13_scrape_outcomes", "SELECT source, count(*) FILTER (WHERE n_chars > 400) AS found, count(*) FILTER (WHERE n_chars <= 400 AND n_chars > 100) AS empty, count(*) FILTER (WHERE n_chars <= 100) AS errors, count(*) AS processed FROM documents GROUP BY source")
def _(t):
    n = F.col("n_chars")
    tagged = t.documents.withColumn("status", F.when(n > 400, "ok").when(n > 100, "empty").otherwise("error"))
    return Q.scrape_outcomes(tagged, ["source"])


@query(
    "ag14_items_per_page",
    """SELECT source_url, 'item' AS kind, row_number() OVER (PARTITION BY source_url ORDER BY ord) AS pos, NULL AS detail_url, name AS value FROM {leads}
      UNION ALL SELECT source_url, 'detail', NULL, store_url, arg_max(name, ord) FROM {leads} WHERE store_url <> '' AND name <> '' GROUP BY source_url, store_url""",
)
def _(t):
    return Q.items_per_page(t.leads, "source_url", ["ord"], "name", "store_url", "name")


@query(
    "ag15_script_complexity",
    f"""SELECT id, concat_ws('; ', CASE WHEN nc = 0 THEN '{Q.MSG_NO_CANDIDATE}' END, CASE WHEN n_records < 3 THEN 'CSS selectors matched only ' || CAST(n_records AS VARCHAR) || ' item containers' END, CASE WHEN score < 0.3 THEN 'only ' || {_pct('score')} || ' of field selectors found data' END, CASE WHEN nc = 1 AND n_pending < 2 THEN '{Q.MSG_LITTLE_CONTACT}' END) AS reasons
      FROM (SELECT *, id % 3 AS nc FROM {{jobs}})""",
)
def _(t):
    rows = t.jobs.select("id", (F.col("id") % 3).alias("n_candidates"), F.col("n_records").alias("container_count"), F.col("score").alias("field_hit_ratio"), F.col("n_pending").alias("contact_filled"))
    return rows.select("id", F.array_join(Q.script_complexity(), "; ").alias("reasons"))


# --- windows -----------------------------------------------------------------------------

STREAK = """r AS (SELECT *, row_number() OVER w AS pages_processed, max(CASE WHEN {hit} THEN NULL ELSE rn END) OVER w AS last_reset FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts, ord) AS rn FROM {src}) WINDOW w AS (PARTITION BY {k} ORDER BY ts, ord ROWS UNBOUNDED PRECEDING))"""
ZERO = STREAK.replace("{hit}", "page_items = 0").replace("{k}", "job").replace("{src}", "{progress}")
ERRORS = STREAK.replace("{hit}", "failed").replace("{k}", "provider").replace("{src}", "{calls}")


@query("wn1_zero_streak", f"WITH {ZERO} SELECT ord, pages_processed, rn - coalesce(last_reset, 0) AS zero_streak FROM r")
def _(t):
    return O.zero_streak(t.progress, ["job"], ["ts", "ord"], "page_items").select("ord", "pages_processed", "zero_streak")


@query("wn1_zero_streak_chunked", f"WITH {ZERO} SELECT ord, pages_processed, rn - coalesce(last_reset, 0) AS zero_streak FROM r")
def _(t):
    # the two-level path for inputs beyond one chunk
    return O.zero_streak(t.progress, ["job"], ["ts", "ord"], "page_items", rows_per_chunk=1500).select("ord", "pages_processed", "zero_streak")


@query("wn2_switch_points", f"WITH {ZERO}, h AS (SELECT *, rn - coalesce(last_reset, 0) AS z FROM r), p AS (SELECT job, min(rn) AS rn FROM h WHERE rn >= 3 AND z >= 2 GROUP BY job) SELECT h.job, h.ord, h.pages_processed, h.z AS zero_streak FROM h JOIN p ON h.job = p.job AND h.rn = p.rn")
def _(t):
    return O.switch_points(t.progress, ["job"], ["ts", "ord"], "page_items").select("job", "ord", "pages_processed", "zero_streak")


@query("wn3_best_candidate", f"WITH s AS (SELECT cust, booth, ord, {PREVIEW} AS score FROM {{leads}}), r AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY score DESC, ord) AS rn FROM s) SELECT cust, max(ord) FILTER (WHERE rn = 1) AS best_method, max(score) FILTER (WHERE rn = 1) AS best_score, greatest(max(score) FILTER (WHERE rn = 1) - coalesce(max(score) FILTER (WHERE rn = 2), 0), 0) AS margin FROM r WHERE rn <= 2 GROUP BY cust")
def _(t):
    df = lead_records(t)
    return O.best_candidate(df, "cust", "ord", Q.preview_score(df), ["ord"])


@query("wn4_latest_two", "SELECT report, row_number() OVER (ORDER BY report DESC) AS rank FROM (SELECT DISTINCT report FROM {run_results}) ORDER BY report DESC LIMIT 2")
def _(t):
    return O.latest_two(t.run_results.select("report").distinct(), "report")


@query("wn5_status_timeline", "SELECT id, strftime(created_at, '%Y-%m-%d') || ' status=' || status || CASE WHEN error IS NULL THEN '' ELSE ' reason=' || error END AS line FROM {jobs}")
def _(t):
    return O.status_timeline(t.jobs, F.date_format("created_at", "yyyy-MM-dd"), "status", "error").select("id", "line")


@query("wn6_breaker_windows", f"WITH {ERRORS} SELECT ord, provider, rn - coalesce(last_reset, 0) AS consecutive_errors, ts + INTERVAL 600 SECONDS AS disabled_until FROM r WHERE failed AND rn - coalesce(last_reset, 0) >= 3")
def _(t):
    return O.breaker_windows(t.calls, ["provider"], "ts", ["ts", "ord"], F.col("failed")).select("ord", "provider", "consecutive_errors", "disabled_until")


PACK = """WITH RECURSIVE n AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
  p AS (SELECT conv_id, turn, rn, size AS used, CAST(0 AS BIGINT) AS batch FROM n WHERE rn = 1 UNION ALL
    SELECT n.conv_id, n.turn, n.rn, CASE WHEN p.used + n.size > 1500 THEN n.size ELSE p.used + n.size END, CASE WHEN p.used + n.size > 1500 THEN p.batch + 1 ELSE p.batch END FROM p JOIN n ON n.conv_id = p.conv_id AND n.rn = p.rn + 1)
  SELECT conv_id, turn, batch FROM p"""


@query("wn7_pack_batches", PACK)
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))
    return O.pack_batches(rows, "size", 1500, ["turn"], ["conv_id"]).select("conv_id", "turn", "batch")


@query("wn7_pack_batches_chunked", PACK)
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))
    return O.pack_batches(rows, "size", 1500, ["turn"], ["conv_id"], rows_per_chunk=100).select("conv_id", "turn", "batch")


@query("wn8_fixed_batches", "SELECT ord, job, (row_number() OVER (PARTITION BY job ORDER BY ord) - 1) // 15 AS batch FROM {leads}")
def _(t):
    return O.fixed_batches(t.leads.select("ord", "job"), 15, ["ord"], ["job"])


@query("wn9_carry_forward_group", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup FROM events")
def _(t):
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    return O.carry_forward_group(rows, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "signup").select("event_id", "user_id", "signup")


@query("wn9_carry_forward_group_chunked", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup FROM events")
def _(t):
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    marker = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return O.carry_forward_group(rows, ["user_id"], ["ts", "event_id"], marker, "signup", rows_per_chunk=1500).select("event_id", "user_id", "signup")


# --- limits ------------------------------------------------------------------------------


@query("tk1_limit_items", "SELECT ord, job FROM (SELECT ord, job, row_number() OVER (PARTITION BY job ORDER BY ord) AS rn FROM {leads}) WHERE rn <= 250")
def _(t):
    return O.limit_items(t.leads.select("ord", "job"), 250, ["ord"], ["job"])


@query("tk1_limit_items_large", "SELECT ord, job FROM (SELECT ord, job, row_number() OVER (PARTITION BY job ORDER BY ord) AS rn FROM {leads}) WHERE rn <= 2000")
def _(t):
    return O.limit_items(t.leads.select("ord", "job"), 2000, ["ord"], ["job"])


@query("tk2_top_counter_rows", "SELECT ord, empty_pages FROM {run_results} WHERE empty_pages > 0 ORDER BY empty_pages DESC, ord LIMIT 5")
def _(t):
    return R.top_counter_rows(t.run_results, "empty_pages", ["ord"]).select("ord", "empty_pages")


@query("tk3_lowest_rows", "SELECT ord, scalar_ratio FROM {run_results} ORDER BY scalar_ratio, ord LIMIT 5")
def _(t):
    return R.lowest_rows(t.run_results, "scalar_ratio", ["ord"]).select("ord", "scalar_ratio")


@query("tk4_top_failure_reasons", "SELECT reason, n AS count FROM (SELECT CASE WHEN trim(reason) = '' THEN 'unspecified' ELSE trim(reason) END AS reason, count(*) AS n, min(ord) AS f FROM {run_results} WHERE NOT passed GROUP BY 1) ORDER BY n DESC, f LIMIT 5")
def _(t):
    return R.top_failure_reasons(t.run_results.filter(~F.col("passed")), "reason", ["ord"])


@query("tk5_by_priority", "SELECT request_num, CASE priority WHEN 'Urgent' THEN 0 WHEN 'Normal' THEN 1 ELSE 2 END AS priority_rank FROM {requests}")
def _(t):
    return R.by_priority(t.requests, ["request_num"]).select("request_num", "priority_rank")


@query("tk6_jobs_recent_first", "SELECT id, created_at FROM {jobs}")
def _(t):
    return R.jobs_recent_first(t.jobs, "created_at", ["id"]).select("id", "created_at")


@query("tk7_top_verifiable", "SELECT ord FROM {leads} WHERE job IN ('BUILDING', 'MACHINERY') AND coalesce(email, '') NOT IN ('not found', 'error', '') AND NOT contains(coalesce(city, ''), 'none') ORDER BY ord LIMIT 50")
def _(t):
    rows = t.leads.select(
        "ord", F.when(F.col("job") == "BUILDING", "high").when(F.col("job") == "MACHINERY", "medium").otherwise("low").alias("confidence"),
        F.col("email").alias("total_annual_revenue"), F.when(F.contains("city", F.lit("none")), "web verified").alias("revenue_source"),
    )
    return R.top_verifiable(rows, ["ord"]).select("ord")


# --- reports -----------------------------------------------------------------------------

SUMMARY = "s AS (SELECT report, count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, count(*) FILTER (WHERE passed) / count(*) AS pass_rate, avg(empty_pages) AS avg_empty_pages, avg(method_switches) AS avg_method_switches, avg(scalar_ratio) AS avg_parser_scalar_ratio, avg(structured_ratio) AS avg_parser_structured_ratio FROM {run_results} GROUP BY report)"
FAILED = "f AS (SELECT DISTINCT report, CASE WHEN profile_name = '' THEN 'unknown-profile' ELSE profile_name END AS p FROM {run_results} WHERE NOT passed)"


@query("ag9_summarize_run", f"WITH {SUMMARY} SELECT report, total, passed, failed, " + ", ".join(f"round({m}, 6) AS {m}" for m in R.METRICS) + " FROM s")
def _(t):
    return R.summarize_run(t.run_results, "report").select("report", "total", "passed", "failed", *[F.round(m, 6).alias(m) for m in R.METRICS])


@query("so2_new_failures", f"WITH {FAILED}, r AS (SELECT report, row_number() OVER (ORDER BY report DESC) AS rk FROM (SELECT DISTINCT report FROM {{run_results}})) SELECT p AS profile_name FROM f JOIN r USING (report) WHERE rk = 1 EXCEPT SELECT p FROM f JOIN r USING (report) WHERE rk = 2")
def _(t):
    two = O.latest_two(t.run_results.select("report").distinct(), "report")
    failed = R.failed_profiles(t.run_results, "report").join(two, "report")
    return R.new_failures(failed.filter("rank = 2"), failed.filter("rank = 1"))


def _issue(name: str, expr: str, limit: float) -> str:
    return f"CASE WHEN {expr} > {limit}::DOUBLE THEN '{name}=' || format('{{:.3f}}', {expr}) || ' exceeds threshold {limit:.3f}' END"


ISSUES = ", ".join([
    _issue("pass_rate_drop", "a.pass_rate - b.pass_rate", 0.1), _issue("avg_empty_pages_increase", "b.avg_empty_pages - a.avg_empty_pages", 2.0),
    _issue("avg_method_switches_increase", "b.avg_method_switches - a.avg_method_switches", 1.0), _issue("avg_parser_scalar_drop", "a.avg_parser_scalar_ratio - b.avg_parser_scalar_ratio", 0.1),
    _issue("avg_parser_structured_drop", "a.avg_parser_structured_ratio - b.avg_parser_structured_ratio", 0.1),
    "CASE WHEN nf.n > 0 THEN 'new_failed_profiles=' || nf.names || ' exceeds allowed count 0' END",
])


@query(
    "cl3_compare_runs",
    f"WITH {SUMMARY}, {FAILED}, o AS (SELECT report, lag(report) OVER (ORDER BY report) AS prev FROM s), nf AS (SELECT f.report, count(*) AS n, string_agg(f.p, ', ' ORDER BY f.p) AS names FROM f JOIN o ON f.report = o.report WHERE o.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f g WHERE g.report = o.prev AND g.p = f.p) GROUP BY f.report) "
    f"SELECT report, prev_report, concat_ws(' # ', {ISSUES}) = '' AS ok, concat_ws(' # ', {ISSUES}) AS issues FROM (SELECT o.report, o.prev AS prev_report FROM o WHERE prev IS NOT NULL) x JOIN s b USING (report) JOIN s a ON a.report = x.prev_report LEFT JOIN nf USING (report)",
)
def _(t):
    return R.compare_runs(t.run_results, "report").select("report", "prev_report", "ok", F.array_join("issues", " # ").alias("issues"))


@query(
    "cl4_trend_table",
    f"WITH {SUMMARY} SELECT report, total, failed, round(pass_rate, 6) AS pass_rate, " + ", ".join(f"round({m} - lag({m}) OVER (ORDER BY report), 6) AS delta_{m}" for m in R.METRICS) + " FROM s",
)
def _(t):
    return R.trend_table(t.run_results, "report").select("report", "total", "failed", F.round("pass_rate", 6).alias("pass_rate"), *[F.round(f"delta_{m}", 6).alias(f"delta_{m}") for m in R.METRICS])


@query(
    "cl5_issue_summary",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY report, passed ORDER BY ord) AS rn FROM {run_results}) SELECT report, count(*) AS total, count(*) FILTER (WHERE NOT passed) AS failed, coalesce(string_agg(CASE WHEN profile_name = '' THEN 'unknown-profile' ELSE profile_name END, ', ' ORDER BY ord) FILTER (WHERE NOT passed AND rn <= 20), '') AS failed_profiles FROM r GROUP BY report""",
)
def _(t):
    return R.issue_summary(t.run_results, "report", ["ord"], 20).withColumn("failed_profiles", F.array_join("failed_profiles", ", "))


@query(
    "cl5_issue_summary_stored",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY ord) AS rn FROM {run_results} WHERE NOT passed), c AS (SELECT report, count(*) AS n FROM {run_results} GROUP BY report),
      t AS (SELECT report, CASE WHEN n % 3 = 0 THEN 0 ELSE n + 5 END AS total, CASE WHEN n % 2 = 0 THEN CASE WHEN n % 3 = 0 THEN 0 ELSE 3 END ELSE 2 + CASE WHEN n % 3 = 0 THEN -2 ELSE n END END AS failed FROM c)
    SELECT t.report, t.total, CASE WHEN t.failed < 0 THEN 0 ELSE t.failed END AS failed, coalesce((SELECT string_agg(CASE WHEN profile_name = '' THEN 'unknown-profile' ELSE profile_name END, ', ' ORDER BY ord) FROM r WHERE r.report = t.report AND rn <= 3), '') AS failed_profiles FROM t""",
)
def _(t):
    n = F.col("n")
    # totals as reports carry them: some without a total, some without the number of failures
    stored = t.run_results.groupBy("report").agg(F.count("*").alias("n")).select(
        "report", F.when(n % 3 != 0, n + 5).alias("total"), F.lit(3).alias("passed"), F.when(n % 2 == 0, F.when(n % 3 == 0, 0).otherwise(3)).alias("failed")
    )
    return R.issue_summary(t.run_results, "report", ["ord"], 3, stored).withColumn("failed_profiles", F.array_join("failed_profiles", ", "))


@query(
    "fl10_evaluate_pass",
    """WITH j AS (SELECT *, CASE WHEN id % 4 = 0 THEN NULL ELSE id % 5 END AS need, CASE WHEN id % 3 = 0 THEN 0.5 ELSE 0 END AS bar, CASE WHEN st = 'F' THEN 'partial' ELSE upper(status) END AS s2, CASE WHEN id % 7 = 0 THEN false END AS ap FROM {jobs}),
      v AS (SELECT id, n_records, CASE WHEN lower(s2) = 'failed' THEN 'job failed' WHEN s2 = 'partial' AND NOT coalesce(ap, true) THEN 'partial not allowed by profile' WHEN lower(s2) NOT IN ('completed', 'partial') THEN 'unexpected final status=' || lower(s2)
        WHEN n_records < coalesce(need, 1) THEN 'record_count ' || CAST(n_records AS VARCHAR) || ' < expected minimum ' || CAST(coalesce(need, 1) AS VARCHAR) WHEN bar > 0 AND coalesce(score, 0) < bar THEN 'quality_score ' || format('{:.3f}', coalesce(score, 0)) || ' < expected minimum ' || format('{:.3f}', bar::DOUBLE) ELSE 'ok' END AS reason FROM j)
    SELECT id, reason = 'ok' AS passed, reason, n_records AS count FROM v""",
)
def _(t):
    j = t.jobs
    status = F.when(F.col("st") == "F", "partial").otherwise(F.upper("status"))
    verdict = R.evaluate_pass(
        status, F.col("n_records"), F.col("score"), F.when(F.col("id") % 4 != 0, F.col("id") % 5), F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.0), F.when(F.col("id") % 7 == 0, False)
    )
    return j.select("id", verdict.alias("v")).select("id", "v.*")


# --- lifecycle ---------------------------------------------------------------------------

ACTIVE = "status IN ('pending', 'planning', 'scraping', 'parsing', 'output')"


@query(
    "cl6_recover_jobs",
    f"""WITH j AS (SELECT *, {ACTIVE} AS act, CASE WHEN NOT ({ACTIVE}) THEN status WHEN n_pending > 0 THEN 'partial' ELSE 'failed' END AS ns FROM {{jobs}})
    SELECT id, ns AS status, CASE WHEN act AND n_pending <= 0 THEN coalesce(error, '{L.INTERRUPTED}') ELSE error END AS error, CASE WHEN act THEN 'start|T status=' || status || ' reason=interrupted_previous_process|T status=' || ns || ' reason=recovered_from_interrupted_process' ELSE 'start' END AS timeline,
      CASE WHEN act THEN 'unknown/' || CASE WHEN status IN ('pending', 'planning') THEN 'planning' ELSE status END ELSE '' END AS failure FROM j""",
)
def _(t):
    none = "array<struct<category:string,stage:string,message:string,retryable:boolean,previous_status:string>>"
    jobs = t.jobs.select("id", "status", "error", "n_pending", F.array(F.lit("start")).alias("timeline"), F.array().cast(none).alias("failures"))
    out = L.recover_jobs(jobs, F.lit("T"))
    last = F.get("failures", F.lit(0))
    return out.select("id", "status", "error", F.array_join("timeline", "|").alias("timeline"), F.coalesce(F.concat(last["category"], F.lit("/"), last["stage"]), F.lit("")).alias("failure"))


@query(
    "cl7_final_status",
    "SELECT id, CASE WHEN coalesce(score, 0) < 0.3 THEN 'partial' WHEN n_pending > 0 THEN 'partial' ELSE 'completed' END AS status, coalesce(score, 0) < 0.3 AS quality_failure, CASE WHEN coalesce(score, 0) < 0.3 THEN 'Quality score ' || format('{:.3f}', coalesce(score, 0)) || ' below configured threshold 0.300' END AS message FROM {jobs}",
)
def _(t):
    return t.jobs.select("id", L.final_status(F.col("score"), F.col("n_pending"), 0.3, True).alias("f")).select("id", "f.*")


@query("cl8_status_to_stage", "SELECT id, CASE WHEN status IN ('pending', 'planning', 'plan_review', 'preview') THEN 'planning' WHEN status IN ('scraping', 'parsing') THEN status ELSE 'output' END AS stage FROM {jobs}")
def _(t):
    return t.jobs.select("id", L.status_to_stage(F.col("status")).alias("stage"))


@query("cl11_plan_template_stats", "SELECT lower(replace(name, '#', '')) AS filename, name, 'https://x/' || CAST(id AS VARCHAR) AS url, method AS extraction_method, CAST(n_records AS INTEGER) AS records_scraped, CAST(id AS VARCHAR) AS source_job_id, status AS source_job_status FROM {jobs}")
def _(t):
    records = F.array_repeat(F.create_map(F.lit("name"), F.col("name")), F.col("n_records").cast("int"))
    jobs = t.jobs.select(
        "name", F.col("id").cast("string").alias("id"), "status", F.struct(F.concat(F.lit("https://x/"), "id").alias("url")).alias("request"),
        F.col("method").alias("extraction_method"), F.struct(records.alias("records")).alias("result"),
    )
    return L.plan_template_stats(jobs)


@query("cl12_cache_inventory", f"SELECT left(sha256('https://x/' || CAST(id AS VARCHAR)), 20) AS key, CASE WHEN error IS NULL THEN '?' ELSE error END AS url, round(date_diff('microsecond', created_at, {NOW}) / 3600000000, 1) AS age_hours FROM {{jobs}}")
def _(t):
    cache = t.jobs.select(U.url_key(F.concat(F.lit("https://x/"), "id")).alias("key"), F.col("error").alias("url"), F.col("created_at").alias("cached_at"))
    return L.cache_inventory(cache, F.expr(NOW_NTZ))


@query("so3_added_fields", "SELECT id, CASE WHEN n_records > 3 THEN 'city;phone' ELSE 'city' END AS added, CASE WHEN n_records > 3 THEN 'city=.c|name=.n|phone=.p' ELSE 'city=.c|name=.n' END AS merged FROM {jobs}")
def _(t):
    a = F.create_map(F.lit("name"), F.lit(".n"))
    b = F.when(F.col("n_records") > 3, F.create_map(F.lit("name"), F.lit(".other"), F.lit("city"), F.lit(".c"), F.lit("phone"), F.lit(".p"))).otherwise(
        F.create_map(F.lit("name"), F.lit(".other"), F.lit("city"), F.lit(".c")))
    added, merged = L.added_fields(a, b)
    return t.jobs.select("id", F.array_join(added, ";").alias("added"), map_to_text(merged).alias("merged"))


@query("so4_split_done_pending", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS done FROM customer")
def _(t):
    done = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.split_done_pending(t.customer.select("c_custkey"), done, "c_custkey")
