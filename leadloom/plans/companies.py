"""Queries over filters, deduplication, merges and the company master."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import text as X
from leadloom.operators import classify as C
from leadloom.operators import dedup as DD
from leadloom.operators import filters as FL
from leadloom.operators import joins as J
from leadloom.operators import merge as M
from leadloom.operators import quality as Q
from leadloom.plans import duck as D
from leadloom.plans.registry import Tables, query
from leadloom.sources import writers as W

LEAD_TEXT = ["country", "city", "address", "postal_code", "website", "email", "phone", "description", "logo_url"]


def lead_records(t: Tables):
    """Leads with list and map fields, as a parse step delivers them."""
    socials = F.map_filter(
        F.create_map(F.lit("linkedin"), "social_linkedin", F.lit("facebook"), "social_facebook"), lambda k, v: v.isNotNull()
    )
    extra = F.map_filter(F.create_map(F.lit("status"), F.col("extra_status")), lambda k, v: v.isNotNull())
    return t.leads.select(
        "*", X.split_list("cats_text").alias("product_categories"), X.split_list("brands_text").alias("brands"),
        socials.alias("social_media"), extra.alias("raw_extra"),
    )


# --- filters -----------------------------------------------------------------------------


@query("fl1_drop_unnamed", f"SELECT ord, businessName FROM {{seller_sheet}} WHERE NOT {D.blank('businessName')}")
def _(t):
    return FL.drop_unnamed(t.seller_sheet, "businessName").select("ord", "businessName")


@query("fl2_drop_placeholder_sellers", f"SELECT ord, businessName FROM {{seller_sheet}} WHERE NOT regexp_matches(businessName, '(?i)not found|error|unknown') AND length({D.clean('businessName')}) >= 2")
def _(t):
    return FL.drop_placeholder_sellers(t.seller_sheet, "businessName").select("ord", "businessName")


@query("fl3_drop_empty_sellers", "SELECT ord FROM {leads} WHERE coalesce(store_url, '') <> '' OR coalesce(website, '') <> '' OR description IS NOT NULL")
def _(t):
    return FL.drop_empty_sellers(t.leads, ["store_url", "website", "description"]).select("ord")


@query("fl4_not_found_pages", "SELECT page_id FROM {detail_pages} WHERE page_id % 10 = 9")
def _(t):
    named = t.detail_pages.withColumn("name", X.clean_text(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
    return FL.not_found_pages(named, "name", "html").select("page_id")


@query("fl5_drop_errors", "SELECT id, n FROM {responses} WHERE kind <> 'error'")
def _(t):
    return FL.drop_errors(t.responses.withColumn("error", F.when(F.col("kind") == "error", "404"))).select("id", "n")


@query("fl6_drop_social_as_website", "SELECT ord, CASE WHEN ord % 5 < 2 THEN '' ELSE website END AS website FROM {leads}")
def _(t):
    return t.leads.select("ord", X.drop_social_website(F.coalesce("social_linkedin", "website")).alias("website"))


@query("fl7_actionable_requests", "SELECT request_num, url FROM {requests} WHERE status = 'New'")
def _(t):
    return FL.actionable_requests(t.requests).select("request_num", "url")


@query("fl8_enabled_profiles", "SELECT request_num FROM {requests} WHERE priority <> 'Low' ORDER BY request_num LIMIT 500")
def _(t):
    flags = t.requests.withColumn("enabled", F.when(F.col("priority") == "Low", False).when(F.col("priority") == "Urgent", True))
    return FL.enabled_profiles(flags, 500, ["request_num"]).select("request_num")


SHEET = ["sellerId", "businessName", "address", "registeredAddress", "zipCode", "rating", "reviewCount", "vatNumber", "sparse_tokens", "sparse_nulls", "half_half"]
FILL_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE {D.trim(c)} IN ('', 'nan', 'None', 'N/A', 'null')) AS empties, count(*) AS n FROM {{seller_sheet}}" for c in SHEET
)


@query("fl9_sparse_columns", f"SELECT col AS \"column\", nulls, empties, n AS rows, nulls = n OR nulls / n >= 0.95 OR empties / n >= 0.95 AS sparse FROM ({FILL_SQL})")
def _(t):
    return FL.sparse_columns(FL.column_fill(t.seller_sheet, SHEET))


@query("fl9_drop_sparse_columns", f"SELECT ord, {D.clean('zipCode')} AS zipCode, {D.clean('rating')} AS rating, {D.clean('half_half')} AS half_half FROM {{seller_sheet}}")
def _(t):
    kept = FL.drop_sparse_columns(t.seller_sheet)
    wanted = {"ord", "zipCode", "rating", "half_half", "sparse_tokens", "sparse_nulls"}
    return kept.select(*[c for c in kept.columns if c in wanted])


@query("fl11_drop_internal_fields", "SELECT ord, CASE WHEN hall IS NULL THEN 1 ELSE 2 END AS n FROM {leads}")
def _(t):
    from leadloom.functions.nested import drop_internal_fields

    m = F.map_filter(F.create_map(F.lit("_id"), "name", F.lit("hall"), "hall", F.lit("name"), "name"), lambda k, v: v.isNotNull())
    return t.leads.select("ord", F.size(drop_internal_fields(m)).alias("n"))


# --- deduplication -----------------------------------------------------------------------

ITEM_SQL = f"""i AS (SELECT ord, job, CASE WHEN ord % 3 = 0 THEN store_url ELSE '' END AS link, name, lower({D.trim('name')}) AS n, lower({D.trim('country')}) AS c, country FROM {{leads}}),
  k AS (SELECT *, CASE WHEN link <> '' THEN link ELSE n || '||' || concat_ws('|', CASE WHEN country <> '' THEN c END, n) END AS key FROM i)"""


def _items(t):
    item = F.create_map(
        F.lit("name"), "name", F.lit("country"), "country",
        F.lit("detail_link"), F.when(F.col("ord") % 3 == 0, F.col("store_url")).otherwise(F.lit("")),
    )
    return t.leads.select("ord", "job", item.alias("item"))


@query("mg1_dedup_items", f"WITH {ITEM_SQL} SELECT job, min(ord) AS ord FROM k GROUP BY job, key")
def _(t):
    return DD.dedup_items(_items(t), "item", ["ord"], ["job"]).select("job", "ord")


@query("mg1_dedup_items_limited", f"WITH {ITEM_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ord) AS rn FROM k) SELECT job, min(ord) AS ord FROM l WHERE rn <= 900 GROUP BY job, key")
def _(t):
    return DD.dedup_items(_items(t), "item", ["ord"], ["job"], max_items=900).select("job", "ord")


LEAD_KEY = f"lower({D.trim('name')}) AS k1, lower({D.trim('''CASE WHEN coalesce(website, '') <> '' THEN website ELSE source_url END''')}) AS k2"


@query("mg2_dedup_leads", f"SELECT min(ord) AS ord, arg_min(name, ord) AS name FROM (SELECT *, {LEAD_KEY} FROM {{leads}}) GROUP BY k1, k2")
def _(t):
    return DD.dedup_leads(t.leads, ["ord"]).select("ord", "name")


@query("mg3_dedup_by", "SELECT min(ord) AS ord, cust FROM {leads} GROUP BY cust")
def _(t):
    return DD.dedup_by(t.leads, "cust", ["ord"]).select("ord", "cust")


@query("so1_resume_union", f"""WITH l AS (SELECT *, {LEAD_KEY}, CASE WHEN job < 'F' THEN 0 ELSE 1 END AS run FROM {{leads}}), r AS (SELECT ord, row_number() OVER (PARTITION BY k1, k2 ORDER BY run, ord) AS rn FROM l) SELECT ord FROM r WHERE rn = 1""")
def _(t):
    first = F.col("job") < "F"
    return DD.resume_union(t.leads.filter(first), t.leads.filter(~first), ["ord"]).select("ord")


# --- merges ------------------------------------------------------------------------------


def _clean_mentions(t):
    return t.leads.select("ord", "seen_at", "name", *[X.clean_str(c).alias(c) for c in LEAD_TEXT])


MENTIONS = "m AS (SELECT ord, seen_at, name, " + ", ".join(f"{D.clean(c)} AS {c}" for c in LEAD_TEXT) + f", {D.norm('name')} AS nn FROM {{leads}})"
ANY = " OR ".join(f"{c} IS NOT NULL" for c in LEAD_TEXT)
COMPANIES_SQL = (
    f"WITH {MENTIONS} SELECT md5(nn) AS company_id, nn AS name_normalized, arg_min(name, ord) AS name, "
    + ", ".join(f"{D.first(c, 'ord')} AS {c}" for c in LEAD_TEXT)
    + f", arg_min(seen_at, ord) AS created_at, coalesce(arg_max(seen_at, ord) FILTER (WHERE {ANY}), arg_min(seen_at, ord)) AS updated_at FROM m WHERE nn <> '' GROUP BY nn"
)


@query("mg4_merge_companies", COMPANIES_SQL)
def _(t):
    return M.merge_companies(_clean_mentions(t), ["ord"], "seen_at")


SOCIALS_SQL = f"""WITH s AS (SELECT ord, {D.key('name')} AS company_id, 'linkedin' AS platform, {D.trim('social_linkedin')} AS url FROM {{leads}} UNION ALL SELECT ord, {D.key('name')}, 'facebook', {D.trim('social_facebook')} FROM {{leads}})
    SELECT company_id, platform, arg_max(url, ord) AS url FROM s WHERE lower(url) NOT IN ('nan', 'none', '') GROUP BY company_id, platform"""


def social_links(t):
    return t.leads.select(
        "ord", X.company_key("name").alias("company_id"),
        F.explode(F.create_map(F.lit(" LinkedIn"), "social_linkedin", F.lit("facebook"), "social_facebook")).alias("platform", "url"),
    )


@query("mg5_upsert_socials", SOCIALS_SQL)
def _(t):
    return M.upsert_socials(social_links(t), ["ord"])


EVENTS_SQL = f"""WITH m AS (SELECT *, {D.norm('name')} AS nn FROM {{event_mentions}}), f AS (SELECT nn, year, min(ord) AS o, arg_min(name, ord) AS name, {D.head('city', 'ord')} AS city, {D.head('country', 'ord')} AS country, {D.head('website', 'ord')} AS website FROM m GROUP BY nn, year),
  n AS (SELECT nn, o AS null_first FROM f WHERE year IS NULL) SELECT md5(f.nn || '|' || coalesce(CAST(year AS VARCHAR), '')) AS event_id, name, f.nn AS name_normalized, year, city, country, website FROM f LEFT JOIN n ON f.nn = n.nn WHERE year IS NULL OR null_first IS NULL OR o < null_first"""


EVENT_ROWS_SQL = EVENTS_SQL.replace("year, city", "CAST(year AS INTEGER) AS year, city").replace("WHERE CAST(year AS INTEGER) AS year", "WHERE year")


@query("mg6_merge_events", EVENT_ROWS_SQL)
def _(t):
    return M.merge_events(t.event_mentions, ["ord"])


def _facts(t):
    return t.facts.select(
        "*", X.company_key("company").alias("company_id"), M.event_key(F.col("event"), F.col("year")).alias("event_id"),
        M.marketplace_key(F.col("marketplace")).alias("marketplace_id"),
    )


FACT_KEYS = f"f AS (SELECT *, {D.key('company')} AS company_id, md5({D.norm('event')} || '|' || CAST(year AS VARCHAR)) AS event_id, md5(marketplace) AS marketplace_id FROM {{facts}})"
EXHIBITOR_COLS = ["hall", "stand", "product_categories", "brands", "detail_url"]


EXHIBITORS_SQL = f"WITH {FACT_KEYS} SELECT company_id, event_id, " + ", ".join(f"{D.last(c, 'ord')} AS {c}" for c in EXHIBITOR_COLS) + " FROM f GROUP BY company_id, event_id"


@query("mg7_merge_exhibitors", EXHIBITORS_SQL)
def _(t):
    return M.merge_exhibitors(_facts(t).select("company_id", "event_id", "ord", *EXHIBITOR_COLS), ["ord"])


SELLER_LAST, SELLER_FIRST = ["seller_id", "rating", "review_count", "vat_number"], ["rating_out_of", "kvk_number", "shipped_from"]


SELLERS_SQL = f"WITH {FACT_KEYS} SELECT company_id, marketplace_id, " + ", ".join(f"{D.last(c, 'ord')} AS {c}" for c in SELLER_LAST) + ", " + ", ".join(f"{D.head(c, 'ord')} AS {c}" for c in SELLER_FIRST) + " FROM f GROUP BY company_id, marketplace_id"


@query("mg8_merge_sellers", SELLERS_SQL)
def _(t):
    return M.merge_sellers(_facts(t).select("company_id", "marketplace_id", "ord", *SELLER_LAST, *SELLER_FIRST), ["ord"])


FIN_LAST, FIN_FIRST = ["total_gmv_eur", "growth_yoy", "total_annual_revenue", "rank_global"], ["confidence", "buyers", "rank_filtered"]
FIN_ALL = ", ".join(FIN_LAST + FIN_FIRST)


@query(
    "mg9_merge_financials",
    f"WITH f AS (SELECT *, {D.key('company')} AS company_id FROM {{financials}}) SELECT company_id, CAST(year AS INTEGER) AS year, source, " + ", ".join(f"{D.last(c, 'ord')} AS {c}" for c in FIN_LAST) + ", "
    + ", ".join(f"{D.head(c, 'ord')} AS {c}" for c in FIN_FIRST) + f" FROM f WHERE year IS NOT NULL AND source IS NOT NULL GROUP BY company_id, year, source UNION ALL SELECT company_id, year, source, {FIN_ALL} FROM f WHERE year IS NULL OR source IS NULL",
)
def _(t):
    rows = t.financials.select("ord", X.company_key("company").alias("company_id"), "year", "source", *FIN_LAST, *FIN_FIRST)
    return M.merge_financials(rows, ["ord"])


@query(
    "mg10_merge_rankings",
    f"SELECT 'category' AS ranking_type, source AS name, CAST(year AS INTEGER) AS year, {D.last('rank_global', 'ord')} AS rank_global, {D.last('total_gmv_eur', 'ord')} AS revenue_eur, {D.head('rank_filtered', 'ord')} AS rank_filtered, {D.head('growth_yoy', 'ord')} AS growth_yoy "
    "FROM {financials} WHERE year IS NOT NULL GROUP BY source, year UNION ALL SELECT 'category', source, year, rank_global, total_gmv_eur, rank_filtered, growth_yoy FROM {financials} WHERE year IS NULL",
)
def _(t):
    rows = t.financials.select(
        "ord", F.lit("category").alias("ranking_type"), F.col("source").alias("name"), "year", "rank_global",
        F.col("total_gmv_eur").alias("revenue_eur"), "rank_filtered", "growth_yoy",
    )
    return M.merge_rankings(rows, ["ord"])


@query(
    "mg11_append_contacts",
    f"SELECT CASE WHEN {D.clean('businessName')} IS NOT NULL THEN {D.key(D.clean('businessName'))} END AS company_id, {D.clean('sellerId')} AS first_name, {D.clean('zipCode')} AS last_name, {D.clean('address')} AS job_title FROM {{seller_sheet}} WHERE {D.clean('sellerId')} IS NOT NULL OR {D.clean('zipCode')} IS NOT NULL",
)
def _(t):
    rows = t.seller_sheet.select(
        F.col("businessName").alias("company_name"), F.col("sellerId").alias("first_name"), F.col("zipCode").alias("last_name"), F.col("address").alias("job_title")
    )
    return M.append_contacts(rows).select("company_id", "first_name", "last_name", "job_title")


@query(
    "mg11_append_store_metrics",
    f"SELECT CASE WHEN {D.clean('businessName')} IS NOT NULL THEN {D.key(D.clean('businessName'))} END AS company_id, {D.clean('registeredAddress')} AS store_name, {D.number('rating')} AS total_gmv_eur, {D.integer('reviewCount')} AS rank_global FROM {{seller_sheet}}",
)
def _(t):
    rows = t.seller_sheet.select(
        F.col("businessName").alias("company_name"), F.col("registeredAddress").alias("store_name"), F.col("rating").alias("total_gmv_eur"), F.col("reviewCount").alias("rank_global")
    )
    return M.append_store_metrics(rows).select("company_id", "store_name", "total_gmv_eur", "rank_global")


@query("mg12_merge_marketplaces", f"SELECT md5(event) AS marketplace_id, event AS name, {D.head('detail_url', 'ord')} AS website FROM {{facts}} GROUP BY event")
def _(t):
    return M.merge_marketplaces(t.facts.select("ord", F.col("event").alias("name"), F.col("detail_url").alias("website")), ["ord"])


@query(
    "mg13_route_leads",
    f"""WITH l AS (SELECT *, CASE WHEN ord % 4 = 0 THEN 'Fair ' || job END AS ev FROM {{leads}})
    SELECT ord, {D.key('name')} AS company_id, CASE WHEN ev IS NOT NULL THEN 'exhibitor' WHEN marketplace_name IS NOT NULL THEN 'seller' ELSE 'company' END AS route,
      CASE WHEN ev IS NOT NULL THEN md5({D.norm('ev')} || '|2026') END AS event_id, CASE WHEN ev IS NULL THEN md5(marketplace_name) END AS marketplace_id, CASE WHEN ev IS NOT NULL THEN booth END AS stand,
      CASE WHEN ev IS NOT NULL THEN source_url WHEN marketplace_name IS NOT NULL THEN coalesce(nullif(store_url, ''), source_url) END AS target_url FROM l""",
)
def _(t):
    event = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("Fair "), "job"))
    routed = M.route_leads(t.leads, event, F.lit(2026))
    return routed.select("ord", "company_id", "route", "event_id", "marketplace_id", "stand", "target_url")


@query(
    "mg14_import_event",
    f"""WITH l AS (SELECT ord, {D.key(D.clean('name'))} AS company_id, {D.clean('booth')} AS booth, {D.clean('hall')} AS hall, {D.clean('cats_text')} AS cats, {D.clean('extra_status')} AS st FROM {{leads}})
    SELECT company_id, md5('expo|2026') AS event_id, {D.last('hall', 'ord')} AS hall, {D.last('booth', 'ord')} AS stand, arg_max(CASE WHEN cats IS NULL THEN NULL ELSE '["' || replace(cats, ' ; ', '","') || '"]' END, ord) FILTER (WHERE cats IS NOT NULL) AS product_categories,
      arg_max('{{"status":"' || st || '"}}', ord) FILTER (WHERE st IS NOT NULL) AS extra_data FROM l GROUP BY company_id""",
)
def _(t):
    sheet = t.leads.select(
        "ord", "name", "country", "city", "website", "email", F.col("booth").alias("stand"), "hall", F.col("cats_text").alias("product_categories"),
        "social_linkedin", "extra_status", F.lit(None).cast("string").alias("fax"),
    )
    parts = M.import_event(sheet, "Expo", 2026, ["ord"], hall_col="hall")
    return M.merge_exhibitors(parts["exhibitors"], ["ord"]).select("company_id", "event_id", "hall", "stand", "product_categories", "extra_data")


@query(
    "mg15_import_marketplace",
    f"""WITH s AS (SELECT *, {D.clean('businessName')} AS nm FROM {{seller_sheet}} WHERE NOT regexp_matches(businessName, '(?i)not found|error|unknown')), r AS (SELECT ord, {D.key('nm')} AS company_id, {D.clean('sellerId')} AS seller_id, {D.number('rating')} AS rating, {D.integer('reviewCount')} AS review_count,
      {D.clean('vatNumber')} AS vat_number FROM s WHERE length(nm) >= 2) SELECT company_id, md5('Shop') AS marketplace_id, """ + ", ".join(f"{D.last(c, 'ord')} AS {c}" for c in SELLER_LAST) + " FROM r GROUP BY company_id",
)
def _(t):
    parts = M.import_marketplace(t.seller_sheet, "Shop", ["ord"])
    return M.merge_sellers(parts["sellers"], ["ord"]).select("company_id", "marketplace_id", *SELLER_LAST)


@query(
    "mg16_import_metrics",
    f"""WITH s AS (SELECT *, {D.clean('businessName')} AS nm FROM {{seller_sheet}}), r AS (SELECT ord, {D.key('nm')} AS company_id, {D.number("coalesce(nullif(half_half, ''), reviewCount)")} AS total_gmv_eur, {D.integer('rating')} AS rank_global,
      CASE WHEN {D.clean('address')} IS NOT NULL OR {D.clean('zipCode')} IS NOT NULL THEN '{{' || concat_ws(',', CASE WHEN {D.clean('address')} IS NOT NULL THEN '"address":"' || address || '"' END, CASE WHEN {D.clean('zipCode')} IS NOT NULL THEN '"zipCode":"' || zipCode || '"' END) || '}}' END AS extra_data
      FROM s WHERE nm IS NOT NULL) SELECT company_id, 2025 AS year, 'ranking' AS source, {D.last('total_gmv_eur', 'ord')} AS total_gmv_eur, {D.last('rank_global', 'ord')} AS rank_global, {D.head('extra_data', 'ord')} AS extra_data FROM r GROUP BY company_id""",
)
def _(t):
    mapping = {"total_gmv_eur": ["half_half", "reviewCount"], "rank_global": ["rating"], "country": []}
    parts = M.import_metrics(t.seller_sheet, "ranking", 2025, ["ord"], mapping, ["address", "zipCode"], "businessName")
    return M.merge_financials(parts["financials"], ["ord"]).select("company_id", "year", "source", "total_gmv_eur", "rank_global", "extra_data")


HITS = f"""h AS (SELECT *, lower(snippet) AS low, TRY_CAST(replace(replace(regexp_extract(lower(snippet), '(\\d[\\d,\\.]*)\\s*(?:\\+\\s*)?(?:employees|staff|people|workforce)', 1), ',', ''), '.', '') AS HUGEINT) AS n FROM {{search_hits}}),
  z AS (SELECT *, CASE WHEN n >= 5000 THEN 'Enterprise' WHEN n >= 200 THEN 'Mid-Market' ELSE '' END AS sz FROM h)"""
HIT_COLS = """coalesce(arg_min(url, pos) FILTER (WHERE contains(url, 'linkedin.com/company')), '') AS linkedin_url, coalesce({pick}(snippet, pos) FILTER (WHERE {parent}), '') AS parent_group,
  coalesce({pick}(snippet, pos) FILTER (WHERE {comp}), '') AS competitor_info, coalesce(arg_min(sz, pos) FILTER (WHERE sz <> ''), '') AS org_size"""


def _hits_sql(pick: str) -> str:
    return f"WITH {HITS} SELECT company, " + HIT_COLS.format(pick=pick, parent=D.any_of("low", M.PARENT_KEYWORDS), comp=D.any_of("low", M.COMPETITOR_KEYWORDS)) + " FROM z GROUP BY company"


@query("mg17_merge_search_hits", _hits_sql("arg_min"))
def _(t):
    return M.merge_search_hits(t.search_hits, ["company"], ["pos"])


@query("mg17_merge_search_hits_last", _hits_sql("arg_max"))
def _(t):
    return M.merge_search_hits(t.search_hits, ["company"], ["pos"], keep="last")


# --- classification ----------------------------------------------------------------------

VERT = "CASE " + " ".join(f"WHEN area = '{a}' THEN '{v[0]}'" for a, v in C.SHOW_AREAS.items()) + " " + " ".join(f"WHEN {D.any_of('low', ks)} THEN '{v}'" for v, ks in C.VERTICAL_KEYWORDS.items()) + " ELSE '' END"
SUB = "CASE " + " ".join(f"WHEN area = '{a}' THEN '{v[1]}'" for a, v in C.SHOW_AREAS.items()) + " " + " ".join(f"WHEN contains(low, '{k}') THEN '{k.strip().title()}'" for ks in C.VERTICAL_KEYWORDS.values() for k in ks) + " ELSE '' END"


@query("cl1_classify_vertical", f"SELECT pos, {VERT} AS vertical, {SUB} AS sub_vertical FROM (SELECT pos, lower(snippet) AS low, CASE WHEN pos % 20 = 0 THEN 'Audio' WHEN pos % 20 = 7 THEN 'Smart Home' END AS area FROM {{search_hits}})")
def _(t):
    rows = t.search_hits.withColumn("area", F.when(F.col("pos") % 20 == 0, "Audio").when(F.col("pos") % 20 == 7, "Smart Home"))
    return C.classify_table(rows, "snippet", "area").select("pos", "vertical", "sub_vertical")


def _company_vertical(rules, area) -> str:
    cases = " ".join(f"WHEN {D.any_of('low', ks)} THEN '{v}'" for v, ks in rules.items())
    subs = " ".join(f"WHEN contains(low, '{k}') THEN '{k.strip().title()}'" for ks in rules.values() for k in ks)
    first = lambda i: " ".join(f"WHEN area = '{a}' THEN '{v[i]}'" for a, v in C.SHOW_AREAS.items()) if area else ""
    return f"""SELECT company, CASE {first(0)} {cases} ELSE '' END AS vertical, CASE {first(1)} {subs} ELSE '' END AS sub_vertical FROM (
      SELECT company, string_agg(lower(coalesce(snippet, '')), ' ' ORDER BY pos) AS low, max(CASE WHEN pos % 200 = 0 THEN 'Audio' WHEN pos % 200 = 7 THEN 'Smart Home' END) AS area FROM {{search_hits}} GROUP BY company)"""


@query("cl1_company_vertical", _company_vertical(C.VERTICAL_KEYWORDS, True))
def _(t):
    rows = t.search_hits.withColumn("area", F.when(F.col("pos") % 200 == 0, "Audio").when(F.col("pos") % 200 == 7, "Smart Home"))
    return C.company_verticals(rows, ["company"], ["pos"], "snippet", "area")


@query("cl1_fair_company_vertical", _company_vertical(C.FAIR_VERTICAL_KEYWORDS, False))
def _(t):
    return C.company_verticals(t.search_hits, ["company"], ["pos"], rules=C.FAIR_VERTICAL_KEYWORDS)


@query("cl2_keyword_hit", f"SELECT doc_id, CASE WHEN {D.any_of('lower(text)', M.COMPETITOR_KEYWORDS + ['the', ' und '])} THEN text ELSE '' END AS hit FROM documents")
def _(t):
    return t.documents.select("doc_id", M.keyword_hit(F.col("text"), M.COMPETITOR_KEYWORDS + ["the", " und "]).alias("hit"))


# --- sinks -------------------------------------------------------------------------------

FLAT = [c for c in W.CSV_COLUMNS if c not in ("product_categories", "brands")]


@query(
    "snk1_flatten_for_csv",
    "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in FLAT)
    + ", replace(cats_text, ' ; ', '; ') AS product_categories, coalesce(brands_text, '') AS brands, coalesce(social_linkedin, '') AS social_linkedin, coalesce(social_facebook, '') AS social_facebook, coalesce(extra_status, '') AS extra_status FROM {leads}",
)
def _(t):
    return W.flatten_for_csv(lead_records(t), ["linkedin", "facebook"], ["status"])


@query("snk6_log_import", f"SELECT 'marketplace' AS source_type, 'Shop' AS source_name, 'sheet.csv' AS file_path, count(*) AS row_count, count(*) FILTER (WHERE {D.clean('businessName')} IS NOT NULL) AS rows_imported, '2026-01-01' AS imported_at FROM {{seller_sheet}}")
def _(t):
    return W.import_log_row(t.seller_sheet, X.clean_str("businessName").isNotNull(), "marketplace", "Shop", "sheet.csv", F.lit("2026-01-01"))


@query("snk7_source_layout", "SELECT request_num, CASE source_type WHEN 'Marketplace' THEN 'Marketplace Scraped Data' WHEN 'Trade Fair' THEN 'Event Scraped Data' ELSE 'Other' END AS source_folder, replace(event_name, '/', '-') AS source_dir FROM {requests}")
def _(t):
    return W.source_layout(t.requests).select("request_num", "source_folder", "source_dir")


# --- master ------------------------------------------------------------------------------


def company_tables(t: Tables) -> dict:
    facts = _facts(t)
    companies = t.supplier.select(X.company_key("s_name").alias("company_id"), F.col("s_name").alias("name"))
    fin = t.facts.select(
        X.company_key("company").alias("company_id"), "year", F.col("marketplace").alias("source"), F.col("review_count").cast("double").alias("total_gmv_eur"), "ord"
    )
    return {
        "companies": companies,
        "company_socials": t.search_hits.join(t.supplier, F.col("company") == F.col("s_suppkey")).filter(F.contains("url", F.lit("linkedin.com"))).select(
            X.company_key("s_name").alias("company_id"), F.lit("linkedin").alias("platform"), "url", F.col("pos").alias("ord")
        ),
        "event_exhibitors": facts.select("company_id", "event_id", "ord", *EXHIBITOR_COLS),
        "marketplace_sellers": facts.select("company_id", "marketplace_id", "ord", *SELLER_LAST, *SELLER_FIRST),
        "company_financials": fin,
    }


def merged_tables(t: Tables) -> dict:
    raw = company_tables(t)
    return {
        "companies": raw["companies"],
        "company_socials": M.upsert_socials(raw["company_socials"], ["ord"]),
        "event_exhibitors": M.merge_exhibitors(raw["event_exhibitors"], ["ord"]),
        "marketplace_sellers": M.merge_sellers(raw["marketplace_sellers"], ["ord"]),
        "company_financials": M.merge_financials(raw["company_financials"], ["ord"]),
    }


COMPANY_360 = f"""WITH {FACT_KEYS}, ex AS (SELECT company_id, count(DISTINCT event_id) AS n FROM f GROUP BY 1), s AS (SELECT company_id, marketplace_id, {D.last('rating', 'ord')} AS rating FROM f GROUP BY 1, 2), se AS (SELECT company_id, count(*) AS n, max(rating) AS best FROM s GROUP BY 1),
      fi AS (SELECT company_id, year, marketplace, {D.last('review_count', 'ord')} AS g FROM f GROUP BY 1, 2, 3), fa AS (SELECT company_id, count(*) AS n, max(year) AS y, max(g) AS g FROM fi GROUP BY 1), so AS (SELECT company, CAST(1 AS BIGINT) AS n FROM {{search_hits}} WHERE contains(url, 'linkedin.com') GROUP BY 1)
    SELECT md5(lower(s_name)) AS company_id, s_name AS name, coalesce(so.n, 0) AS n_socials, coalesce(ex.n, 0) AS n_events, coalesce(se.n, 0) AS n_marketplaces, se.best AS best_rating, coalesce(fa.n, 0) AS n_financials, CAST(fa.y AS INTEGER) AS latest_year, CAST(fa.g AS DOUBLE) AS max_gmv_eur
    FROM supplier LEFT JOIN ex ON ex.company_id = md5(lower(s_name)) LEFT JOIN se ON se.company_id = md5(lower(s_name)) LEFT JOIN fa ON fa.company_id = md5(lower(s_name)) LEFT JOIN so ON so.company = s_suppkey"""


@query("jn15_company_360", COMPANY_360)
def _(t):
    # events, sellers and financials are three kinds of facts of the same mentions: these are read once; the names that
    # the ids are hashes of travel, which are shorter
    kinds = [
        J.FactKind("event_exhibitors", ("event_name", "year")), J.FactKind("marketplace_sellers", ("marketplace",), {"rating": "rating"}),
        J.FactKind("company_financials", ("year", "marketplace"), {"year": "year", "total_gmv_eur": "gmv"}),
    ]
    mentions = t.facts.select(
        "ord", X.normalize_name("company").alias("company_name"), X.normalize_name("event").alias("event_name"), "year", "marketplace",
        "rating", F.col("review_count").cast("double").alias("gmv"),
    )
    facts = J.facts_of_mentions(mentions, kinds, ["ord"], "company_name").withColumn("company_id", F.md5("company_id"))
    socials = M.upsert_socials(company_tables(t)["company_socials"], ["ord"])
    return J.company_360({"companies": company_tables(t)["companies"], "company_socials": socials}, facts).drop("n_contacts")


@query("jn15_company_360_tables", COMPANY_360)
def _(t):
    return J.company_360(merged_tables(t))


@query("jn15_company_facets", f"WITH {FACT_KEYS} SELECT facet, count(*) AS n FROM (SELECT DISTINCT 'event' AS facet, company_id, event_id AS k FROM f UNION ALL SELECT DISTINCT 'marketplace', company_id, marketplace_id FROM f) GROUP BY facet")
def _(t):
    tables = merged_tables(t)
    facets = J.company_facets({k: tables[k] for k in ("event_exhibitors", "marketplace_sellers")})
    return facets.groupBy("facet").agg(F.count("*").alias("n"))


@query(
    "ag10_table_stats",
    f"""WITH {FACT_KEYS} SELECT 'companies' AS "table", (SELECT count(*) FROM supplier) AS rows UNION ALL SELECT 'company_socials', (SELECT count(DISTINCT company) FROM {{search_hits}} WHERE contains(url, 'linkedin.com'))
    UNION ALL SELECT 'event_exhibitors', (SELECT count(*) FROM (SELECT DISTINCT company_id, event_id FROM f)) UNION ALL SELECT 'marketplace_sellers', (SELECT count(*) FROM (SELECT DISTINCT company_id, marketplace_id FROM f))
    UNION ALL SELECT 'company_financials', (SELECT count(*) FROM (SELECT DISTINCT company_id, year, marketplace FROM f))""",
)
def _(t):
    return Q.table_stats(merged_tables(t))


FILLED = {f: f"NOT {D.blank(f)}" for f in [*LEAD_TEXT, "name"]}


@query(
    "company_master_quality",
    f"""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job, lower({D.trim('name')}), lower({D.trim('''CASE WHEN coalesce(website, '') <> '' THEN website ELSE source_url END''')}) ORDER BY ord) AS rn FROM {{leads}}) WHERE rn = 1),
      m AS (SELECT job, {D.norm('name')} AS nn, ord, """ + ", ".join(f"{D.clean(c)} AS {c}" for c in LEAD_TEXT) + """ FROM d), c AS (SELECT job, nn AS name, """ + ", ".join(f"{D.first(c, 'ord')} AS {c}" for c in LEAD_TEXT)
    + " FROM m WHERE nn <> '' GROUP BY job, nn), w AS (SELECT job, count(*) AS total_records, " + ", ".join(f"round(count(*) FILTER (WHERE {c} IS NOT NULL) / count(*), 3) AS {c}" for c in ["name", *LEAD_TEXT])
    + """ FROM c GROUP BY job) SELECT job, total_records, website, country, email, round((name + website + country) / 3 * 0.5::DOUBLE + (city + email + phone + description) / 4 * 0.35::DOUBLE + (address + postal_code + 0 + 0 + logo_url + 0) / 6 * 0.15::DOUBLE, 6) AS overall_score FROM w""",
)
def _(t):
    unique = DD.dedup_leads(t.leads, ["ord"], ["job"])
    cleaned = unique.select("job", "ord", "seen_at", "name", *[X.clean_str(c).alias(c) for c in LEAD_TEXT])
    per_job = M.merge_companies(cleaned, ["ord"], "seen_at", scope=["job"])
    report = Q.quality_report(per_job, ["job"])
    return report.select("job", "total_records", "website", "country", "email", F.round("overall_score", 6).alias("overall_score"))
