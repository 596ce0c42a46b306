"""Company master: mentions in arrival order -> one row per business key.

Each table has its own rule (first value, first non-null, last non-null); all columns of
a table are folded in one aggregation with map-side partial results, so hot companies
do not concentrate rows in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.nested import extract_prefixed, select_nonempty
from leadloom.functions.text import (
    clean_float, clean_int, clean_str, company_key, contains_any, normalize_name, org_size, split_list, to_json_text,
    trim_ws,
)
from leadloom.operators.filters import PLACEHOLDER_RE, drop_sparse_columns
from leadloom.operators.ordered import (
    first_non_null, first_value_by, last_non_null, last_value_by, order_key,
)
from leadloom.schemas import COMPANY_ATTRIBUTES, TABLES

# Columns by merge rule.
EXHIBITOR_LAST = [
    "hall", "stand", "booth", "product_categories", "brands", "detail_url", "source_url", "extra_data",
]
SELLER_LAST = ["seller_id", "rating", "review_count", "vat_number", "source_url"]
SELLER_FIRST = ["rating_out_of", "kvk_number", "shipped_from", "extra_data"]
FINANCIAL_LAST = ["total_gmv_eur", "growth_yoy", "total_annual_revenue", "rank_global"]
FINANCIAL_FIRST = [
    "net_sales_1p_eur", "gmv_3p_eur", "ecom_revenue", "revenue_source", "confidence", "buyers", "orders_total",
    "aov_eur", "conversion_rate", "rank_filtered", "main_country", "main_category", "extra_data",
]
RANKING_LAST = ["rank_global", "revenue_eur"]
RANKING_FIRST = ["rank_filtered", "growth_yoy", "extra_data"]
STAND_CANDIDATES = ["booth_or_stand", "stand", "booth", "extra_stand", "extra_stand_number"]
PARENT_KEYWORDS = [
    "subsidiary of", "part of", "owned by", "a division of", "acquired by", "belongs to", "parent company",
]
COMPETITOR_KEYWORDS = ["competitor", "competes with", "rival", "alternative to", "vs ", "compared to"]


def event_key(name: Column, year: Column) -> Column:
    return F.md5(F.concat_ws("|", normalize_name(name), F.coalesce(year.cast("string"), F.lit(""))))


def marketplace_key(name: Column) -> Column:
    return F.md5(name)


# --- merges ------------------------------------------------------------------------------


def merge_companies(
    mentions: DataFrame, order_by: Sequence[str], seen_at: str, attributes: Sequence[str] = COMPANY_ATTRIBUTES,
    scope: Sequence[str] = (),
) -> DataFrame:
    """One company per normalised name (within `scope`): first spelling, first non-null value per attribute."""
    order = order_key(order_by)
    present = [a for a in attributes if a in mentions.columns]
    any_value = F.lit(False)
    for a in present:
        any_value = any_value | F.col(a).isNotNull()
    named = mentions.withColumn("name_normalized", normalize_name("name")).filter(F.col("name_normalized") != "")
    merged = named.groupBy(*scope, "name_normalized").agg(
        first_value_by(F.col("name"), order).alias("name"),
        *[first_non_null(a, order) for a in present],
        first_value_by(F.col(seen_at), order).alias("created_at"),
        last_value_by(F.col(seen_at), order, any_value).alias("updated_at"),
    )
    return merged.withColumn("updated_at", F.coalesce("updated_at", "created_at")).withColumn(
        "company_id", F.md5("name_normalized")
    )


def upsert_socials(links: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Latest usable link per company and network."""
    usable = links.select(
        "company_id", F.lower(trim_ws("platform")).alias("platform"), trim_ws("url").alias("url"), *order_by
    ).filter(~F.lower("url").isin("nan", "none", ""))
    return usable.groupBy("company_id", "platform").agg(last_value_by(F.col("url"), order_key(order_by)).alias("url"))


def merge_events(mentions: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Event per (name, year); from the first mention without a year on, that row serves all years."""
    order = order_key(order_by)
    first = mentions.withColumn("name_normalized", normalize_name("name")).groupBy("name_normalized", "year").agg(
        F.min(order).alias("_first"),
        *[first_value_by(F.col(c), order).alias(c) for c in ("name", "city", "country", "website")],
    )
    return absorb_yearless(first)


def absorb_yearless(first: DataFrame) -> DataFrame:
    """Events from the first mention (its order in `_first`) of every name and year."""
    # one row per name and year is left, so the window groups are short
    w = Window.partitionBy("name_normalized")
    absorbed_from = F.min(F.when(F.col("year").isNull(), F.col("_first"))).over(w)
    kept = first.withColumn("_null_first", absorbed_from).filter(
        F.col("year").isNull() | F.col("_null_first").isNull() | (F.col("_first") < F.col("_null_first"))
    )
    return kept.withColumn("event_id", event_key(F.col("name"), F.col("year"))).select(*TABLES["events"])


def merge_exhibitors(rows: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Last non-null value per column for each company and event."""
    order = order_key(order_by)
    cols = [c for c in EXHIBITOR_LAST if c in rows.columns]
    return rows.groupBy("company_id", "event_id").agg(*[last_non_null(c, order) for c in cols])


def _mixed(rows: DataFrame, keys: Sequence[str], last: Sequence[str], first: Sequence[str], order: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        *[last_non_null(c, order) for c in last if c in rows.columns],
        *[first_value_by(F.col(c), order).alias(c) for c in first if c in rows.columns],
    )


def merge_sellers(rows: DataFrame, order_by: Sequence[str]) -> DataFrame:
    return _mixed(rows, ["company_id", "marketplace_id"], SELLER_LAST, SELLER_FIRST, order_key(order_by))


def merge_financials(rows: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Per company, year and source; rows without year or source never meet and stay as they are."""
    keys = ["company_id", "year", "source"]
    keyless = F.col("year").isNull() | F.col("source").isNull()
    merged = _mixed(rows.filter(~keyless), keys, FINANCIAL_LAST, FINANCIAL_FIRST, order_key(order_by))
    return merged.unionByName(rows.filter(keyless).select(*merged.columns))


def merge_rankings(rows: DataFrame, order_by: Sequence[str]) -> DataFrame:
    keys = ["ranking_type", "name", "year"]
    merged = _mixed(rows.filter(F.col("year").isNotNull()), keys, RANKING_LAST, RANKING_FIRST, order_key(order_by))
    return merged.unionByName(rows.filter(F.col("year").isNull()).select(*merged.columns))


def merge_marketplaces(mentions: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Marketplace per exact name with the website of the first mention."""
    order = order_key(order_by)
    return mentions.groupBy("name").agg(first_value_by(F.col("website"), order).alias("website")).withColumn(
        "marketplace_id", marketplace_key(F.col("name"))
    )


def _typed(df: DataFrame, text: Sequence[str] = (), floats: Sequence[str] = (), ints: Sequence[str] = ()) -> list[Column]:
    have = set(df.columns)
    pick = lambda fn, names, t: [
        (fn(c) if c in have else F.lit(None).cast(t)).alias(c) for c in names
    ]
    return [*pick(clean_str, text, "string"), *pick(clean_float, floats, "double"), *pick(clean_int, ints, "bigint")]


def append_contacts(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Contacts with a first or last name, linked to their company where one is named."""
    company = clean_str(
        F.coalesce(F.nullif(F.col("company_name"), F.lit("")), F.col("store_name"))
        if "store_name" in rows.columns else F.col("company_name")
    )
    named = rows.filter(clean_str("first_name").isNotNull() | clean_str("last_name").isNotNull())
    out = named.select(
        F.when(company.isNotNull(), company_key(company)).alias("company_id"), *_typed(rows, TABLES["contacts"][1:])
    )
    return out if existing is None else existing.unionByName(out)


def append_store_metrics(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Store rows, typed, linked to their company where one is named."""
    company = clean_str("company_name")
    out = rows.filter(clean_str("store_name").isNotNull()).select(
        F.when(company.isNotNull(), company_key(company)).alias("company_id"),
        *_typed(
            rows,
            ["store_name", "slug", "main_country", "main_category", "extra_data"],
            ["total_gmv_eur", "net_sales_1p", "gmv_3p", "growth_yoy"],
            ["year", "rank_global", "rank_filtered"],
        ),
    )
    return out if existing is None else existing.unionByName(out)


# --- routing and importers ---------------------------------------------------------------


def route_leads(leads: DataFrame, event: Column | None = None, year: Column | None = None,
                marketplace: Column | None = None) -> DataFrame:
    """Add `route` and target keys: exhibitor when an event is given, else seller, else company only."""
    none = F.lit(None).cast("string")
    event = none if event is None else clean_str(event)
    year = F.lit(None).cast("int") if year is None else year
    own = clean_str("marketplace_name") if "marketplace_name" in leads.columns else none
    marketplace = own if marketplace is None else F.coalesce(clean_str(marketplace), own)
    store = F.nullif(F.col("store_url"), F.lit("")) if "store_url" in leads.columns else none
    has_event = event.isNotNull()
    has_market = ~has_event & marketplace.isNotNull()
    named = leads.filter(clean_str("name").isNotNull())
    booth = clean_str("booth") if "booth" in leads.columns else none
    return named.withColumns({
        "company_id": company_key(clean_str("name")),
        "route": F.when(has_event, "exhibitor").when(has_market, "seller").otherwise("company"),
        "event_id": F.when(has_event, event_key(event, year)),
        "marketplace_id": F.when(has_market, marketplace_key(marketplace)),
        "stand": F.when(has_event, booth),
        "target_url": F.when(has_event, clean_str("source_url")).when(
            has_market, clean_str(F.coalesce(store, F.col("source_url")))
        ),
    })


def row_map(df: DataFrame, columns: Sequence[str]) -> Column:
    """String columns of a row as one map."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("string") for c in columns]))


def import_event(
    df: DataFrame, event: str, year: int | None, order_by: Sequence[str], name_col: str = "name",
    hall_col: str | None = None, stand_col: str | None = None, drop_threshold: float = 0.95,
) -> dict[str, DataFrame]:
    """Exhibitor file -> mentions for companies, socials, events and exhibitors."""
    strings = [c for c in df.columns if c not in order_by]
    kept = drop_sparse_columns(df, drop_threshold)
    have = kept.columns
    if name_col not in have:
        kept, have = df.filter(F.lit(False)), df.columns
    rows = kept.filter(clean_str(name_col).isNotNull()).withColumn("company_id", company_key(clean_str(name_col)))
    text = lambda c: clean_str(c) if c in have else F.lit(None).cast("string")
    stands = [text(c) for c in dict.fromkeys([stand_col, *STAND_CANDIDATES]) if c in have]
    cells = row_map(rows, [c for c in strings if c in have])
    as_list = lambda c: F.when(text(c).isNotNull(), F.to_json(split_list(c))) if c in have else text(c)
    extras = extract_prefixed(cells, "extra_")
    fields = ["description", "country", "city", "address", "postal_code", "website", "email", "phone", "fax", "logo_url"]
    companies = rows.select(clean_str(name_col).alias("name"), *[text(f).alias(f) for f in fields], *order_by)
    socials = rows.select(
        "company_id", F.explode(extract_prefixed(cells, "social_")).alias("platform", "url"), *order_by
    )
    year_col = F.lit(year).cast("int")
    exhibitors = rows.select(
        "company_id",
        event_key(F.lit(event), year_col).alias("event_id"),
        (text(hall_col) if hall_col else F.lit(None).cast("string")).alias("hall"),
        (F.coalesce(*stands) if stands else F.lit(None).cast("string")).alias("stand"),
        as_list("product_categories").alias("product_categories"),
        as_list("brands").alias("brands"),
        F.coalesce(text("detail_url"), text("source_url")).alias("detail_url"),
        text("source_url").alias("source_url"),
        F.when(F.cardinality(extras) > 0, F.to_json(extras)).alias("extra_data"),
        *order_by,
    )
    return {"companies": companies, "socials": socials, "exhibitors": exhibitors}


def import_marketplace(
    df: DataFrame, marketplace: str, order_by: Sequence[str], name_col: str = "businessName",
    drop_threshold: float = 0.95,
) -> dict[str, DataFrame]:
    """Seller file -> mentions for companies and sellers."""
    kept = drop_sparse_columns(df, drop_threshold)
    have = kept.columns
    if name_col not in have:
        kept, have = df.filter(F.lit(False)), df.columns
    text = lambda c: clean_str(c) if c in have else F.lit(None).cast("string")
    name = clean_str(name_col)
    rows = kept.filter(~F.rlike(F.col(name_col), F.lit(PLACEHOLDER_RE)) & (F.length(name) >= 2))
    companies = rows.select(
        name.alias("name"),
        text("email").alias("email"),
        text("phone").alias("phone"),
        F.coalesce(text("address"), text("registeredAddress")).alias("address"),
        text("zipCode").alias("postal_code"),
        text("city").alias("city"),
        *order_by,
    )
    sellers = rows.select(
        company_key(name).alias("company_id"),
        marketplace_key(F.lit(marketplace)).alias("marketplace_id"),
        text("sellerId").alias("seller_id"),
        clean_float(text("rating")).alias("rating"),
        clean_float(text("ratingOutOf")).alias("rating_out_of"),
        clean_int(text("reviewCount")).alias("review_count"),
        text("vatNumber").alias("vat_number"),
        text("kvkNumber").alias("kvk_number"),
        text("shippedFrom").alias("shipped_from"),
        text("sourceUrl").alias("source_url"),
        *order_by,
    )
    return {"companies": companies, "sellers": sellers}


def import_metrics(
    df: DataFrame, source: str, year: int, order_by: Sequence[str], mapping: Mapping[str, Sequence[str]],
    extra_keys: Sequence[str] = (), name_col: str = "name",
) -> dict[str, DataFrame]:
    """Ranking or profile file -> company and financial mentions.

    `mapping` names the source columns per target column; the first filled one counts.
    """
    have = set(df.columns)
    strings = [c for c in df.columns if c not in order_by]

    def pick(target: str) -> Column:
        names = [c for c in mapping.get(target, [target]) if c in have]
        filled = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in names]
        return F.coalesce(*filled) if filled else F.lit(None).cast("string")

    named = df.filter(clean_str(name_col).isNotNull())
    company_fields = ["slug", "company_type", "country"]
    companies = named.select(
        clean_str(name_col).alias("name"), *[clean_str(pick(f)).alias(f) for f in company_fields], *order_by
    )
    ints = {"buyers", "orders_total", "rank_global", "rank_filtered"}
    text = {"revenue_source", "confidence", "main_country", "main_category"}
    numbers = [c for c in FINANCIAL_LAST + FINANCIAL_FIRST if c != "extra_data"]
    typed = [
        (clean_str(pick(c)) if c in text else clean_int(pick(c)) if c in ints else clean_float(pick(c))).alias(c)
        for c in numbers
    ]
    extra = to_json_text(select_nonempty(row_map(named, strings), extra_keys), complex_type=True) if extra_keys \
        else F.lit(None).cast("string")
    financials = named.select(
        company_key(clean_str(name_col)).alias("company_id"),
        F.lit(year).alias("year"),
        F.lit(source).alias("source"),
        *typed,
        extra.alias("extra_data"),
        *order_by,
    )
    return {"companies": companies, "financials": financials}


def merge_search_hits(
    results: DataFrame, keys: Sequence[str], order_by: Sequence[str], keep: str = "first",
    parent_words: Sequence[str] = PARENT_KEYWORDS, competitor_words: Sequence[str] = COMPETITOR_KEYWORDS,
    parent_chars: int | None = None, competitor_chars: int | None = None,
) -> DataFrame:
    """Search results per company -> LinkedIn page, parent, competitor and size facts.

    `keep` chooses the first or the last result with a parent or competitor keyword; its text is kept whole,
    or its first `parent_chars` or `competitor_chars` characters.
    """
    order = order_key(order_by)
    text = F.lower(F.coalesce(F.col("snippet"), F.lit("")))
    pick = first_value_by if keep == "first" else last_value_by
    size = org_size("snippet")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return results.groupBy(*keys).agg(
        blank(first_value_by(F.col("url"), order, F.contains(F.col("url"), F.lit("linkedin.com/company")))).alias("linkedin_url"),
        blank(pick(_head(F.col("snippet"), parent_chars), order, contains_any(text, parent_words))).alias("parent_group"),
        blank(pick(_head(F.col("snippet"), competitor_chars), order, contains_any(text, competitor_words))).alias("competitor_info"),
        blank(first_value_by(size, order, size != "")).alias("org_size"),
    )


def _head(c: Column, chars: int | None) -> Column:
    return c if chars is None else F.left(c, F.lit(chars))


def keyword_hit(c: Column, words: Sequence[str], max_len: int | None = None) -> Column:
    """A text that contains one of the words, or its first `max_len` characters, else ''."""
    return F.when(contains_any(F.lower(c), words), _head(c, max_len)).otherwise(F.lit(""))
