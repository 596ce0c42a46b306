"""Rule-based classification and detail-page tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import contains_any, fixed_text

# Show areas with a known vertical and sub-vertical.
SHOW_AREAS = {
    "Home Appliances": ("Home Appliances", "General"),
    "Computing & Gaming": ("Computing & IT", "Computing & Gaming"),
    "Smart Home": ("Smart Home / IoT", "Smart Home"),
    "Communication & Connectivity": ("Telecommunications", "Communication & Connectivity"),
    "Audio": ("Consumer Electronics", "Audio"),
    "IFA Next": ("Consumer Electronics", "Innovation / Startup"),
    "Home & Entertainment": ("Consumer Electronics", "Home & Entertainment"),
    "Fitness & Digital Health": ("Health & Wellness Tech", "Fitness & Digital Health"),
    "IFA Global Markets": ("Distribution & Retail", "Global Markets"),
}

# Verticals and their keywords, in order of choice.
VERTICAL_KEYWORDS = {
    "Consumer Electronics": ["consumer electronics", "electronics manufacturer", "smartphones", "mobile", "wearables", "audio", "tv"],
    "Home Appliances": ["home appliances", "kitchen appliance", "washing machine", "refrigerator", "vacuum", "dishwasher", "cooking"],
    "Computing & IT": ["computing", "laptop", "desktop", "software", "semiconductor", "computer", "gaming", "pc "],
    "Smart Home / IoT": ["smart home", "iot", "connected home", "home automation"],
    "Telecommunications": ["telecom", "5g", "network", "connectivity", "router", "wifi"],
    "Health & Wellness Tech": ["health tech", "fitness", "medical device", "wellness"],
    "Energy & Sustainability": ["solar", "renewable", "energy", "battery", "ev charging"],
    "Accessories & Components": ["accessories", "cable", "charger", "adapter", "case"],
    "Distribution & Retail": ["distributor", "distribution", "wholesale", "retail"],
}

# Field-name and URL marks of map, cookie and metadata pages.
JUNK_PREFIXES = [
    "meta_", "og_", "canonical_", "cookie_", "portal_", "map_", "legend_", "search_", "menu_", "attribution_",
]
JUNK_KEYWORDS = ["cookie", "consent", "gdpr", "privacy", "tracking", "analytics"]
SHELL_URL_MARKERS = ["floorplan", "hallplan", "hall-map", "hall_map", "showexhibitor"]
SHELL_FIELD_MARKERS = ["hall_map", "floorplan", "map", "legend"]
SHELL_HTML_MARKERS = [
    "floorplan", "hall plan", "hall map", "legend", "svg-pan-zoom", "booth finder", "showexhibitor",
]
USEFUL_FIELD_MARKERS = [
    "name", "email", "phone", "website", "description", "address", "contact", "city", "country", "postal", "zip",
    "booth", "hall", "brand", "category", "social",
]
GENERIC_DETAIL_FIELDS = [
    "name", "country", "city", "address", "postal_code", "email", "phone", "website", "description",
    "product_categories", "brands", "logo_url", "store_url", "social_media", "industry",
]
MIN_CONTAINERS, MIN_HIT_RATIO, MIN_CONTENT = 3, 0.2, 0.3


def _pick(index: Column, values: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def keyword_rank(low: Column, rules: Mapping[str, Sequence[str]] = VERTICAL_KEYWORDS) -> Column:
    """Position of the first keyword (in rule order) contained in a lower-case text, NULL without any."""
    words = [k for ks in rules.values() for k in ks]
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(i)) for i, k in enumerate(words)])


def vertical_of(
    rank: Column, show_area: Column | None = None, rules: Mapping[str, Sequence[str]] = VERTICAL_KEYWORDS,
    areas: Mapping[str, tuple[str, str]] = SHOW_AREAS,
) -> Column:
    """struct(vertical, sub_vertical) of a keyword rank; a known show area goes first."""
    by_word = [(v, k.strip().title()) for v, ks in rules.items() for k in ks]
    area = F.lit(None).cast("string") if show_area is None else show_area
    named = lambda i: F.coalesce(*[F.when(area == a, F.lit(v[i])) for a, v in areas.items()])
    return F.struct(
        F.coalesce(named(0), _pick(rank, [w[0] for w in by_word]), F.lit("")).alias("vertical"),
        F.coalesce(named(1), _pick(rank, [w[1] for w in by_word]), F.lit("")).alias("sub_vertical"),
    )


def classify_table(df: DataFrame, text: str, show_area: str | None = None) -> DataFrame:
    """Add vertical and sub_vertical: by show area, else by the first vertical with a keyword in the text."""
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    ranked = low.withColumn("_rank", keyword_rank(F.col("_low")))
    verdict = vertical_of(F.col("_rank"), F.col(show_area) if show_area else None)
    return ranked.withColumn("_v", verdict).select(*df.columns, "_v.vertical", "_v.sub_vertical")


# Verticals of fair exhibitors and their keywords, in order.
FAIR_VERTICAL_KEYWORDS = {
    "Consumer Electronics": ["consumer electronics", "electronics manufacturer", "gadgets", "smartphones", "mobile devices", "wearables", "tv", "audio", "headphones", "speakers"],
    "Home Appliances": ["home appliances", "kitchen appliances", "washing machine", "refrigerator", "vacuum", "dishwasher", "cooking", "oven"],
    "Computing & IT": ["computing", "laptop", "desktop", "pc", "server", "software", "semiconductor", "chip", "processor", "computer"],
    "Smart Home / IoT": ["smart home", "iot", "internet of things", "connected home", "home automation", "smart device"],
    "Telecommunications": ["telecom", "5g", "network", "mobile operator", "carrier", "broadband", "fiber"],
    "Gaming & Entertainment": ["gaming", "game console", "esports", "video game", "entertainment system"],
    "Health & Wellness Tech": ["health tech", "fitness", "medical device", "wellness", "digital health", "healthtech"],
    "Energy & Sustainability": ["solar", "renewable", "energy storage", "battery", "sustainability", "green tech", "ev charging"],
    "Automotive Tech": ["automotive", "connected car", "ev", "electric vehicle", "autonomous driving"],
    "Retail / E-commerce": ["retail", "e-commerce", "marketplace", "online shopping"],
    "Media & Content": ["media", "streaming", "content", "broadcast", "publishing"],
}


def company_verticals(
    results: DataFrame, keys: Sequence[str], order_by: Sequence[str], text: str = "snippet", show_area: str | None = None,
    rules: Mapping[str, Sequence[str]] = VERTICAL_KEYWORDS,
) -> DataFrame:
    """(keys, vertical, sub_vertical) per company, over all its search results read as one text.

    The results' texts stand in order with a space between, so a keyword may reach over the ends of as many
    results as it has words. A result is looked at with those behind it, and a company's first keyword (in
    rule order) is the smallest rank of its results: nothing is collected per company.
    """
    reach = max(len(k.split(" ")) for words in rules.values() for k in words)
    w = Window.partitionBy(*keys).orderBy(*order_by)
    own = F.coalesce(F.col(text), F.lit(""))
    joined = F.lower(F.concat_ws(" ", own, *[F.lead(own, i).over(w) for i in range(1, reach)]))
    ranked = results.withColumn("_low", joined).withColumn("_rank", keyword_rank(F.col("_low"), rules))
    areas = [F.max(show_area).alias("_area")] if show_area else []
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_rank"), *areas)
    verdict = vertical_of(F.col("_rank"), F.col("_area") if show_area else None, rules)
    return best.withColumn("_v", verdict).select(*keys, "_v.vertical", "_v.sub_vertical")


def _starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(c, F.lit(p))
    return hit


def is_junk_field(name: Column) -> Column:
    low = F.lower(name)
    return _starts_with_any(low, JUNK_PREFIXES) | contains_any(low, JUNK_KEYWORDS)


def drop_junk_fields(fields: Column) -> Column:
    """Field map without junk-named fields."""
    return F.map_filter(fields, lambda k, v: ~is_junk_field(k))


def detail_fields_or_generic(fields: Column) -> Column:
    """Planned detail fields, or the generic list when none is useful or most are junk."""
    generic = F.array(*[F.lit(x) for x in GENERIC_DETAIL_FIELDS])
    junk = F.size(F.filter(fields, is_junk_field))
    return F.when(
        (F.coalesce(F.size(fields), F.lit(0)) > 0) & (junk < F.size(fields)) & (junk * 2 <= F.size(fields)), fields
    ).otherwise(generic)


def is_shell_detail(url: Column, html: Column, fields: Column) -> Column:
    """True for map or floor-plan pages: no useful planned field, and junk fields or shell marks."""
    names = F.transform(F.coalesce(fields, F.array().cast("array<string>")), F.lower)
    junk = F.size(F.filter(names, lambda n: _starts_with_any(n, JUNK_PREFIXES)))
    useful = F.size(F.filter(names, lambda n: ~_starts_with_any(n, JUNK_PREFIXES) & contains_any(n, USEFUL_FIELD_MARKERS)))
    n = F.size(names)
    mostly_junk = (n > 0) & (junk >= F.greatest(F.lit(1), F.floor(n / 2)))
    low = F.lower(html)
    marks = sum([F.contains(low, F.lit(m)).cast("int") for m in SHELL_HTML_MARKERS], F.lit(0))
    shell_html = (marks >= 2) & ~F.contains(low, F.lit("mailto:")) & ~F.contains(low, F.lit("tel:"))
    shell_url = contains_any(F.lower(url), SHELL_URL_MARKERS)
    return (useful == 0) & (mostly_junk | shell_url | shell_html)


def is_shell_link(field: Column, link: Column) -> Column:
    return contains_any(F.lower(F.coalesce(field, F.lit(""))), SHELL_FIELD_MARKERS) | contains_any(
        F.lower(link), SHELL_URL_MARKERS
    )


def selector_verdict(
    n_fields: Column, field_checks: Column, container_count: Column, hit_ratio: Column, content_score: Column
) -> Column:
    """Reject reason of a selector plan, NULL when it is accepted."""
    return (
        F.when((n_fields > 0) & (field_checks == 0), F.lit("all field selectors are empty"))
        .when(container_count < MIN_CONTAINERS, F.concat(F.lit("container selector matched only "), container_count.cast("string")))
        .when((hit_ratio < MIN_HIT_RATIO) & (field_checks > 0), F.concat(F.lit("low hit ratio "), fixed_text(hit_ratio, 3)))
        .when((n_fields > 0) & (content_score < MIN_CONTENT), F.concat(F.lit("content test failed "), fixed_text(content_score, 2)))
    )
