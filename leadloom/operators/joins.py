"""Enrichment joins. Joins are equi joins on the business key: the engine picks broadcast or
sort-merge from sizes and splits skewed partitions at run time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.nested import compact_api, distinct_join
from leadloom.functions.text import _c, age_hours, collapse_ws, drop_social_website, normalize_name, trim_ws
from leadloom.functions.urls import domain_key, url_key
from leadloom.operators.ordered import first_value_by, last_non_null, order_key
from leadloom.session import cut_lineage


def attach_detail_page(items: DataFrame, details: DataFrame, link: str = "detail_link") -> DataFrame:
    """Text of the linked detail page; items without a match keep NULL."""
    d = details.select(F.col("url").alias("_url"), F.col("text").alias("detail_page_data"))
    return items.join(d, F.col(link) == F.col("_url"), "left").drop("_url")


def attach_detail_api(items: DataFrame, api: DataFrame, item_id: str = "detail_api_id") -> DataFrame:
    """Compacted detail response (map column `body`) by id, as JSON text."""
    a = api.select(F.col("id").alias("_id"), F.to_json(compact_api("body")).alias("detail_api_data"))
    return items.join(a, F.col(item_id) == F.col("_id"), "left").drop("_id")


def attach_structured(items: DataFrame, structured: DataFrame, job: str, max_chars: int | None = None) -> DataFrame:
    """Structured data of the job; with `max_chars` only where its JSON text is shorter."""
    short = structured if max_chars is None else structured.filter(F.length("structured_json") < max_chars)
    s = short.select(
        F.col(job).alias("_job"), F.col("structured_json").alias("structured_data")
    )
    return items.join(s, F.col(job) == F.col("_job"), "left").drop("_job")


def merge_listing_detail(listing: DataFrame, detail: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Detail values fill only empty listing fields."""
    d = detail.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_d_{f}") for f in fields])
    joined = listing.join(d, F.col(key) == F.col("_key"), "left")
    filled = {
        f: F.coalesce(
            F.nullif(F.col(f), F.lit("")) if f in listing.columns else F.lit(None),
            F.nullif(F.col(f"_d_{f}"), F.lit("")),
            F.col(f) if f in listing.columns else F.lit(None),
        )
        for f in fields
    }
    return joined.withColumns(filled).drop("_key", *[f"_d_{f}" for f in fields])


def listing_detail_flatten(listing: DataFrame, detail: DataFrame, key: str, columns: Mapping[str, Column]) -> DataFrame:
    """Detail rows flattened by `columns`; the country comes from the listing."""
    place = listing.select(F.col(key).alias("_key"), F.coalesce(F.col("country_iso"), F.lit("")).alias("_country_iso"))
    flat = detail.select(F.col(key), *[c.alias(n) for n, c in columns.items()])
    return flat.join(place, F.col(key) == F.col("_key")).withColumn("country_iso", F.col("_country_iso")).drop(
        "_key", "_country_iso"
    )


def three_way_export(
    listing: DataFrame, detail: DataFrame, enrichment: DataFrame, key: str, organiser_id: str,
    social_domains: Sequence[str],
) -> DataFrame:
    """Listing + detail + enrichment per slug; missing pages (404) drop out.

    Place lists (show_areas, halls, stands) come from the detail, else from the listing, each
    value once; contact and event lists are joined as they are. Columns that no input has are
    left out.
    """

    d = detail.select(F.col(key).alias("_dk"), *[F.col(c).alias(f"_d_{c}") for c in detail.columns if c != key])
    e = enrichment.select(F.col(key).alias("_ek"), *[F.col(c).alias(f"_e_{c}") for c in enrichment.columns if c != key])
    joined = listing.join(d, F.col(key) == F.col("_dk"), "left").join(e, F.col(key) == F.col("_ek"), "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = F.coalesce(F.nullif(F.col("_d_linkedin"), F.lit("")), F.col("_e_linkedin_url"), F.lit(""))
    linkedin = F.when((own != "") & ~F.contains(own, F.lit(organiser_id)), own).otherwise(text("_e_linkedin_url"))
    alive = joined.filter(text("_d_error") != "404")
    have = set(joined.columns)
    lists = []
    for c in ("show_areas", "halls", "stands"):
        sources = [F.col(x) for x in (f"_d_{c}", c) if x in have]
        if sources:
            lists.append(F.coalesce(distinct_join(F.coalesce(*sources)), F.lit("")).alias(c))
    for c, sep in (("emails", "; "), ("phones", "; "), ("events", " | ")):
        if f"_d_{c}" in have:
            lists.append(F.coalesce(F.array_join(f"_d_{c}", sep), F.lit("")).alias(c))
    texts = [text(f"_d_{c}").alias(c) for c in ("instagram", "youtube", "facebook", "twitter", "logo_url") if f"_d_{c}" in have]
    texts += [text("detail_url").alias("detail_url")] if "detail_url" in have else []
    return alive.select(
        F.col(key),
        F.coalesce(F.nullif(F.col("_d_name"), F.lit("")), F.col("name"), F.lit("")).alias("company_name"),
        F.coalesce(F.nullif(F.col("_d_country"), F.lit("")), F.col("country"), F.lit("")).alias("country"),
        drop_social_website(text("_d_website"), social_domains).alias("website"),
        linkedin.alias("linkedin"),
        text("_d_description").alias("description"),
        *[text(f"_e_{c}").alias(c) for c in ("parent_group", "vertical", "sub_vertical", "org_size", "competitor_info") if f"_e_{c}" in have],
        *lists, *texts,
    )


def left_enrich(
    df: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str], loose: bool = False,
    defaults: Mapping[str, str] | None = None,
) -> DataFrame:
    """Lookup columns by key; absent rows get '' or the given default. `loose` ignores case and outer space."""
    norm = (lambda c: F.upper(trim_ws(c))) if loose else _c
    right = lookup.select(norm(key).alias("_key"), *[F.col(c).alias(f"_l_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = df.join(right, norm(key) == F.col("_key"), "left")
    filled = {
        c: F.when(F.col("_hit"), F.coalesce(F.col(f"_l_{c}"), F.lit(""))).otherwise(F.lit((defaults or {}).get(c, "")))
        for c in columns
    }
    return joined.withColumns(filled).drop("_key", "_hit", *[f"_l_{c}" for c in columns])


def first_rule(text: Column, rules: Sequence[tuple[str, str]], regex: bool = True) -> Column:
    """Name of the first rule (in order) whose pattern matches; one expression, no join."""
    hits = [
        F.when(F.rlike(text, F.lit(p)) if regex else F.contains(text, F.lit(p)), F.lit(name)) for name, p in rules
    ]
    return F.coalesce(*hits)


def rules_join(df: DataFrame, rules: DataFrame, text: str, regex: bool = False) -> DataFrame:
    """First matching rule per row from a rule list (priority, name, pattern), NULL if none matches.

    Rules are configuration: the list is read once and becomes one expression, without a join or a shuffle.
    Rules of equal priority count in order of their names; a NULL text matches nothing.
    """
    listed = [(r["name"], r["pattern"]) for r in sorted(rules.collect(), key=lambda r: (r["priority"], r["name"]))]
    return df.withColumn("rule", first_rule(F.col(text), listed, regex) if listed else F.lit(None).cast("string"))


def pending_only(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the done set."""
    return df.join(done.select(key), key, "left_anti")


def split_done_pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """All rows with a `done` flag (one join instead of a semi and an anti join)."""
    seen = done.select(F.col(key).alias("_key")).distinct()
    return df.join(seen, F.col(key) == F.col("_key"), "left").withColumn("done", F.col("_key").isNotNull()).drop("_key")


def crm_new_only(leads: DataFrame, crm: DataFrame, name: str = "name") -> DataFrame:
    """Leads whose normalised name is not in the CRM list."""
    known = crm.select(normalize_name(name).alias("_known"))
    return leads.withColumn("_norm", normalize_name(name)).join(
        known, F.col("_norm") == F.col("_known"), "left_anti"
    ).drop("_norm")


def cache_lookup(
    urls: DataFrame, cache: DataFrame, now: Column, ttl_hours: float = 168, key: str = "domain", url: str = "url"
) -> DataFrame:
    """Cached payload by domain or page key; older than the ttl is a miss."""
    make_key = domain_key if key == "domain" else url_key

    c = cache.select(F.col("key").alias("_key"), F.col("cached_at").alias("_cached_at"), F.col("payload").alias("_payload"))
    age = age_hours("_cached_at", now)
    return (
        urls.withColumn("cache_key", make_key(url))
        .join(c, F.col("cache_key") == F.col("_key"), "left")
        .withColumn("age_hours", age)
        .withColumn("hit", F.coalesce(F.col("age_hours") <= ttl_hours, F.lit(False)))
        .withColumn("payload", F.when(F.col("hit"), F.col("_payload")))
        .drop("_key", "_cached_at", "_payload")
    )


def conditional_headers(
    urls: DataFrame, cache: DataFrame, now: Column, ttl_hours: float = 24, url: str = "url"
) -> DataFrame:
    """Map of conditional request headers from the page cache; empty when nothing usable is cached."""

    c = cache.select(
        F.col("key").alias("_key"), F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"),
        F.col("cached_at").alias("_cached_at"),
    )
    joined = urls.withColumn("_url_key", url_key(url)).join(c, F.col("_url_key") == F.col("_key"), "left")
    fresh = F.coalesce(age_hours("_cached_at", now) <= ttl_hours, F.lit(False))
    pairs = F.create_map(F.lit("If-None-Match"), F.col("_etag"), F.lit("If-Modified-Since"), F.col("_modified"))
    usable = F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != "") & fresh)
    return joined.withColumn("headers", usable).drop("_url_key", "_key", "_etag", "_modified", "_cached_at")


def distinct_calls(calls: DataFrame, url: str) -> DataFrame:
    """URLs to fetch once."""
    return calls.select(url).distinct()


def fan_back(calls: DataFrame, responses: DataFrame, url: str) -> DataFrame:
    """Response of each distinct URL back to every call that asked for it."""
    r = responses.select(F.col(url).alias("_url"), F.col("response"))
    return calls.join(r, F.col(url) == F.col("_url"), "left").drop("_url")


#: Figures of the company view by fact table: the largest value of a column, or (None) the number of rows.
FIGURES = {
    "company_socials": {"n_socials": None},
    "event_exhibitors": {"n_events": None},
    "marketplace_sellers": {"n_marketplaces": None, "best_rating": "rating"},
    "company_financials": {"n_financials": None, "latest_year": "year", "max_gmv_eur": "total_gmv_eur"},
    "contacts": {"n_contacts": None},
}


#: Buckets of companies by which mentions are dealt; far more than tasks, the number changes no result.
MENTION_BUCKETS = 1 << 14


@dataclass(frozen=True)
class FactKind:
    """Facts of one table that a mention carries: mentions with equal `key` columns tell of one fact, whose `values`
    (name in the fact table, column of the mention) are those of the last mention that has them."""

    table: str
    key: tuple[str, ...]
    values: Mapping[str, str] = field(default_factory=dict)


def facts_of_mentions(mentions: DataFrame, kinds: Sequence[FactKind], order_by: Sequence[str], company: str = "company_id") -> DataFrame:
    """All kinds of facts from one pass over the mentions: company_id, table, key (texts) and the values of all kinds.

    Mentions are dealt by company before each becomes one row per kind, so that a fact folds to about one row
    however its mentions lie in the files; a company with a third of all mentions is split over several tasks, which
    send its distinct facts only. Numbers under one order column fold in a hash table, without a sort. NULL is a key
    like any other.
    """
    names = list(dict.fromkeys(n for k in kinds for n in k.values))
    of = {n: mentions.schema[k.values[n]].dataType for k in kinds for n in k.values}
    used = dict.fromkeys([*order_by, *[c for k in kinds for c in (*k.key, *k.values.values())]])

    def row(k: FactKind) -> Column:
        value = lambda n: F.col(k.values[n]) if n in k.values else F.lit(None)
        return F.struct(
            F.lit(k.table).alias("table"), F.array(*[F.col(c).cast("string") for c in k.key]).alias("key"),
            order_key(order_by).alias("_order"), *[value(n).cast(of[n]).alias(n) for n in names],
        )

    # one thin row per mention, dealt by a bucket of its company: adaptive execution may split the partition of a large
    # company, as the facts meet by their own key afterwards
    bucket = F.pmod(F.hash(company), F.lit(MENTION_BUCKETS))
    near = mentions.select(F.col(company).alias("_company"), bucket.alias("_bucket"), *used).hint("rebalance", "_bucket")
    told = near.select(F.col("_company").alias("company_id"), F.inline(F.array(*[row(k) for k in kinds])))
    order = F.col("_order")
    return told.groupBy("company_id", "table", "key").agg(F.count("*").alias("n_mentions"), *[last_non_null(n, order) for n in names])


def company_360(tables: Mapping[str, DataFrame], facts: DataFrame | None = None) -> DataFrame:
    """One row per company with figures of its events, marketplaces, links and financials.

    Fact tables are read as one tagged union, aggregated to the company key once and joined once. `facts` are rows
    of `facts_of_mentions`, tagged already, for tables that are not given by themselves.
    """
    given = {n: tables[n] for n in FIGURES if n in tables}
    inputs = list(dict.fromkeys(c for spec in FIGURES.values() for c in spec.values() if c))

    def tagged(df: DataFrame, table: Column) -> DataFrame:
        return df.select("company_id", table.alias("_table"), *[c for c in inputs if c in df.columns])

    parts = [tagged(df, F.lit(name)) for name, df in given.items()]
    kinds = list(given)
    if facts is not None:
        parts.append(tagged(facts, F.col("table")))
        kinds = [n for n in FIGURES if n in given or n not in tables]
    if not parts:
        return tables["companies"]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    of = lambda name, value: F.when(F.col("_table") == name, value)
    aggs, counts = [], []
    for name in kinds:
        for figure, column in FIGURES[name].items():
            if column is None:
                aggs.append(F.count(of(name, 1)).alias(figure))
                counts.append(figure)
            elif column in union.columns:
                aggs.append(F.max(of(name, F.col(column))).alias(figure))
    out = tables["companies"].join(union.groupBy("company_id").agg(*aggs), "company_id", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def company_facets(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Long form of the company view: (company_id, facet, key, detail), one row per fact."""
    parts = []
    spec = {
        "company_socials": ("social", F.col("platform"), F.col("url")),
        "event_exhibitors": ("event", F.col("event_id"), F.col("stand")),
        "marketplace_sellers": ("marketplace", F.col("marketplace_id"), F.col("seller_id")),
        "company_financials": ("financials", F.concat_ws("/", F.col("year").cast("string"), F.col("source")),
                               F.col("total_gmv_eur").cast("string")),
    }
    for name, (facet, key, detail) in spec.items():
        if name in tables:
            parts.append(tables[name].select("company_id", F.lit(facet).alias("facet"), key.alias("key"), detail.alias("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def share_donor_link(previews: DataFrame, job: str, order_by: Sequence[str], link: str = "detail_link") -> DataFrame:
    """The first method with a link lends it to the methods of the job without one."""
    donor = (
        previews.filter(F.coalesce(F.col(link), F.lit("")) != "")
        .groupBy(F.col(job).alias("_job"))
        .agg(first_value_by(F.col(link), order_key(order_by)).alias("_donor"))
    )
    return previews.join(donor, F.col(job) == F.col("_job"), "left").withColumn(
        link, F.coalesce(F.nullif(F.col(link), F.lit("")), F.col("_donor"), F.col(link))
    ).drop("_job", "_donor")


def normalize_country(df: DataFrame, lookup: DataFrame, country: str = "country") -> DataFrame:
    """English country names from a lookup (local, english); unknown names stay."""
    key = lambda c: F.lower(trim_ws(c))
    names = lookup.select(key("local").alias("_local"), F.col("english").alias("_english"))
    return df.join(names, key(country) == F.col("_local"), "left").withColumn(
        country, F.coalesce(F.col("_english"), F.col(country))
    ).drop("_local", "_english")


#: Characters of the runs by which container texts are indexed; shorter names are looked up whole.
GRAM = 4


def _grams(text: Column, n: Column) -> Column:
    """Distinct runs of n characters of a text; NULL where it is shorter."""
    runs = lambda chars: F.transform(
        F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), "")
    )
    # the one-element array binds the characters once for all runs
    return F.when(F.char_length(text) >= n, F.array_distinct(F.get(F.transform(F.array(F.split(text, "")), runs), F.lit(0))))


def naming_boxes(names: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, name, box, link): every container (page_id, box, text, link) whose text contains the name.

    Texts are indexed by their runs of four characters. A name meets only containers with its rarest run on
    the page and is then compared with their texts.
    """
    sized = names.withColumn("n", F.least(F.char_length("name"), F.lit(GRAM)))
    index = boxes.join(sized.select("page_id", "n").distinct(), "page_id").select(
        "page_id", "box", F.explode(_grams(F.col("text"), F.col("n"))).alias("gram")
    )
    spread = index.groupBy("page_id", "gram").agg(F.count("*").alias("boxes"))
    rarest = (
        sized.select("page_id", "name", F.explode(_grams(F.col("name"), F.col("n"))).alias("gram"))
        .join(spread, ["page_id", "gram"], "left")
        .groupBy("page_id", "name")
        .agg(F.min(F.struct(F.coalesce("boxes", F.lit(0)).alias("boxes"), "gram")).alias("rare"))
        .filter(F.col("rare.boxes") > 0)
        .select("page_id", "name", F.col("rare.gram").alias("gram"))
    )
    return (
        rarest.join(index, ["page_id", "gram"]).select("page_id", "name", "box")
        .join(boxes, ["page_id", "box"])
        .filter(F.contains("text", F.col("name")))
        .select("page_id", "name", "box", "link")
    )


def first_come_boxes(wants: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, name, pos, link): greedy one-to-one choice, items (page_id, name, pos, idx) in order of idx and name.

    All items prefer containers in the order of `box`, so the k-th waiting item of a name gets the k-th free
    container of that name unless an earlier item of another name may take it. Each round settles all items
    of which this is certain, the first waiting one of a page among them. Rounds go on until no free container
    names a waiting item: one on most pages, more where names contain each other.
    """
    per_name = Window.partitionBy("page_id", "name")
    per_box = Window.partitionBy("page_id", "box")
    by_head = per_box.orderBy("head")
    turn = F.struct("idx", "name")
    settled = None
    while True:
        queue = wants.withColumn("k", F.row_number().over(per_name.orderBy("pos")))
        heads = queue.filter("k = 1").select("page_id", "name", turn.alias("head"))
        rival = F.when(F.row_number().over(by_head) == 1, F.lead("head").over(by_head)).otherwise(F.first("head").over(by_head))
        offers = (
            pairs.join(heads, ["page_id", "name"])
            .withColumn("k", F.row_number().over(per_name.orderBy("box")))
            .withColumn("rival", rival)
            .join(queue, ["page_id", "name", "k"], "left")
        )
        sure = F.col("pos").isNotNull() & F.coalesce(turn < F.col("rival"), F.lit(True))
        up_to = per_name.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        step = cut_lineage(
            offers.withColumn("won", F.min(sure).over(up_to)).withColumn("taken", F.max("won").over(per_box))
            .select("page_id", "name", "box", "link", "pos", "won", "taken")
        )
        won = step.filter("won").select("page_id", "name", "pos", "link")
        settled = won if settled is None else settled.unionByName(won)
        pairs = step.filter("NOT taken").select("page_id", "name", "box", "link")
        if won.isEmpty() or pairs.isEmpty():
            return settled
        wants = cut_lineage(wants.join(won, ["page_id", "name", "pos"], "left_anti"))


def backfill_links(items: DataFrame, containers: DataFrame) -> DataFrame:
    """Missing detail links from the container whose text names the item most tightly.

    Items (page_id, idx, name, detail_link), containers (page_id, idx, text, link). Items without a link choose
    in order of idx (then name); each takes the free container with a link and the shortest text, the earlier of
    equal ones. Items of a NULL page and items without a name stay as they are, repeated rows count each.
    """
    rows = items.select("page_id", "idx", "name", "detail_link")
    wanted = F.when(F.coalesce("detail_link", F.lit("")) == "", F.nullif(F.lower(trim_ws("name")), F.lit("")))
    rows = rows.withColumn("_name", wanted)
    # positions among equal names are stored, as both the choice and the result refer to them
    rows = cut_lineage(rows.withColumn("_pos", F.row_number().over(Window.partitionBy("page_id", "_name").orderBy("idx", "detail_link", "name"))))
    text = F.btrim(collapse_ws(F.lower("text")))
    shortest = Window.partitionBy("page_id").orderBy(F.char_length("text"), "idx", "text", "link")
    boxes = cut_lineage(
        containers.filter("link IS NOT NULL AND page_id IS NOT NULL").select("page_id", "idx", text.alias("text"), "link")
        .withColumn("box", F.row_number().over(shortest)).select("page_id", "box", "text", "link")
    )
    wants = rows.filter("page_id IS NOT NULL AND _name IS NOT NULL").select("page_id", F.col("_name").alias("name"), F.col("_pos").alias("pos"), "idx")
    pairs = cut_lineage(naming_boxes(wants.select("page_id", "name").distinct(), boxes))
    chosen = first_come_boxes(wants, pairs).select("page_id", F.col("name").alias("_name"), F.col("pos").alias("_pos"), F.col("link").alias("_link"))
    return rows.join(chosen, ["page_id", "_name", "_pos"], "left").select(
        "page_id", "idx", "name", F.coalesce("_link", "detail_link").alias("detail_link")
    )
