"""Page-corpus jobs: items, structured data, links, fingerprints, selector quality."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.nested import (
    array_objects, find_items_list, flat_entries, flatten_json, json_path_items, let, map_from_entries_last, object_entries,
)
from leadloom.functions.text import _c, clean_text, contains_any, strip_tags_keep_lines, trim_ws
from leadloom.functions.urls import id_from_href, resolve_url, url_host
from leadloom.operators.classify import is_junk_field
from leadloom.operators.dom import (
    COMMENT, attr, field_value, first_inside_each, matches, node_text, page_dom, select, with_matches,
)
from leadloom.operators.ordered import first_value_by, keep_first, order_key

# Schema.org types worth keeping.
LD_TYPES = [
    "Organization", "LocalBusiness", "Corporation", "Person", "Store", "Brand", "Product", "Event", "ItemList",
    "ListItem", "WebPage", "ProfilePage",
]
LD_RE = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
LINK_RE = r'<a\s+href="([^"]*)"[^>]*>([^<]*)</a>'

# Marks of an embedded item list.
ATTR_HINTS = [
    "data-info", "data-results", "data-json", "data-state", "data-props", "data-payload", "data-initial",
]
KEY_HINTS = [
    "name", "title", "company", "exhibitor", "seller", "vendor", "booth", "hall", "description", "website", "email",
    "phone", "contact", "country", "city", "address", "category", "brand",
]

# Marks of noise and of wanted API responses.
NOISE_URLS = [
    "config.json", "layout", "/chat", "ichat", "analytics", "tracking", "pixel", "beacon", "metrics", "/ads/",
    "consent", "cookie", "gdpr", "fonts", "icons", "socket.io", "heartbeat", "cdn-cgi", "recaptcha", "gtag", "gtm",
    "hotjar", "sentry", "newrelic", "datadog",
]
NOISE_DOMAINS = [
    "usercentrics.eu", "cookiebot.com", "onetrust.com", "trustarc.com", "google-analytics.com",
    "googletagmanager.com", "facebook.com", "facebook.net", "doubleclick.net", "googleapis.com", "gstatic.com",
    "cloudflare.com", "cdn-cgi", "sentry.io", "hotjar.com", "newrelic.com", "nr-data.net", "segment.io",
    "segment.com", "intercom.io", "zendesk.com", "crisp.chat", "tawk.to", "hubspot.com", "marketo.com",
    "pardot.com", "salesforce.com", "amplitude.com", "mixpanel.com", "heap.io", "fullstory.com",
]
DETAIL_KEYS = [
    "name", "address", "phone", "email", "website", "description", "company", "contact", "fax", "city", "country",
    "postal", "zip", "street", "url", "profile", "social", "category", "product", "brand", "booth", "stand", "hall",
    "seller", "vendor", "exhibitor", "telephone", "store", "rating", "marketplace",
]
DETAIL_URL_WORDS = ["seller", "vendor", "profile", "detail", "company", "exhibitor", "store"]
LISTING_URL_WORDS = [
    "list", "search", "directory", "catalog", "exhibitor", "seller", "vendor", "company", "member", "partner",
]

# Platform patterns; within a group the first match counts.
CMS_RULES = [
    ("WordPress", r"wp-content|wp-includes|wp-json|wordpress"),
    ("Drupal", r"sites/default/files|drupal\.js|Drupal\.settings"),
    ("Joomla", r"/media/jui/|/components/com_"),
    ("Typo3", r"typo3conf/|typo3temp/"),
    ("Contentful", r"contentful\.com|ctfassets\.net"),
    ("Prismic", r"prismic\.io"),
    ("Strapi", r"strapi"),
    ("HubSpot", r"hs-scripts\.com|hubspot\.net|hbspt"),
    ("Wix", r"wix\.com|wixstatic\.com|_wix_browser_sess"),
    ("Squarespace", r"squarespace\.com|sqsp\.net|static\.squarespace"),
    ("Webflow", r"webflow\.com|assets\.website-files\.com"),
]
SHOP_RULES = [
    ("Shopify", r"cdn\.shopify\.com|shopify\.com|Shopify\.theme"),
    ("Magento", r"mage/|Magento_|magento|mage-init"),
    ("WooCommerce", r"woocommerce|wc-ajax|wc_add_to_cart"),
    ("BigCommerce", r"bigcommerce\.com|cdn11\.bigcommerce"),
    ("PrestaShop", r"prestashop|modules/ps_"),
    ("Salesforce Commerce", r"demandware\.net|sfcc|salesforce.*commerce"),
    ("SAP Commerce", r"hybris|sap-commerce"),
]
JS_RULES = [
    ("Next.js", r"__next|_next/static|__NEXT_DATA__"),
    ("Nuxt", r"__nuxt|_nuxt/|__NUXT__"),
    ("Gatsby", r"gatsby-|___gatsby|gatsby-chunk-mapping"),
    ("Angular", r"ng-version|angular\.json|ng-app"),
    ("React", r"__react|react-root|_reactRootContainer|data-reactroot|reactjs"),
    ("Vue.js", r"__vue|vue\.runtime|v-cloak|vue-app"),
    ("Svelte", r"__svelte|svelte-"),
    ("Ember", r"ember\.js|ember-cli|__ember"),
]
SPA_RULES = [
    r'<div\s+id="(?:app|root|__next|__nuxt|___gatsby)"', r"ng-app|ng-version", r"data-reactroot|_reactRootContainer",
    r"__NEXT_DATA__|__NUXT__",
]
API_RULES = [r"/api/v\d|/api/graphql|/graphql", r"__NEXT_DATA__|window\.__INITIAL_STATE__", r"application/ld\+json"]
GENERATOR_RE = r"""(?i)<meta\s+name=["']generator["']\s+content=["']([^"']+)["']"""
GENERATORS = [("wordpress", "WordPress"), ("drupal", "Drupal"), ("joomla", "Joomla")]
SPA_STRONG = [
    'id="__next"', 'id="__nuxt"', "ng-app", "data-ng-app", "<app-root", "data-reactroot", "__vue_app__",
    'id="__svelte"', 'id="svelte"', "ember-application", "data-turbo",
]
SPA_WEAK = ['id="app"', 'id="root"']

# Selectors of what is removed when a page is simplified, in both forms and in the aggressive one.
NOISE_SELECTORS = [
    "script", "style", "noscript", "svg", "iframe",
    "header", "footer", "nav", ".cookie-banner", "#cookie-consent",
]
AGGRESSIVE_SELECTORS = [
    "head",
    "picture", "source", "video", "audio", "embed", "object",
    "[class^='ad-']", "[class*='-ad-']", "[class$='-ad']",
    "[class*='tracking']", "[class*='analytics']",
    "[id^='ad-']", "[id*='-ad-']", "[id$='-ad']", "[id*='tracking']",
    ".social-share", ".social-media", ".share-buttons",
    ".shareholder", ".socialMediaContainer",
    "[class*='cookie-banner']", "[class*='cookie-consent']", "[class*='cookie-notice']",
    "[id*='cookie-banner']", "[id*='cookie-consent']", "[id*='cookie-notice']",
    "[id*='cookie-popup']", "[class*='cookie-popup']",
    "[class*='modal-overlay']", "[class*='modal-backdrop']",
    "[id*='modal-overlay']", "[id*='modal-backdrop']",
    "[class*='leaderboard']", "[id*='leaderboard']",
]


@dataclass(frozen=True)
class Target:
    """Where the items of a listing page are and what to read from each."""

    container: str
    fields: Mapping[str, str | None]
    attributes: Mapping[str, str] = field(default_factory=dict)
    detail_link: str | None = None
    id_selector: str | None = None
    id_attribute: str | None = None
    id_regex: str | None = None


# --- item extraction ---------------------------------------------------------------------


def detail_id(node: Column, id_attribute: str | None, id_regex: str | None) -> Column:
    """API id in a node: attribute, link or text, narrowed by a regex; page links go through their parameters."""
    def narrow(raw: Column) -> Column:
        if not id_regex:
            return raw
        parts = [F.nullif(F.regexp_extract(raw, id_regex, i), F.lit("")) for i in range(1, re.compile(id_regex).groups + 1)]
        whole = F.regexp_extract(raw, id_regex, 0)
        joined = F.nullif(F.concat_ws(".", *parts), F.lit("")) if parts else whole
        return F.when(F.rlike(raw, F.lit(id_regex)), F.coalesce(joined, whole)).otherwise(raw)

    def resolve(value: Column) -> Column:
        href_like = F.contains(value, F.lit("?")) | F.contains(value, F.lit("&")) | F.startswith(value, F.lit("/"))
        return F.nullif(F.when(href_like, id_from_href(value)).otherwise(value), F.lit(""))

    def raw_of(n: Column) -> Column:
        if id_attribute:
            return F.coalesce(attr(n, id_attribute), F.lit(""))
        return F.when(n["tag"] == "a", F.coalesce(attr(n, "href"), F.lit(""))).otherwise(node_text(n, ""))

    return let(let(node, lambda n: trim_ws(narrow(raw_of(n)))), resolve)


def extract_items(dom: DataFrame, target: Target, key: str = "page_id") -> DataFrame:
    """(key, item_idx, item): one map per container, without records whose user fields are all missing."""
    found = with_matches(dom, target.fields, "_f").withColumns({
        "_box": select(target.container), "_link": select(target.detail_link), "_id": select(target.id_selector),
    })

    link = bool(target.detail_link and target.detail_link.strip()) and "detail_link" not in target.fields
    own_id = bool(target.id_selector and target.id_selector.strip()) and "_detail_api_id" not in target.fields
    nodes = [F.col(f"_f{i}") for i in range(len(target.fields))] + [F.col("_link")] * link + [F.col("_id")] * own_id
    firsts = F.arrays_zip("_box", *[first_inside_each(n, F.col("_box")).alias(f"n{i}") for i, n in enumerate(nodes)])

    def record(row: Column) -> Column:
        cells = []
        for i, name in enumerate(target.fields):
            cells += [F.lit(name), field_value(row[f"n{i}"], target.attributes.get(name))]
        at = len(target.fields)
        if link:
            cells += [F.lit("detail_link"), field_value(row[f"n{at}"], "href")]
        if own_id:
            node = row[f"n{at + link}"]
            cells += [F.lit("_detail_api_id"), F.when(node.isNotNull(), detail_id(node, target.id_attribute, target.id_regex))]
        return F.create_map(*cells)

    rows = found.select(key, F.posexplode(let(firsts, lambda z: F.transform(z, record))).alias("item_idx", "item"))
    user = F.map_filter("item", lambda k, v: ~F.startswith(k, F.lit("_")) & (k != "detail_link") & v.isNotNull())
    return rows.filter(F.cardinality(user) > 0)


def detail_fields(dom: DataFrame, fields: Mapping[str, str], attributes: Mapping[str, str] | None = None, key: str = "page_id") -> DataFrame:
    """(key, text): 'field: value' lines of the first matches on a detail page, junk-named fields left out."""
    usable = {f: s for f, s in fields.items() if s and s.strip()}
    found = with_matches(dom, usable, "_f")
    lines = []
    for i, name in enumerate(usable):
        node = F.get(F.col(f"_f{i}"), F.lit(0))
        value = F.coalesce(field_value(node, (attributes or {}).get(name)), F.lit("None"))
        lines.append(F.when(node.isNotNull() & ~is_junk_field(F.lit(name)), F.concat(F.lit(f"{name}: "), value)))
    # made by a generator: what filters the text does not work it out again
    return found.select(key, F.explode(F.array(F.concat_ws("\n", *lines))).alias("text"))


def sub_link_targets(
    dom: DataFrame, links: Sequence[tuple[str, str, str]], base_url: str, max_links: int | None = None, key: str = "url"
) -> DataFrame:
    """(key, label, sub_url): same-host sub-pages per detail page, one row per label.

    `links` are (label, selector, attribute) of the plan.
    """
    cells = []
    for label, selector, attribute in links[:max_links]:
        href = attr(F.get(select(selector), F.lit(0)), attribute)
        cells.append(F.struct(F.lit(label).alias("label"), href.alias("href")))
    rows = dom.select(key, F.inline(F.array(*cells)))
    usable = rows.filter(
        (F.coalesce("href", F.lit("")) != "") & ~F.startswith("href", F.lit("#")) & ~F.startswith("href", F.lit("javascript:"))
    )
    rooted = F.when(F.startswith("href", F.lit("/")), resolve_url(F.lit(base_url), "href")).otherwise(resolve_url(key, "href"))
    absolute = usable.withColumn("sub_url", rooted).filter(url_host("sub_url") == url_host(F.lit(base_url)))
    return absolute.select(key, "label", "sub_url").dropDuplicates([key, "label", "sub_url"])


# --- structured data ---------------------------------------------------------------------


def json_ld_objects(html: Column | str) -> Column:
    """array<JSON text> of the relevant JSON-LD objects of a page."""
    def objects(raw: Column) -> Column:
        t = trim_ws(raw)
        top = F.from_json(t, "map<string,string>")
        graph = F.get_json_object(t, "$['@graph']")
        none = F.array().cast("array<string>")
        from_root = (
            F.when(~F.coalesce(F.map_contains_key(top, "@graph"), F.lit(False)), F.array(t))
            .when(F.startswith(graph, F.lit("[")), array_objects(graph))
            .when(F.startswith(graph, F.lit("{")), F.array(graph))
            .otherwise(none)
        )
        valid = F.try_parse_json(t).isNotNull()
        return F.when(valid & F.startswith(t, F.lit("{")), from_root).when(
            valid & F.startswith(t, F.lit("[")), array_objects(t)
        ).otherwise(none)

    def relevant(item: Column) -> Column:
        m = F.from_json(item, "map<string,variant>")
        v = F.element_at(m, F.lit("@type"))
        kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        names = F.from_json(F.get_json_object(item, "$['@type']"), "array<string>")
        return F.map_contains_key(m, "@type") & F.when(
            kind == "STRING", F.get_json_object(item, "$['@type']").isin(*LD_TYPES)
        ).when(
            F.startswith(kind, F.lit("ARRAY")), (F.size(names) == 0) | F.exists(names, lambda n: n.isin(*LD_TYPES))
        ).otherwise(F.lit(True))

    blocks = F.regexp_extract_all(_c(html), F.lit(LD_RE), F.lit(1))
    found = F.filter(F.flatten(F.transform(blocks, objects)), relevant)
    # pages without the media type skip the parse
    return F.when(F.contains(_c(html), F.lit("ld+json")), found).otherwise(F.array().cast("array<string>"))


def json_ld(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, object): relevant JSON-LD objects."""
    return pages.select(key, F.posexplode(json_ld_objects(html)).alias("pos", "object"))


def open_graph(dom: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, open_graph): og:* and twitter:* metadata, the last value of a name wins."""
    def metas(name_attr: str, prefix: str) -> Column:
        hits = F.filter(
            F.col("nodes"),
            lambda n: (n["tag"] == "meta")
            & F.coalesce(F.startswith(attr(n, name_attr), F.lit(prefix)), F.lit(False))
            & (F.coalesce(attr(n, "content"), F.lit("")) != ""),
        )
        return F.transform(hits, lambda n: F.struct(attr(n, name_attr).alias("key"), attr(n, "content").alias("value")))

    entries = F.concat(metas("property", "og:"), metas("name", "twitter:"))
    return dom.select(key, map_from_entries_last(entries).alias("open_graph"))


def microdata(dom: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, scope, parent_scope, type, prop, pos, value, value_scope) of reachable microdata scopes.

    A property that is itself a scope has its scope number in `value_scope`. Scopes without
    properties appear with a NULL property. Nested scopes without `itemprop` are left out.
    """
    nodes = F.col("nodes")
    has = lambda n, a: F.map_contains_key(n["attrs"], F.lit(a))
    node_at = lambda j: F.get(nodes, j)
    scopes_above = lambda n: F.filter(n["anc"], lambda j: has(node_at(j), "itemscope"))
    nearest = lambda n: F.get(scopes_above(n), F.size(scopes_above(n)) - 1)

    def reachable(n: Column) -> Column:
        chain = F.concat(scopes_above(n), F.array(n["idx"]))
        return F.forall(F.slice(chain, F.lit(2), F.size(chain)), lambda j: has(node_at(j), "itemprop"))

    def value(n: Column) -> Column:
        text = node_text(n, "")
        return (
            F.when(has(n, "itemscope"), F.lit(None).cast("string"))
            .when(n["tag"] == "meta", F.coalesce(attr(n, "content"), F.lit("")))
            .when(n["tag"].isin("a", "link"), F.coalesce(attr(n, "href"), text))
            .when(n["tag"] == "img", F.coalesce(attr(n, "src"), attr(n, "alt"), F.lit("")))
            .when(n["tag"] == "time", F.coalesce(attr(n, "datetime"), text))
            .otherwise(text)
        )

    scopes = F.transform(
        F.filter(nodes, lambda n: has(n, "itemscope") & reachable(n)),
        lambda n: F.struct(
            n["idx"].alias("scope"), nearest(n).alias("parent_scope"),
            F.nullif(F.substring_index(attr(n, "itemtype"), "/", -1), F.lit("")).alias("type"),
        ),
    )
    props = F.transform(
        F.filter(nodes, lambda n: (F.coalesce(attr(n, "itemprop"), F.lit("")) != "") & (F.size(scopes_above(n)) > 0)),
        lambda n: F.struct(
            nearest(n).alias("owner"), attr(n, "itemprop").alias("prop"), n["idx"].alias("pos"), value(n).alias("value"),
            F.when(has(n, "itemscope"), n["idx"]).alias("value_scope"),
        ),
    )
    pages = dom.select(key, scopes.alias("_scopes"), props.alias("_props"))
    rows = pages.select(key, "_props", F.inline("_scopes"))
    own = F.filter("_props", lambda p: p["owner"] == F.col("scope"))
    return rows.select(key, "scope", "parent_scope", "type", F.inline_outer(own)).drop("owner")


def merge_structured(pages: DataFrame, job: str, order_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per job the first non-empty value of each structured-data column, in page order."""
    order = order_key(order_by)
    return pages.groupBy(job).agg(*[
        first_value_by(F.col(c), order, F.cardinality(F.col(c)) > 0).alias(c) for c in columns
    ])


# --- embedded and API item lists ---------------------------------------------------------


def _key_hits(item: Column, hints: Sequence[str]) -> Column:
    """How many distinct keys of an object (and of its nested objects) contain a hint."""
    entries = object_entries(item)
    inner = F.flatten(F.transform(
        F.filter(entries, lambda e: e["nested"]), lambda e: F.map_keys(F.from_json(e["value"], "map<string,string>"))
    ))
    keys = F.array_distinct(F.transform(F.concat(F.transform(entries, lambda e: e["key"]), inner), F.lower))
    return F.size(F.filter(keys, lambda k: contains_any(k, hints)))


def _head(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0), lambda a, x: a + x)


def embedded_source(dom: DataFrame, key: str = "page_id", scored_items: int | None = None, min_chars: int = 100, depth: int = 5) -> DataFrame:
    """(key, score, path, attribute, tag, total, items): best embedded JSON list per page.

    A list scores by the hint keys of its items, of all or of the first `scored_items`. Texts below `min_chars`
    are no lists of items; lists are searched `depth` levels deep.
    """
    looks_json = lambda v: F.rlike(v, F.lit(r"^\s*[\[{]"))

    def attr_candidates(n: Column) -> Column:
        usable = F.filter(
            F.map_entries(n["attrs"]),
            lambda e: (e["key"] != "class") & (F.length(e["value"]) >= min_chars)
            & (F.startswith(e["key"], F.lit("data-")) | F.contains(e["key"], F.lit("json")) | looks_json(e["value"])),
        )
        return F.transform(usable, lambda e: F.struct(
            n["tag"].alias("tag"), e["key"].alias("attribute"), e["key"].alias("hint"), trim_ws(e["value"]).alias("json")
        ))

    scripts = F.filter(
        F.col("nodes"),
        lambda n: (n["tag"] == "script") & (F.length(n["raw"]) >= min_chars)
        & (
            (F.lower(F.coalesce(attr(n, "type"), F.lit(""))) == "")
            | F.contains(F.lower(attr(n, "type")), F.lit("json"))
            | looks_json(n["raw"])
        ),
    )
    script_candidates = F.transform(scripts, lambda n: F.struct(
        n["tag"].alias("tag"), F.lit(None).cast("string").alias("attribute"),
        F.coalesce(F.nullif(F.lower(attr(n, "type")), F.lit("")), F.lit("script")).alias("hint"),
        trim_ws(n["raw"]).alias("json"),
    ))
    candidates = F.concat(F.flatten(F.transform(F.col("nodes"), attr_candidates)), script_candidates)
    rows = dom.select(key, F.posexplode(candidates).alias("_cand", "_c")).select(key, "_cand", "_c.*")
    valid = rows.filter(looks_json(F.col("json")) & F.try_parse_json("json").isNotNull())
    lists = F.when(
        F.startswith("json", F.lit("[")), F.array(F.struct(F.lit(None).cast("string").alias("path"), array_objects(F.col("json")).alias("items")))
    ).otherwise(F.transform(
        F.filter(flat_entries(F.col("json"), depth), lambda e: F.startswith(e["value"], F.lit("["))),
        lambda e: F.struct(e["key"].alias("path"), array_objects(e["value"]).alias("items")),
    ))
    found = valid.select(key, "_cand", "tag", "attribute", "hint", F.posexplode(lists).alias("_list", "_l")).select(
        key, "_cand", "_list", "tag", "attribute", "hint", "_l.path", "_l.items"
    ).filter(F.size("items") >= 2)
    text = F.lower(F.concat("hint", F.lit(" "), F.coalesce("path", F.lit(""))))
    bonus = lambda words, points: F.when(contains_any(text, words), points).otherwise(0)
    hits = _sum(F.transform(_head(F.col("items"), scored_items), lambda i: _key_hits(i, KEY_HINTS)))
    score = (
        hits * 10 + F.least(F.size("items"), F.lit(100)) + bonus(["result"], 20) + bonus(["item"], 10)
        + bonus(["exhibitor", "seller", "vendor"], 20)
    )
    scored = found.withColumn("score", score).filter(F.col("score") >= 30)
    best = keep_first(scored, [key], [F.desc("score"), "_cand", "_list"])
    return best.select(
        key, "score", "path", "attribute", "tag", F.size("items").alias("total"), "items",
    )


def embedded_items(dom: DataFrame, selector: str, attribute: str | None, path: str | None, key: str = "page_id") -> DataFrame:
    """(key, pos, item): items of a known embedded source as flat maps, in order.

    The JSON is the attribute of the first node that the selector finds, or its text; `path` is a dot path in
    it. A list gives its objects, an object itself; anything else, and a page without the node, nothing.
    """
    node = F.get(select(selector), F.lit(0))
    raw = attr(node, attribute) if attribute else node_text(node, "")
    rows = dom.select(key, F.posexplode(json_path_items(raw, path)).alias("pos", "_json"))
    return rows.select(key, "pos", flatten_json("_json").alias("item"))


def detail_api_score(url: Column, body: Column) -> Column:
    """How likely a JSON response is the detail API; negative means noise, as is anything but an object."""
    low = F.lower(url)
    size = F.size(F.map_keys(F.from_json(body, "map<string,string>")))
    words = sum([F.when(F.contains(low, F.lit(w)), 15).otherwise(0) for w in DETAIL_URL_WORDS], F.lit(0))
    score = F.when(contains_any(low, NOISE_URLS), F.lit(-1000)).otherwise(_key_hits(body, DETAIL_KEYS) * 10 + words + size)
    return F.coalesce(score, F.lit(-1000))


def _site_root(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def listing_api_score(url: Column, body: Column, page_host: Column, scored_items: int | None = None) -> Column:
    """How likely a JSON response is the listing API of the page, by all its items or the first `scored_items`."""
    low, host = F.lower(url), url_host(url)
    third_party = F.lit(False)
    for d in NOISE_DOMAINS:
        third_party = third_party | F.endswith(host, F.lit(d))
    found = find_items_list(body)
    items = found["items"]
    n = F.size(items)
    hits = _sum(F.transform(_head(items, scored_items), lambda i: _key_hits(i, DETAIL_KEYS)))
    words = sum([F.when(F.contains(low, F.lit(w)), 15).otherwise(0) for w in LISTING_URL_WORDS], F.lit(0))
    length = F.when(n > 20, 100).when(n > 5, 50).otherwise(0)
    return (
        F.when(contains_any(low, NOISE_URLS) | third_party, F.lit(-1000))
        .when((page_host != "") & (host != "") & (_site_root(page_host) != _site_root(host)), F.lit(-500))
        .when(n == 0, F.lit(-500))
        .otherwise(hits * 10 + length + words + n)
    )


def score_api_responses(responses: DataFrame, job: str, order_by: Sequence[str], kind: str = "detail") -> DataFrame:
    """Best response per job (url, body, page_host); jobs with only noise have no row."""
    if kind == "detail":
        score = detail_api_score(F.col("url"), F.col("body"))
    else:
        score = listing_api_score(F.col("url"), F.col("body"), F.col("page_host"))
    scored = responses.withColumn("score", score).filter(F.col("score") >= 0)
    return keep_first(scored, [job], [F.desc("score"), *order_by])


# --- text of pages -----------------------------------------------------------------------


def simplify_pages(pages: DataFrame, aggressive: bool = False, max_chars: int | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, html): pages without noise elements and comments, whitespace collapsed.

    Noise elements are node ranges that are taken out of the page's source: the outermost ones, each with all it
    holds; one that is never closed ends where the element around it does. What is left stays as it was written.
    The aggressive form also takes out the head, media and ad, share and consent containers, gives images a
    placeholder and drops data, style and event attributes and script links. A null page is empty. With
    `max_chars` longer results are cut and marked.
    """
    tests = [matches(s) for s in NOISE_SELECTORS + (AGGRESSIVE_SELECTORS if aggressive else [])]

    def noise(n: Column) -> Column:
        hit = F.lit(False)
        for test in tests:
            hit = hit | test(n)
        return hit

    def outermost(flags: Column) -> Column:
        return F.filter(F.col("nodes"), lambda n: F.get(flags, n["idx"]) & ~F.exists(n["anc"], lambda j: F.get(flags, j)))

    def remaining(cut: Column) -> Column:
        def between(i: Column) -> Column:
            start = F.coalesce(F.get(cut, i - 1)["p1"], F.lit(0))
            end = F.coalesce(F.get(cut, i)["p0"], F.size("pieces"))
            return F.slice("pieces", start + 1, F.greatest(end - start, F.lit(0)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), between))

    ranges = let(F.transform(F.col("nodes"), noise), outermost)
    kept = F.filter(let(F.transform(ranges, lambda n: F.struct(n["p0"].alias("p0"), n["p1"].alias("p1"))), remaining), lambda p: p["node"] != COMMENT)
    text = F.array_join(F.transform(kept, _plain_tag if aggressive else lambda p: p["text"]), "")
    short = F.regexp_replace(F.regexp_replace(text, r"\n\s*\n", "\n"), " {2,}", " ")
    return page_dom(pages, html, (key,), source=True).select(key, _cut(short, max_chars).alias("html"))


def _plain_tag(piece: Column) -> Column:
    """Source of a piece; a start tag with unwanted attributes is written anew without them."""
    node = F.get(F.col("nodes"), piece["node"])
    attrs = F.map_entries(node["attrs"])
    unwanted = lambda k: F.startswith(k, F.lit("data-")) | F.startswith(k, F.lit("on")) | (k == "style")
    script = lambda e: (e["key"] == "href") & F.startswith(e["value"], F.lit("javascript:"))
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    alt = F.transform(F.filter(attrs, lambda e: (e["key"] == "alt") & (e["value"] != "")), lambda e: entry(e["key"], e["value"]))
    image = F.concat(F.array(entry(F.lit("src"), F.lit("[removed]"))), alt)
    other = F.transform(F.filter(attrs, lambda e: ~unwanted(e["key"])), lambda e: entry(e["key"], F.when(script(e), F.lit("#")).otherwise(e["value"])))
    escaped = lambda v: F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    written = F.transform(F.when(node["tag"] == "img", image).otherwise(other), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    changed = (node["tag"] == "img") | F.exists(attrs, lambda e: unwanted(e["key"]) | script(e))
    return F.when((piece["node"] >= 0) & changed, F.concat(F.lit("<"), node["tag"], F.array_join(written, ""), F.lit(">"))).otherwise(piece["text"])


def _cut(t: Column, max_chars: int | None) -> Column:
    if max_chars is None:
        return t
    return F.when(F.length(t) > max_chars, F.concat(F.left(t, F.lit(max_chars)), F.lit("\n<!-- TRUNCATED -->"))).otherwise(t)


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href, text) of anchors."""
    pair = F.arrays_zip(
        F.regexp_extract_all(F.col(html), F.lit(LINK_RE), F.lit(1)).alias("href"),
        F.regexp_extract_all(F.col(html), F.lit(LINK_RE), F.lit(2)).alias("text"),
    )
    return pages.select(key, F.posexplode(pair).alias("pos", "_l")).select(key, "pos", "_l.href", "_l.text")


def max_page_number(c: Column | str, param: str = "av_page") -> Column:
    """Highest page number in the links of a page, 1 without any."""
    found = F.regexp_extract_all(_c(c), F.lit(rf'href="[^"]*{param}=(\d+)'), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.try_cast("bigint"))), F.lit(1).cast("bigint"))


def numbered_links(links: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, links): numeric pager links per page, sorted and distinct; pages with fewer than two have no row.

    A group is the link list of one page.
    """
    numeric = links.filter(F.rlike("text", F.lit(r"^\s*\d+\s*$"))).select(
        key, F.struct(trim_ws("text").try_cast("bigint").alias("num"), F.col("href").alias("href")).alias("l")
    )
    return numeric.groupBy(key).agg(F.array_sort(F.collect_set("l")).alias("links")).filter(F.size("links") >= 2)


def dt_dd_pairs(c: Column | str) -> Column:
    """Definition lists as a map label -> value; later pairs replace earlier ones."""
    pattern = r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>"
    pairs = F.arrays_zip(
        F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(1)).alias("k"),
        F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(2)).alias("v"),
    )
    clean = F.transform(pairs, lambda p: F.struct(
        clean_text(strip_tags_keep_lines(p["k"])).alias("key"), clean_text(strip_tags_keep_lines(p["v"])).alias("value")
    ))
    return map_from_entries_last(F.filter(clean, lambda e: (e["key"] != "") & (e["value"] != "")))


def all_by_test_id(c: Column | str, test_id: str) -> Column:
    found = F.regexp_extract_all(_c(c), F.lit(rf'(?i)data-test-id="{re.escape(test_id)}"[^>]*>([^<]+)'), F.lit(1))
    return F.filter(F.transform(found, clean_text), lambda x: x != "")


def by_test_id(c: Column | str, test_id: str) -> Column:
    return clean_text(F.regexp_extract(_c(c), rf'(?i)data-test-id="{re.escape(test_id)}"[^>]*>([^<]+)', 1))


# --- template and platform ---------------------------------------------------------------


def structural_hash(c: Column | str, max_chars: int | None = None) -> Column:
    """Hash of the tag skeleton, of its first `max_chars` characters if given: pages of one template share it."""
    t = F.regexp_replace(_c(c), ">([^<]+)<", "><")
    t = F.regexp_replace(t, r"\s[^>]*(?=>)", "")
    return F.left(F.sha2(t if max_chars is None else F.left(t, F.lit(max_chars)), 256), F.lit(16))


def template_clusters(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, hash, pages, sample_url): pages that can share one extractor."""
    slim = pages.select(url_host(url).alias("host"), structural_hash(html).alias("hash"), F.col(url).alias("_url"))
    return slim.groupBy("host", "hash").agg(F.count("*").alias("pages"), F.min("_url").alias("sample_url"))


def _matches_any(low: Column, pattern: str) -> Column:
    """Test of a lower-case text: plain alternatives by substring search, the rest by regex."""
    plain, rest = [], []
    for part in pattern.split("|"):
        bare = part.replace("\\.", ".")
        (plain if not re.search(r"[\\*+?()\[\]{}^$]", bare) and "." not in part.replace("\\.", "") else rest).append((part, bare))
    hit = contains_any(low, [b.lower() for _, b in plain])
    for part, _ in rest:
        hit = hit | F.rlike(low, F.lit("(?i)" + part))
    return F.coalesce(hit, F.lit(False))


def _first_rule(low: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(_matches_any(low, p), F.lit(n)) for n, p in rules])


def _first_marker(low: Column, rules: Sequence[str]) -> Column:
    """First 40 characters of the first rule that matches, NULL if none does."""
    hit = lambda r: F.rlike(low, F.lit("(?i)" + r)) if "(" in r else _matches_any(low, r)
    return F.coalesce(*[F.when(hit(r), F.lit(r[:40])) for r in rules])


def fingerprint(html: Column | str, headers: Column | None = None, max_chars: int | None = None) -> Column:
    """struct(cms, ecommerce, js_framework, cdn, server, has_api, is_spa, signals) of a page."""
    text = _c(html) if max_chars is None else F.left(_c(html), F.lit(max_chars))
    h = F.create_map().cast("map<string,string>") if headers is None else headers
    get = lambda k: F.coalesce(F.element_at(h, F.lit(k)), F.lit(""))
    has = lambda k: F.coalesce(F.map_contains_key(h, k), F.lit(False))

    def from_html(low: Column) -> Column:
        return F.struct(
            _first_rule(low, CMS_RULES).alias("cms"), _first_rule(low, SHOP_RULES).alias("shop"),
            _first_rule(low, JS_RULES).alias("js"), _first_marker(low, SPA_RULES).alias("spa"),
            _first_marker(low, API_RULES).alias("api"),
            # the tag is searched only where the word occurs
            F.when(F.contains(low, F.lit("generator")), F.regexp_extract(text, GENERATOR_RE, 1)).otherwise("").alias("generator"),
        )

    powered, content_type = get("x-powered-by"), get("content-type")
    cdn = (
        F.when(has("cf-ray") | has("cf-cache-status"), F.lit("Cloudflare"))
        .when(has("x-amz-cf-id"), F.lit("CloudFront"))
        .when(has("x-fastly-request-id"), F.lit("Fastly"))
        .when(has("x-akamai-transformed") | F.contains(F.lower(get("via")), F.lit("akamai")), F.lit("Akamai"))
    )
    next_js = F.when(F.contains(F.lower(powered), F.lit("next.js")), F.lit("Next.js"))
    api_type = F.contains(content_type, F.lit("application/json")) | F.contains(content_type, F.lit("graphql"))
    labelled = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))

    def report(f: Column) -> Column:
        by_generator = F.coalesce(*[F.when(F.contains(F.lower(f["generator"]), F.lit(g)), F.lit(n)) for g, n in GENERATORS])
        signals = F.array_compact(F.array(
            labelled("Server: ", get("server")), labelled("CDN: ", F.when(cdn == "Cloudflare", F.lit("Cloudflare (cf-ray)")).otherwise(cdn)),
            labelled("X-Powered-By: ", powered),
            F.when(next_js.isNull() & F.contains(F.lower(powered), F.lit("express")), F.lit("Node/Express backend detected")),
            F.when(api_type, F.concat(F.lit("API evidence: Content-Type="), content_type)),
            labelled("CMS signal: ", f["cms"]), labelled("Ecommerce signal: ", f["shop"]),
            labelled("JS framework signal: ", f["js"]), labelled("SPA marker: ", f["spa"]),
            labelled("API evidence in HTML: ", f["api"]), labelled("Generator: ", f["generator"]),
        ))
        return F.struct(
            F.coalesce(f["cms"], by_generator).alias("cms"),
            f["shop"].alias("ecommerce"),
            F.coalesce(next_js, f["js"]).alias("js_framework"),
            cdn.alias("cdn"),
            F.nullif(F.substring_index(get("server"), "/", 1), F.lit("")).alias("server"),
            (api_type | f["api"].isNotNull()).alias("has_api"),
            f["spa"].isNotNull().alias("is_spa"),
            signals.alias("signals"),
        )

    return let(let(F.lower(text), from_html), report)


def needs_rendering(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, needs_js): pages whose raw HTML does not hold the content."""
    dom = page_dom(pages, html, (key, url, html))
    low = F.lower(F.col(html))
    body = F.get(F.filter(F.col("nodes"), lambda n: n["tag"] == "body"), F.lit(0))
    text_len = F.length(node_text(body, ""))
    has_body = body.isNotNull()
    # web components one or two levels below <body>, by the length of their source
    component = F.exists(
        F.col("nodes"),
        lambda n: F.contains(n["tag"], F.lit("-"))
        & has_body
        & (n["anc"][F.size(n["anc"]) - 1].eqNullSafe(body["idx"]) | F.get(n["anc"], F.size(n["anc"]) - 2).eqNullSafe(body["idx"]))
        & (n["s1"] - n["s0"] > 500),
    )
    failing = (
        (F.length(html) < 2000)
        | F.contains(low, F.lit("<noscript>"))
        | contains_any(low, SPA_STRONG)
        | (contains_any(low, SPA_WEAK) & has_body & (text_len < 500))
        | component
        | (has_body & (text_len < 200))
    )
    routed = F.contains(url, F.lit("#/")) | F.contains(url, F.lit("#!/"))
    return dom.select(key, F.coalesce(routed | failing, F.lit(True)).alias("needs_js"))


# --- selector quality --------------------------------------------------------------------


def selector_metrics(dom: DataFrame, target: Target, key: str = "page_id", sample: int | None = None) -> DataFrame:
    """(key, container_count, sampled_containers, field_checks, field_hits, field_hit_ratio)."""
    usable = {f: s for f, s in target.fields.items() if s and s.strip()}
    found = with_matches(dom, usable, "_f").withColumn("_box", select(target.container))
    boxes = F.col("_box") if sample is None else F.slice("_box", 1, max(1, sample))

    hits = [F.size(F.filter(first_inside_each(F.col(f"_f{i}"), boxes), lambda n: n.isNotNull())) for i in range(len(usable))]
    sampled = F.size(boxes)
    checks = sampled * len(usable)
    total = sum(hits, F.lit(0))
    return found.select(
        key, F.size("_box").alias("container_count"), sampled.alias("sampled_containers"), checks.alias("field_checks"),
        total.alias("field_hits"),
        F.round(F.coalesce(F.try_divide(total, checks), F.lit(0.0)), 4).alias("field_hit_ratio"),
    )


def content_score(dom: DataFrame, target: Target, key: str = "page_id", sample: int | None = None) -> DataFrame:
    """(key, content_score): share of (container, field) pairs with real content; nothing to test -> 1."""
    usable = {f: s for f, s in target.fields.items() if s and s.strip()}
    found = with_matches(dom, usable, "_f").withColumn("_box", select(target.container))
    boxes = F.col("_box") if sample is None else F.slice("_box", 1, sample)

    def filled_boxes(found_nodes: Column, attribute: str | None) -> Column:
        def ok(node: Column) -> Column:
            good = F.length(node_text(node, "")) >= 2
            if attribute:
                good = good | (trim_ws(attr(node, attribute)) != "")
            return F.coalesce(node.isNotNull() & good, F.lit(False))

        return F.size(F.filter(first_inside_each(found_nodes, boxes), ok))

    filled = [filled_boxes(F.col(f"_f{i}"), target.attributes.get(n)) for i, n in enumerate(usable)]
    checks = F.size(boxes) * len(usable)
    return found.select(
        key, F.when(checks > 0, sum(filled, F.lit(0)) / checks).otherwise(F.lit(1.0)).alias("content_score")
    )
