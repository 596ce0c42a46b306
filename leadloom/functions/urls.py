"""URL, header and paging functions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.nested import let, map_from_entries_last
from leadloom.functions.text import _c, trim_ws

# Generic URI split: scheme, authority, path, query.
URI_RE = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

# Query parameters that carry an entity id, in order of trust.
ID_PARAMS = [
    "id", "entityId", "entity_id", "exhibitorId", "exhibitor_id", "sellerId", "seller_id",
    "companyId", "company_id", "uid", "actionItem", "itemId", "item_id",
]
ID_FIELDS = ["id", "entityId", "entity_id", "slug", "uid"]

# Literal addresses a crawl must not touch: loopback, private, link-local and reserved ranges.
PRIVATE_V4_RE = (
    r"^(?:0|10|127)\.\d+\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+$"
    r"|^192\.0\.[02]\.\d+$|^198\.1[89]\.\d+\.\d+$|^198\.51\.100\.\d+$|^203\.0\.113\.\d+$|^2(?:4\d|5[0-5])\.\d+\.\d+\.\d+$"
)
PRIVATE_V6_RE = r"(?i)^\[(?:::1?|f[cd][0-9a-f:]*|fe[89ab][0-9a-f:]*)\]$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URI_RE, group)


def url_parts(c: Column | str) -> Column:
    """struct(origin, netloc, host, path, query); NULL without scheme and host."""
    u = _c(c)
    scheme, netloc = _part(u, 1), _part(u, 2)
    parts = F.struct(
        F.concat(F.lower(scheme), F.lit("://"), netloc).alias("origin"),
        netloc.alias("netloc"),
        url_host(u).alias("host"),
        _part(u, 3).alias("path"),
        _part(u, 4).alias("query"),
    )
    return F.when((scheme != "") & (netloc != ""), parts)


def url_host(c: Column | str) -> Column:
    """Lower-case host without user and port."""
    netloc = _part(_c(c), 2)
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":\d*$", ""))


def url_path(c: Column | str) -> Column:
    return _part(_c(c), 3)


def query_param(c: Column | str, name: str) -> Column:
    """First non-empty value of a query parameter, decoded; NULL when absent."""
    return _param(_part(_c(c), 4), name)


def _param(query: Column, name: str) -> Column:
    raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1)
    return F.when(raw != "", F.coalesce(F.try_url_decode(raw), raw))


def _normalize_path(path: Column) -> Column:
    """Resolve '.' and '..' segments."""
    segments = F.split(path, "/")
    last_is_dots = F.get(segments, F.size(segments) - 1).isin(".", "..")
    stack = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.array_join(stack, "/"), F.when(last_is_dots, F.lit("/")).otherwise(F.lit("")))


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute link: root-relative on the origin, other relative forms on the base folder."""
    b, h = _c(base), _c(href)
    origin = F.concat(_part(b, 1), F.lit("://"), _part(b, 2))
    base_path = _part(b, 3)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    rel_path, rel_tail = F.regexp_extract(h, r"^([^?#]*)", 1), F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    base_query = F.when(_part(b, 4) != "", F.concat(F.lit("?"), _part(b, 4))).otherwise(F.lit(""))
    return (
        F.when(F.startswith(h, F.lit("/")), F.concat(origin, h))
        .when(F.rlike(h, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")) | F.startswith(h, F.lit("http")), h)
        .when(h == "", b)
        .when(F.startswith(h, F.lit("?")), F.concat(origin, base_path, h))
        .when(F.startswith(h, F.lit("#")), F.concat(origin, base_path, base_query, h))
        .otherwise(F.concat(origin, _normalize_path(F.concat(folder, rel_path)), rel_tail))
    )


def url_allowed_scheme(c: Column | str) -> Column:
    """http(s) with a host that is not a loopback, private or reserved literal address."""
    u = trim_ws(c)
    netloc = F.lower(F.regexp_replace(F.regexp_replace(_part(u, 2), r"^.*@", ""), r":\d+$", ""))
    return F.coalesce(
        F.lower(_part(u, 1)).isin("http", "https")
        & (netloc != "")
        & (netloc != "localhost")
        & ~F.rlike(netloc, F.lit(PRIVATE_V4_RE))
        & ~F.rlike(netloc, F.lit(PRIVATE_V6_RE)),
        F.lit(False),
    )


def domain_key(c: Column | str) -> Column:
    """Plan-cache key: host and path without trailing slashes; scheme and query do not matter."""
    raw = F.lower(F.concat(_part(_c(c), 2), F.rtrim(_part(_c(c), 3), F.lit("/"))))
    return F.left(F.sha2(raw, 256), F.lit(16))


def url_key(c: Column | str) -> Column:
    """Page-cache key of a URL."""
    return F.left(F.sha2(_c(c), 256), F.lit(20))


def id_from_href(c: Column | str) -> Column:
    """Entity id in a link: event + item pair, a usual id parameter, or an id-like path segment."""
    def pick(p: Column) -> Column:
        event = F.coalesce(_param(p["query"], "_event"), _param(p["query"], "event"))
        item = F.coalesce(_param(p["query"], "actionItem"), _param(p["query"], "action_item"))
        id_like = F.filter(
            F.reverse(F.split(p["path"], "/")),
            lambda s: (s != "") & F.rlike(s, F.lit(r"^[\w.-]+\d+[\w.-]*$")) & (F.length(s) <= 40),
        )
        by_param = [_param(p["query"], k) for k in ID_PARAMS]
        # without a query only the path can hold the id
        found = F.when(p["query"] != "", F.coalesce(F.concat(event, F.lit("."), item), *by_param))
        return F.coalesce(found, F.get(id_like, F.lit(0)))

    u = _c(c)
    return let(F.struct(_part(u, 4).alias("query"), _part(u, 3).alias("path")), pick)


def clean_api_id(c: Column | str) -> Column:
    """'profile=ev.12' -> 'ev.12'; values with a slash or question mark stay."""
    v = _c(c)
    pair = F.contains(v, F.lit("=")) & ~F.contains(v, F.lit("/")) & ~F.contains(v, F.lit("?"))
    return F.when(pair, F.substring_index(v, "=", -1)).otherwise(v)


def populate_api_id(m: Column | str) -> Column:
    """Detail id of an item: already set, else from the first filled id field."""
    item = _c(m)
    get = lambda k: F.nullif(F.element_at(item, F.lit(k)), F.lit(""))
    return F.coalesce(get("_detail_api_id"), clean_api_id(F.coalesce(*[get(k) for k in ID_FIELDS])))


def fill_template(template: Column | str, value: Column | str) -> Column:
    t = F.lit(template) if isinstance(template, str) else template
    return F.replace(t, F.lit("{id}"), _c(value))


# --- paging ------------------------------------------------------------------------------


def _query_pairs(url: Column) -> Column:
    """array<struct<k, v>> of the query, decoded, first value per key, in order."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    pairs = F.transform(
        F.filter(F.split(_part(url, 4), "&"), lambda p: p != ""),
        lambda p: F.struct(
            plain(F.substring_index(p, "=", 1)).alias("k"),
            plain(F.when(F.contains(p, F.lit("=")), F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).otherwise(F.lit(""))).alias("v"),
        ),
    )
    return let(pairs, lambda ps: F.filter(
        ps, lambda p, i: ~F.exists(F.slice(ps, F.lit(1), i), lambda q: q["k"] == p["k"])
    ))


def _int_of(v: Column) -> Column:
    return F.when(F.rlike(v, F.lit(r"^[+-]?\d+$")), v.try_cast("bigint"))


def _value_of(pairs: Column, key: Column) -> Column:
    return F.get(F.filter(pairs, lambda p: p["k"] == key), F.lit(0))["v"]


def _form_encoded(c: Column) -> Column:
    """A query part as forms write it: unreserved characters stay, a space becomes a plus sign."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _with_param(url: Column, pairs: Column, key: Column, value: Column) -> Column:
    query = F.array_join(
        F.transform(
            pairs,
            lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(F.when(p["k"] == key, value.cast("string")).otherwise(p["v"]))),
        ),
        "&",
    )
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), query, fragment)


def expand_pages(urls: Column | str, total_hint: Column | str, max_pages: int | None = None) -> Column:
    """Listing URLs extended by the rising integer parameter up to the hinted item total, at most `max_pages`."""
    def rising(p: Column) -> Column:
        """struct(k, v, last): first parameter that is a smaller integer in the first than in the last URL."""
        pairs = F.transform(p["first"], lambda x: F.struct(
            x["k"].alias("k"), _int_of(x["v"]).alias("lo"), _int_of(_value_of(p["last"], x["k"])).alias("hi")
        ))
        return F.get(F.filter(pairs, lambda x: F.coalesce(x["hi"] > x["lo"], F.lit(False))), F.lit(0))

    def paging(p: Column, r: Column) -> Column:
        step = F.greatest(F.coalesce(_int_of(_value_of(p["second"], r["k"])) - r["lo"], F.lit(1)), F.lit(1))
        per_page = F.when(step > 1, step).otherwise(F.greatest(F.floor(p["hint"] / p["n"]), F.lit(20)))
        pages = F.floor(p["hint"] / per_page) + 1
        return F.struct(
            r["k"].alias("k"), step.alias("step"), (r["hi"] + step).alias("start"), (r["lo"] + pages * step).alias("stop"),
            F.coalesce((p["n"] >= 2) & (p["hint"] > 0) & (pages > p["n"]), F.lit(False)).alias("grow"),
        )

    def extend(p: Column, g: Column) -> Column:
        # more pages than asked for are cut below, so the sequence needs no more than that
        stop = g["stop"] if max_pages is None else F.least(g["stop"], g["start"] + g["step"] * max_pages)
        more = F.transform(
            F.sequence(g["start"], stop, g["step"]), lambda v: _with_param(p["url"], p["last"], g["k"], v)
        )
        grow = F.coalesce(g["grow"] & (g["start"] <= g["stop"]), F.lit(False))
        return F.concat(p["urls"], F.when(grow, more).otherwise(F.array().cast("array<string>")))

    u = _c(urls)
    facts = F.struct(
        u.alias("urls"), F.size(u).alias("n"), _c(total_hint).cast("bigint").alias("hint"),
        F.get(u, F.size(u) - 1).alias("url"), _query_pairs(F.get(u, F.lit(0))).alias("first"),
        _query_pairs(F.get(u, F.lit(1))).alias("second"), _query_pairs(F.get(u, F.size(u) - 1)).alias("last"),
    )
    all_urls = let(facts, lambda p: let(rising(p), lambda r: let(paging(p, r), lambda g: extend(p, g))))
    return all_urls if max_pages is None else F.slice(all_urls, 1, max_pages)


def extrapolate_pages(links: Column | str, max_page: Column | str) -> Column:
    """array<struct<num, href>> sorted by num -> URLs of pages 1..max, or the distinct hrefs.

    Needs the same path in the first two links and one integer parameter that grows with
    the page number.
    """
    def changed(p: Column) -> Column:
        pairs = F.transform(p["p1"], lambda x: F.struct(
            x["k"].alias("k"), x["v"].alias("v"), _value_of(p["p2"], x["k"]).alias("w")
        ))
        return F.get(F.filter(pairs, lambda x: F.coalesce(
            (x["v"] != x["w"]) & _int_of(x["v"]).isNotNull() & _int_of(x["w"]).isNotNull(), F.lit(False)
        )), F.lit(0))

    def pages(p: Column, c: Column) -> Column:
        gap = p["l2"]["num"] - p["l1"]["num"]
        step = F.when(gap != 0, F.floor((_int_of(c["w"]) - _int_of(c["v"])) / gap))
        start = _int_of(c["v"]) - (p["l1"]["num"] - 1) * step
        made = F.transform(
            F.sequence(F.lit(1).cast("bigint"), p["top"]),
            lambda i: _with_param(p["l1"]["href"], p["p1"], c["k"], start + (i - 1) * step),
        )
        given = F.array_distinct(F.transform(p["links"], lambda x: x["href"]))
        return F.when(F.coalesce(p["same_path"] & (step > 0), F.lit(False)), made).otherwise(given)

    a = _c(links)
    l1, l2 = F.get(a, F.lit(0)), F.get(a, F.lit(1))
    facts = F.struct(
        a.alias("links"), l1.alias("l1"), l2.alias("l2"), _query_pairs(l1["href"]).alias("p1"),
        _query_pairs(l2["href"]).alias("p2"), (_part(l1["href"], 3) == _part(l2["href"], 3)).alias("same_path"),
        _c(max_page).cast("bigint").alias("top"),
    )
    return let(facts, lambda p: let(changed(p), lambda c: pages(p, c)))


# --- HTTP headers ------------------------------------------------------------------------


def parse_link_header(c: Column | str) -> Column:
    """Link header -> map rel -> url."""
    pattern = r'^\s*<([^>]+)>\s*;\s*rel="([^"]+)"'
    parts = F.filter(
        F.transform(F.split(_c(c), ","), trim_ws), lambda p: F.rlike(p, F.lit(pattern))
    )
    return map_from_entries_last(
        F.transform(
            parts,
            lambda p: F.struct(
                F.regexp_extract(p, pattern, 2).alias("key"), F.regexp_extract(p, pattern, 1).alias("value")
            ),
        )
    )


def response_facts(headers: Column | str) -> Column:
    """Typed facts of a response from its lower-case header map."""
    h = _c(headers)
    get = lambda k: F.element_at(h, F.lit(k))
    content_type = F.lower(trim_ws(F.substring_index(F.coalesce(get("content-type"), F.lit("")), ";", 1)))
    remaining = lambda k: _int_of(trim_ws(get(k)))
    return F.struct(
        content_type.alias("content_type"),
        F.contains(content_type, F.lit("json")).alias("is_json"),
        F.contains(content_type, F.lit("html")).alias("is_html"),
        get("etag").alias("etag"),
        get("last-modified").alias("last_modified"),
        trim_ws(get("retry-after")).try_cast("double").alias("retry_after"),
        F.coalesce(remaining("x-ratelimit-remaining"), remaining("x-rate-limit-remaining")).alias("rate_limit_remaining"),
    )
