"""Scalar text, number and date functions (Column -> Column, all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# One whitespace class used everywhere (ASCII space characters + U+00A0).
WS = " \t\n\r\f\u000b\u00a0"
WS_RE = "[ \\t\\n\\r\\f\\x0B\\u00a0]"

# Tokens that count as missing.
NULL_TOKENS = ["nan", "none", "n/a", "null", ""]
JSON_NULL_TOKENS = ["nan", "none", ""]

# E-mail fragments that mark system addresses.
EMAIL_EXCLUDES = [
    "sentry.io", "analytics", "tracking", "monitoring",
    "noreply", "no-reply", "donotreply", "placeholder", "example.com",
]
EMAIL_RE = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# Label-prefixed phone and fax numbers.
PHONE_RE = r"(?i)(?:Phone|Tel|Telefon)[:\s]*([+\d\s\-/()]+)"
FAX_RE = r"(?i)Fax[:\s]*([+\d\s\-/()]+)"

# Labelled identifiers in imprint texts.
KVK_RE = r"(?i)(?:KvK|Kamer van Koophandel|Chamber of Commerce|Handelsregister)[:\s]*([A-Z0-9-]+)"
VAT_RE = r"(?i)(?:BTW|VAT|USt-IdNr|Umsatzsteuer)[:\s-]*([A-Z]{2}[A-Z0-9]+)"
RATING_RE = (
    r"Beoordeling:\s*([\d.]+)\s*van de\s*([\d.]+)\s*sterren op basis van\s*(\d+)\s*recensies"
)
SIZE_RE = r"(\d[\d,\.]*)\s*(?:\+\s*)?(?:employees|staff|people|workforce)"

# Social hosts that are not company websites.
SOCIAL_DOMAINS = [
    "tiktok.com", "instagram.com", "youtube.com", "facebook.com",
    "twitter.com", "x.com", "linkedin.com", "pinterest.com",
]

# Entities in the order they are decoded.
ENTITIES = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("\u00a0", " "),
]
TEXT_ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Strip the library's whitespace class from both ends."""
    return F.btrim(_c(c), F.lit(WS))


def collapse_ws(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), WS_RE + "+", " ")


def _replace_all(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def is_blank(c: Column | str) -> Column:
    """NULL or whitespace only."""
    return F.coalesce(trim_ws(c) == "", F.lit(True))


def nullif_blank(c: Column | str) -> Column:
    return F.when(~is_blank(c), _c(c))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """True when the text contains one of the words (one pass per word, no regex)."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit


# --- null handling and casts -------------------------------------------------------------


def clean_str(c: Column | str) -> Column:
    t = trim_ws(c)
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


def clean_float(c: Column | str) -> Column:
    """Double, NULL when unparsable or NaN; infinities stay. Java-only suffixes are refused."""
    t = trim_ws(_c(c).cast("string"))
    number = F.when(~F.rlike(t, F.lit(r"(?i)[0-9.][df]$|0x")), t.try_cast("double"))
    return F.when(~F.isnan(number), number)


def clean_int(c: Column | str) -> Column:
    """Integer part of `clean_float`, toward zero; infinities become NULL."""
    return clean_float(c).try_cast("bigint")


def normalize_name(c: Column | str) -> Column:
    """Match key of a company name: trimmed, lower case, single spaces; punctuation stays."""
    return F.coalesce(collapse_ws(F.lower(trim_ws(c))), F.lit(""))


def company_key(c: Column | str) -> Column:
    """Deterministic surrogate key of a company."""
    return F.md5(normalize_name(c))


def to_json_text(c: Column | str, complex_type: bool = False) -> Column:
    """JSON text of a nested value; plain strings are trimmed and null-like ones dropped."""
    if complex_type:
        return F.to_json(_c(c))
    t = trim_ws(c)
    return F.when(~F.lower(t).isin(*JSON_NULL_TOKENS), t)


def clamp01(c: Column | str) -> Column:
    return F.least(F.greatest(_c(c), F.lit(0.0)), F.lit(1.0))


# --- markup and entities -----------------------------------------------------------------


def decode_entities(c: Column | str) -> Column:
    return _replace_all(_c(c), ENTITIES)


def clean_text(c: Column | str) -> Column:
    """Tags off, entities decoded, escaped slashes restored, whitespace collapsed; NULL becomes ''."""
    t = _replace_all(F.regexp_replace(_c(c), "<[^>]+>", ""), TEXT_ENTITIES)
    t = F.replace(t, F.lit("\\u002F"), F.lit("/"))
    return F.coalesce(F.trim(collapse_ws(t)), F.lit(""))


def strip_tags_keep_lines(c: Column | str) -> Column:
    """Drop script and style bodies; block ends become line breaks, other tags become spaces."""
    t = F.regexp_replace(_c(c), r"(?is)<script\b[^>]*>.*?</script>", "\n")
    t = F.regexp_replace(t, r"(?is)<style\b[^>]*>.*?</style>", "\n")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(?:p|div|li|tr|td|th|section|article|h\d|dd|dt)>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"\n[ \t]+", "\n")
    return F.regexp_replace(t, r"[ \t]+\n", "\n")


# --- contact data ------------------------------------------------------------------------


def extract_emails(c: Column | str, excludes: Sequence[str] = ()) -> Column:
    """All e-mail addresses of a text, minus those containing an excluded fragment."""
    banned = [*EMAIL_EXCLUDES, *excludes]
    text = _c(c)
    found = F.filter(
        F.regexp_extract_all(text, F.lit(EMAIL_RE), F.lit(0)),
        lambda e: ~contains_any(F.lower(e), [b.lower() for b in banned]),
    )
    # an address needs an @: skip the regex where there is none
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast("array<string>"))


def first_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First regex group, trimmed; NULL when the pattern does not match."""
    return F.when(F.rlike(_c(c), F.lit(pattern)), trim_ws(F.regexp_extract(_c(c), pattern, group)))


def extract_phone(c: Column | str) -> Column:
    return first_match(c, PHONE_RE)


def extract_fax(c: Column | str) -> Column:
    return first_match(c, FAX_RE)


def looks_like_vat(c: Column | str) -> Column:
    t = F.coalesce(trim_ws(c), F.lit(""))
    return F.rlike(t, F.lit(r"(?i)^(?:[A-Z]{2}\s*)?[A-Z0-9 -]{8,20}$")) & F.rlike(t, F.lit(r"\d{8,}"))


def parse_imprint(c: Column | str) -> Column:
    """struct(kvk, vat, text) from labelled numbers in an imprint."""
    t = clean_text(c)
    return F.struct(
        first_match(t, KVK_RE).alias("kvk"),
        first_match(t, VAT_RE).alias("vat"),
        F.when(t != "", t).alias("text"),
    )


def parse_rating(c: Column | str, fallback_rating: Column | None = None, fallback_count: Column | None = None) -> Column:
    """struct(rating, out_of, count) from the rating label, else from the given values out of 5."""
    text = _c(c)
    hit = F.rlike(text, F.lit(RATING_RE))
    part = lambda i: F.regexp_extract(text, RATING_RE, i)
    rating = F.lit(None).cast("double") if fallback_rating is None else fallback_rating.cast("double")
    count = F.lit(None).cast("bigint") if fallback_count is None else fallback_count.cast("bigint")
    has_fallback = F.lit(fallback_rating is not None)
    return F.struct(
        F.when(hit, part(1).try_cast("double")).otherwise(rating).alias("rating"),
        F.when(hit, part(2).try_cast("double")).when(has_fallback, F.lit(5.0)).alias("out_of"),
        F.when(hit, part(3).try_cast("bigint")).otherwise(count).alias("count"),
    )


def _postal_city(c: Column) -> tuple[Column, Column]:
    """First token is the postal code and the rest the city; a single token is the city."""
    t = trim_ws(c)
    two = F.rlike(t, F.lit(r"^\S+\s+.+$"))
    postal = F.when(two, F.regexp_extract(t, r"^(\S+)\s+(.+)$", 1))
    city = F.when(two, trim_ws(F.regexp_extract(t, r"^(\S+)\s+(.+)$", 2))).otherwise(t)
    return postal, city


def split_address_line(c: Column | str) -> Column:
    """'12345 City, COUNTRY' -> struct(postal_code, city, country)."""
    line = _c(c)
    has_comma = F.contains(line, F.lit(","))
    head = F.when(has_comma, F.regexp_extract(line, r"(?s)^(.*),", 1)).otherwise(line)
    postal, city = _postal_city(head)
    return F.struct(
        postal.alias("postal_code"),
        city.alias("city"),
        F.when(has_comma, trim_ws(F.substring_index(line, ",", -1))).alias("country"),
    )


def address_block(lines: Column | str) -> Column:
    """Array of lines -> struct(street, postal_code, city, country); contact lines are skipped."""
    kept = F.filter(
        F.transform(_c(lines), trim_ws),
        lambda x: (x != "") & ~F.rlike(x, F.lit(r"(?i)^(?:Phone|Tel|Fax|Web|E-?mail|http)")),
    )
    second = split_address_line(F.get(kept, F.lit(1)))
    return F.struct(
        F.get(kept, F.lit(0)).alias("street"),
        second["postal_code"].alias("postal_code"),
        second["city"].alias("city"),
        F.coalesce(second["country"], F.get(kept, F.lit(2))).alias("country"),
    )


def join_nonempty(cols: Sequence[Column | str], sep: str = ", ") -> Column:
    """Non-empty parts, trimmed and joined."""
    parts = F.filter(F.array(*[_c(c) for c in cols]), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.transform(parts, trim_ws), sep)


def first_nonplaceholder(a: Sequence[Column], b: Sequence[Column], placeholder: str = "TBC") -> Column:
    """Array of parts `a`, unless all its non-empty parts are the placeholder: then `b`."""
    filled = F.filter(
        F.transform(F.array(*a), lambda x: F.upper(trim_ws(F.coalesce(x, F.lit(""))))), lambda x: x != ""
    )
    return F.when(F.forall(filled, lambda x: x == placeholder), F.array(*b)).otherwise(F.array(*a))


# --- small string tools ------------------------------------------------------------------


def slugify(c: Column | str, max_len: int = 60) -> Column:
    t = F.regexp_replace(F.lower(_c(c)), r"(?U)[^\w\s-]", "")
    t = F.btrim(F.regexp_replace(t, r"(?U)[\s_]+", "-"), F.lit("-"))
    t = F.left(t, F.lit(max_len))
    return F.when(t == "", F.lit("untitled")).otherwise(t)


def truncate_text(c: Column | str, n: int = 1500) -> Column:
    return F.left(_c(c), F.lit(n))


def truncate_list(c: Column | str, n: int = 20) -> Column:
    return F.slice(_c(c), 1, n)


def split_list(c: Column | str, sep: str = ";") -> Column:
    """Separated text -> trimmed parts; null-like text -> empty array."""
    t = clean_str(c)
    return F.coalesce(F.transform(F.split(t, F.lit(sep)), trim_ws), F.array().cast("array<string>"))


def label_fields_to_text(m: Column | str) -> Column:
    """Map -> 'key: value' lines, empty values skipped."""
    kept = F.filter(F.map_entries(_c(m)), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def org_size(c: Column | str) -> Column:
    """Company size class from a head count named in a text."""
    digits = F.translate(F.regexp_extract(F.lower(_c(c)), SIZE_RE, 1), ",.", "")
    n = digits.try_cast("decimal(38,0)")
    return F.when(n >= 5000, "Enterprise").when(n >= 200, "Mid-Market").otherwise("")


def age_hours(ts: Column | str, now: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(ts), _c(now)) / F.lit(3_600_000_000.0)


def token_cost(in_tokens: Column | str, out_tokens: Column | str, in_rate: float, out_rate: float) -> Column:
    """Price in USD from token counts and prices per million tokens."""
    cost = _c(in_tokens) / F.lit(1e6) * F.lit(in_rate) + _c(out_tokens) / F.lit(1e6) * F.lit(out_rate)
    return F.round(cost, 6)


def ensure_scheme(c: Column | str) -> Column:
    u = _c(c)
    return F.when(F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://")), u).otherwise(
        F.concat(F.lit("https://"), u)
    )


def split_hall_booth(c: Column | str) -> Column:
    """'Hall 10 / E40' or 'Hall 5, Stand A20' -> struct(hall, booth)."""
    pattern = r"(?i)hall\s*([^\s,/]+)\s*(?:[/,]\s*(?:(?:stand|booth)\s*)?(\S+))?"
    t = _c(c)
    part = lambda i: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
    return F.struct(part(1).alias("hall"), part(2).alias("booth"))


def split_city_country(c: Column | str) -> Column:
    """'Berlin, Germany' -> struct(city, country) at the last comma; no comma -> city only."""
    t = _c(c)
    has_comma = F.contains(t, F.lit(","))
    return F.struct(
        trim_ws(F.when(has_comma, F.regexp_extract(t, r"(?s)^(.*),", 1)).otherwise(t)).alias("city"),
        F.when(has_comma, trim_ws(F.substring_index(t, ",", -1))).alias("country"),
    )


def drop_social_website(c: Column | str, domains: Sequence[str] = SOCIAL_DOMAINS) -> Column:
    """A website on a social network is not a company website: becomes ''."""
    return F.when(contains_any(F.lower(_c(c)), domains), F.lit("")).otherwise(_c(c))


def fixed_text(c: Column | str, digits: int) -> Column:
    """Fixed-point text of a non-negative double with up to three digits.

    Rounds the exact binary value, halves to even (built-in formatting rounds the shortest
    decimal form instead, which differs for values such as 0.245).
    """
    x = _c(c).cast("double")
    whole = F.floor(x).cast("bigint")
    fine = (x - F.floor(x)) * F.lit(float(2**53))
    bits = F.floor(fine).cast("bigint")
    # small values have binary digits below 2^-53
    below = (fine - F.floor(fine)) * F.lit(float(10**digits))
    scaled = bits * F.lit(10**digits) + F.floor(below).cast("bigint")
    down = F.shiftright(scaled, 53)
    rest = scaled - F.shiftleft(down, 53)
    half = F.lit(2**52)
    up = (rest > half) | ((rest == half) & ((below > F.floor(below)) | (down % 2 == 1)))
    n = whole * F.lit(10**digits) + down + up.cast("bigint")
    text = F.lpad((n % F.lit(10**digits)).cast("string"), digits, "0")
    return F.concat(F.floor(n / F.lit(10**digits)).cast("string"), F.lit("."), text)
