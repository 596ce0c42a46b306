"""Array, map and JSON functions (Column -> Column)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import (
    _c, clean_str, contains_any, is_blank, nullif_blank, truncate_text, trim_ws,
)

MAP_SS = "map<string,string>"

# API keys without business content, and free-text keys that are shortened.
API_SKIP_KEYS = [
    "lastModified", "createdAt", "updatedAt", "modifiedAt", "write", "_links", "_embedded", "__typename",
]
API_TEXT_KEYS = ["text", "description", "about", "bio", "summary"]

# Keys that usually hold the item list of a listing response.
LIST_KEYS = ["data", "results", "items", "records", "entries", "rows", "list", "objects", "content", "hits"]
WRAPPER_KEYS = [
    "data", "items", "results", "records", "list", "hits", "rows", "content", "response", "payload",
    "members", "companies", "organizations", "people", "vendors", "sellers", "exhibitors", "entries",
]

# Canonical lead fields and the flattened keys they may appear under.
FIELD_ALIASES = {
    "name": ["values.name", "company_name", "exhibitor_name"],
    "email": ["contact.email", "values.email", "email_address", "e_mail"],
    "phone": ["contact.phone", "contact.telephone", "telephone", "phone_number"],
    "website": ["website_url", "values.website", "contact.website", "company_website", "url"],
    "description": ["values.description", "profile.description", "summary", "about", "bio", "text"],
    "address": ["contact.address", "values.address", "street_address"],
    "city": ["address.city", "contact.city", "values.city"],
    "country": ["address.country", "contact.country", "values.country"],
    "postal_code": ["address.postal_code", "address.zip", "contact.postal_code", "values.postal_code"],
    "booth": ["values.booth", "stand", "stand_number"],
    "hall": ["values.hall", "hall_number"],
}

# Networks recognised in link lists.
SOCIAL_PLATFORMS = ["linkedin", "facebook", "instagram", "twitter", "youtube", "tiktok"]

# Hosts per network, and links that are no website.
SOCIAL_HOSTS = {
    "instagram": ["instagram.com"], "youtube": ["youtube.com"], "linkedin": ["linkedin.com"],
    "facebook": ["facebook.com"], "twitter": ["twitter.com", "x.com"],
}
NO_WEBSITE_MARKS = ["mailto:", "maps.app.goo", "tel:"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Expression over a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_from_entries_last(entries: Column) -> Column:
    """Map from (key, value) entries where a later entry replaces an earlier one.

    Keys keep the place of their last entry. Meant for short per-record lists.
    """
    def build(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["key"])
        later = lambda i: F.slice(keys, i + 2, F.greatest(F.size(es), F.lit(1)))
        return F.when(
            F.size(F.array_distinct(keys)) == F.size(es), F.map_from_entries(es)
        ).otherwise(F.map_from_entries(F.filter(es, lambda e, i: ~F.array_contains(later(i), e["key"]))))

    return let(entries, build)


def map_to_text(m: Column) -> Column:
    """'k=v|k=v' with sorted keys: a comparable print of a map."""
    rows = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("~"))))
    return F.array_join(F.array_sort(rows), "|")


# --- JSON walking ------------------------------------------------------------------------


def _is_json(value: Column, kind: str) -> Column:
    """True when a VARIANT holds an OBJECT or an ARRAY."""
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def object_entries(json_text: Column) -> Column:
    """array<struct<key, value, nested>> of one JSON object; `nested` marks object values."""
    def typed(entries: Column) -> Column:
        # the types are parsed only where a value looks like an object
        kinds = F.when(
            F.exists(entries, lambda e: F.startswith(e["value"], F.lit("{"))),
            F.from_json(json_text, "map<string,variant>"),
        )
        return let(kinds, lambda k: F.transform(
            entries,
            lambda e: F.struct(
                e["key"].alias("key"),
                e["value"].alias("value"),
                F.when(
                    F.startswith(e["value"], F.lit("{")), _is_json(F.element_at(k, e["key"]), "OBJECT")
                ).otherwise(F.lit(False)).alias("nested"),
            ),
        ))

    return let(F.map_entries(F.from_json(json_text, MAP_SS)), typed)


def flat_entries(json_text: Column, max_depth: int) -> Column:
    """array<struct<key, value, nested>> of all leaves in document order, dot-joined keys."""
    entries = object_entries(json_text)
    for _ in range(max_depth - 1):
        entries = F.flatten(
            F.transform(
                entries,
                lambda e: F.when(
                    e["nested"],
                    F.transform(
                        object_entries(e["value"]),
                        lambda x: F.struct(
                            F.concat(e["key"], F.lit("."), x["key"]).alias("key"),
                            x["value"].alias("value"),
                            x["nested"].alias("nested"),
                        ),
                    ),
                ).otherwise(F.array(e)),
            )
        )
    return entries


def flatten_json(c: Column | str, max_depth: int = 4) -> Column:
    """JSON object text -> map of dot-joined keys. Nulls stay, lists stay JSON text.

    Objects nested deeper than `max_depth` levels stay JSON text.
    """
    pairs = F.transform(
        flat_entries(_c(c), max_depth), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
    )
    return map_from_entries_last(pairs)


def array_objects(json_array: Column, only_objects: bool = True) -> Column:
    """Elements of a JSON array as JSON text, by default only the objects."""
    texts = F.from_json(json_array, "array<string>")
    if not only_objects:
        return texts
    return let(F.from_json(json_array, "array<variant>"), lambda typed: F.filter(
        texts, lambda x, i: F.startswith(x, F.lit("{")) & _is_json(F.get(typed, i), "OBJECT")
    ))


def json_path_items(c: Column | str, path: str | None) -> Column:
    """Object rows found at a dot path, as array<JSON text>: list elements, or one object, or none."""
    root = trim_ws(c)
    at = F.get_json_object(root, "$" + "".join(f"['{k}']" for k in path.split("."))) if path else root
    none = F.array().cast("array<string>")
    return (
        F.when(F.startswith(at, F.lit("[")), F.coalesce(array_objects(at), none))
        .when(F.startswith(at, F.lit("{")) & F.try_parse_json(at).isNotNull(), F.array(at))
        .otherwise(none)
    )


def _starts_with_object(arr: Column) -> Column:
    """True for a JSON array whose first element is an object."""
    return F.coalesce(F.startswith(F.get(F.from_json(arr, "array<string>"), F.lit(0)), F.lit("{")), F.lit(False))


def find_items_list(c: Column | str) -> Column:
    """struct(items array<JSON text>, path): where a JSON response keeps its item list.

    Order of choice: the root list, a usual list key, any key with three or more
    elements of which the first is an object, a usual list key one level deeper.
    """
    root = trim_ws(c)
    entries = F.map_entries(F.from_json(root, MAP_SS))
    found = lambda arr, path: F.struct(arr.alias("items"), path.alias("path"))
    nothing = F.struct(F.array().cast("array<string>").alias("items"), F.lit(None).cast("string").alias("path"))
    root_items = array_objects(root)
    choice = F.when(
        F.startswith(root, F.lit("[")),
        F.when(F.size(root_items) > 0, found(root_items, F.lit(None).cast("string"))).otherwise(nothing),
    )
    for key in LIST_KEYS:
        at = F.get_json_object(root, f"$['{key}']")
        choice = choice.when(
            F.startswith(at, F.lit("[")) & _starts_with_object(at), found(array_objects(at, False), F.lit(key))
        )
    lists = F.filter(
        entries,
        lambda e: F.startswith(e["value"], F.lit("["))
        & (F.size(F.from_json(e["value"], "array<string>")) >= 3)
        & _starts_with_object(e["value"]),
    )
    choice = choice.when(
        F.size(lists) > 0,
        found(array_objects(F.get(lists, F.lit(0))["value"], False), F.get(lists, F.lit(0))["key"]),
    )
    deeper = F.flatten(
        F.transform(
            F.filter(entries, lambda e: F.startswith(e["value"], F.lit("{"))),
            lambda e: F.filter(
                F.array(*[
                    F.struct(
                        F.concat(e["key"], F.lit("." + key)).alias("key"),
                        F.get_json_object(e["value"], f"$['{key}']").alias("value"),
                    )
                    for key in LIST_KEYS
                ]),
                lambda x: F.coalesce(F.startswith(x["value"], F.lit("[")), F.lit(False)) & _starts_with_object(x["value"]),
            ),
        )
    )
    choice = choice.when(
        F.size(deeper) > 0,
        found(array_objects(F.get(deeper, F.lit(0))["value"], False), F.get(deeper, F.lit(0))["key"]),
    )
    return choice.otherwise(nothing)


def unwrap_api_items(c: Column | str) -> Column:
    """Items of an API body: the root list, else the first wrapper list, else the object itself."""
    root = trim_ws(c)
    choice = F.when(F.startswith(root, F.lit("[")), array_objects(root, False))
    for key in WRAPPER_KEYS:
        at = F.get_json_object(root, f"$['{key}']")
        items = F.from_json(at, "array<string>")
        choice = choice.when(F.startswith(at, F.lit("[")) & (F.size(items) > 0), items)
        # an empty list under the first present key ends the search: the object is the item
        choice = choice.when(F.startswith(at, F.lit("[")), F.array(root))
    return choice.when(F.startswith(root, F.lit("{")), F.array(root)).otherwise(F.array().cast("array<string>"))


# --- maps of one record ------------------------------------------------------------------


def compact_api(m: Column | str, max_text: int | None = None, max_list: int | None = None) -> Column:
    """Detail API fields without metadata keys; longer texts and lists are shortened where a limit is given."""
    kept = F.map_filter(_c(m), lambda k, v: ~k.isin(*API_SKIP_KEYS))
    as_list = lambda v: F.from_json(v, "array<variant>")


    def shortened(k: Column, v: Column) -> Column:
        text = v if max_text is None else F.when(k.isin(*API_TEXT_KEYS) & ~F.rlike(v, F.lit(r"^[\[{]")), truncate_text(v, max_text)).otherwise(v)
        if max_list is None:
            return text
        long = F.startswith(v, F.lit("[")) & (F.size(as_list(v)) > max_list)
        return F.when(long, F.to_json(F.slice(as_list(v), 1, max_list))).otherwise(text)

    return F.transform_values(kept, shortened)


def promote_aliases(m: Column | str, aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES) -> Column:
    """Fill blank canonical fields from the first non-blank alias (case-insensitive keys)."""
    def lower_keys(src: Column) -> Column:
        return map_from_entries_last(F.transform(
            F.map_entries(src), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
        ))

    def promoted(src: Column, low: Column) -> Column:
        cells = [
            F.struct(
                F.lit(field).alias("key"),
                F.when(
                    is_blank(F.element_at(src, F.lit(field))),
                    F.coalesce(*[nullif_blank(F.element_at(low, F.lit(a.lower()))) for a in names]),
                ).alias("value"),
            )
            for field, names in aliases.items()
        ]
        return F.map_from_entries(F.filter(F.array(*cells), lambda e: e["value"].isNotNull()))

    def merged(src: Column, added: Column) -> Column:
        return F.map_concat(F.map_filter(src, lambda k, v: ~F.map_contains_key(added, k)), added)

    return let(_c(m), lambda src: let(lower_keys(src), lambda low: let(
        promoted(src, low), lambda added: merged(src, added)
    )))


def extract_prefixed(m: Column | str, prefix: str) -> Column:
    """Entries under a key prefix, prefix removed, null-like values dropped, values trimmed."""
    kept = F.map_filter(
        _c(m),
        lambda k, v: F.startswith(k, F.lit(prefix)) & v.isNotNull() & ~F.lower(trim_ws(v)).isin("nan", "none", ""),
    )
    cut = F.transform_keys(kept, lambda k, v: F.substr(k, F.lit(len(prefix) + 1)))
    return F.transform_values(cut, lambda k, v: trim_ws(v))


def _label(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")
    return trim_ws(F.regexp_replace(t, r"[:\-]+$", ""))


def find_by_labels(m: Column | str, labels: Sequence[str]) -> Column:
    """Value of the first label that equals a key, else that is contained in a key, else ''."""
    plain = [" ".join(x.lower().split()).rstrip(":-").strip() for x in labels]

    def first(entries: Column, test: Callable[[Column], Column]) -> Column:
        return F.nullif(F.get(F.filter(entries, lambda e: test(e["k"])), F.lit(0))["v"], F.lit(""))

    def equals(entries: Column, label: str) -> Column:
        return first(entries, lambda k: k == F.lit(label))

    def inside(entries: Column, label: str) -> Column:
        return first(entries, lambda k: F.contains(k, F.lit(label)))

    named = F.transform(F.map_entries(_c(m)), lambda e: F.struct(_label(e["key"]).alias("k"), e["value"].alias("v")))
    return let(named, lambda es: F.coalesce(
        *[equals(es, p) for p in plain], *[inside(es, p) for p in plain], F.lit("")
    ))


def coerce_collections(df: DataFrame) -> DataFrame:
    """NULL list and map fields of leads become empty ones."""
    empty = {
        "product_categories": F.array().cast("array<string>"),
        "brands": F.array().cast("array<string>"),
        "social_media": F.create_map().cast(MAP_SS),
        "raw_extra": F.create_map().cast(MAP_SS),
    }
    return df.withColumns({n: F.coalesce(F.col(n), e) for n, e in empty.items() if n in df.columns})


def sanitize_item(c: Column | str) -> Column:
    """JSON object text -> map of strings (complex values as JSON text); empty objects -> NULL."""
    m = F.from_json(_c(c), MAP_SS)
    return F.when(F.cardinality(m) > 0, m)


def pivot_first_n(arr: Column | str, fields: Sequence[str], prefix: str, n: int = 3) -> dict[str, Column]:
    """First n structs of an array as columns `<prefix>_<i>_<field>`."""
    return {
        f"{prefix}_{i + 1}_{f}": F.get(_c(arr), F.lit(i))[f] for i in range(n) for f in fields
    }


def phone_columns(arr: Column | str, n: int = 3) -> dict[str, Column]:
    """First n phones of an array<JSON text>: objects give number and label, scalars the number."""
    out: dict[str, Column] = {}
    for i in range(n):
        x = F.get(_c(arr), F.lit(i))
        is_obj = F.startswith(x, F.lit("{"))
        out[f"phone_{i + 1}"] = F.when(
            is_obj, F.coalesce(F.get_json_object(x, "$.number"), F.lit(""))
        ).otherwise(x)
        out[f"phone_{i + 1}_label"] = F.when(is_obj, F.coalesce(F.get_json_object(x, "$.label"), F.lit("")))
    return out


def social_links_map(arr: Column | str) -> Column:
    """array<struct<platform, label, url>> -> map network -> url; unnamed links by their host."""
    def entry(link: Column) -> Column:
        named = F.lower(F.coalesce(F.nullif(link["platform"], F.lit("")), link["label"], F.lit("")))
        by_url = F.coalesce(*[
            F.when(F.contains(F.lower(link["url"]), F.lit(p)), F.lit(p)) for p in SOCIAL_PLATFORMS
        ])
        return F.struct(F.coalesce(F.nullif(named, F.lit("")), by_url).alias("key"), link["url"].alias("value"))

    return map_from_entries_last(F.filter(F.transform(_c(arr), entry), lambda e: e["key"].isNotNull()))


def route_social_hosts(urls: Column | str, own_host: str, external: Column | None = None) -> Column:
    """array<url> -> map of network or 'website' by host; the organiser's own links are skipped.

    Without a website among the links the first usable `external` link serves as one.
    """
    def entry(u: Column) -> Column:
        network = [F.when(F.contains(u, F.lit(h)), F.lit(k)) for k, hs in SOCIAL_HOSTS.items() for h in hs]
        other = F.when(~F.contains(u, F.lit(own_host)) & ~F.contains(u, F.lit("mailto:")), F.lit("website"))
        return F.struct(F.coalesce(*network, other).alias("key"), u.alias("value"))

    found = map_from_entries_last(F.filter(F.transform(_c(urls), entry), lambda e: e["key"].isNotNull()))
    if external is None:
        return found
    banned = [own_host, *[h for hs in SOCIAL_HOSTS.values() for h in hs], *NO_WEBSITE_MARKS]
    spare = F.get(F.filter(external, lambda u: F.startswith(u, F.lit("http")) & ~contains_any(u, banned)), F.lit(0))
    return let(found, lambda m: F.when(
        F.map_contains_key(m, "website") | spare.isNull(), m
    ).otherwise(F.map_concat(m, F.create_map(F.lit("website"), spare))))


def pick_first_where(arr: Column | str, pred: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(_c(arr), pred), F.lit(0))


def collect_names(arr: Column | str, sep: str = "; ") -> Column:
    """array<JSON text> of objects or scalars -> names joined."""
    return F.array_join(
        F.transform(
            _c(arr),
            lambda x: F.when(
                F.startswith(x, F.lit("{")), F.coalesce(F.get_json_object(x, "$.name"), F.lit(""))
            ).otherwise(x),
        ),
        sep,
    )


def distinct_join(arr: Column | str, sep: str = "; ") -> Column:
    """Distinct elements in order of appearance, joined."""
    return F.array_join(F.array_distinct(_c(arr)), sep)


def select_nonempty(m: Column | str, keys: Sequence[str]) -> Column:
    """Listed keys with usable values; NULL when none is left."""
    kept = F.map_filter(_c(m), lambda k, v: k.isin(*keys) & clean_str(v).isNotNull())
    return F.when(F.cardinality(kept) > 0, kept)


def drop_internal_fields(m: Column | str) -> Column:
    """Entries whose key starts with an underscore are internal and removed."""
    return F.map_filter(_c(m), lambda k, v: ~F.startswith(k, F.lit("_")))

