"""Snippets of the SQL oracle dialect for rules shared by many queries."""

from __future__ import annotations

WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))"
WS_CLASS = r"[ \t\n\r\f\v\x{00a0}]"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    return f"CASE WHEN lower({trim(x)}) IN ('nan', 'none', 'n/a', 'null', '') THEN NULL ELSE {trim(x)} END"


def blank(x: str) -> str:
    return f"coalesce({trim(x)} = '', true)"


def norm(x: str) -> str:
    return f"coalesce(regexp_replace(lower({trim(x)}), '{WS_CLASS}+', ' ', 'g'), '')"


def key(x: str) -> str:
    return f"md5({norm(x)})"


def number(x: str) -> str:
    """Double or NULL; NaN is NULL."""
    v = f"TRY_CAST({trim(x)} AS DOUBLE)"
    return f"CASE WHEN isnan({v}) THEN NULL ELSE {v} END"


def integer(x: str) -> str:
    return f"TRY_CAST(trunc({number(x)}) AS BIGINT)"


def first(x: str, order: str) -> str:
    """First non-null value in order."""
    return f"arg_min({x}, {order}) FILTER (WHERE {x} IS NOT NULL)"


def last(x: str, order: str) -> str:
    return f"arg_max({x}, {order}) FILTER (WHERE {x} IS NOT NULL)"


def head(x: str, order: str) -> str:
    """Value of the first row, NULL included."""
    return f"arg_min_null({x}, {order})"


def clean_text(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("\\u002F", "/")):
        t = f"replace({t}, '{old}', '{new}')"
    return f"coalesce(trim(regexp_replace({t}, '{WS_CLASS}+', ' ', 'g')), '')"


def any_of(x: str, words: list[str]) -> str:
    quoted = [w.replace("'", "''") for w in words]
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in quoted) + ")"


def text_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
