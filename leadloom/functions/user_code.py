"""User-supplied parsers and extractors as table jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAP = T.MapType(T.StringType(), T.StringType())


def _text(value: Any) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (list, dict)) else str(value)


def run_adapter(
    raw: DataFrame, parse: Callable[[str, Any, str], dict], is_empty: Callable[[dict], bool],
    key: str = "seller_id", body: str = "raw", url: str = "url",
) -> DataFrame:
    """(key, status, error, result): user parse over raw responses; a failing row is tagged, not fatal."""
    schema = T.StructType([
        raw.schema[key], T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("result", MAP),
    ])

    def one(k: Any, text: str, link: str) -> tuple:
        try:
            parsed = parse(text, k, link)
            if is_empty(parsed):
                return "empty", None, None
            return "ok", None, {n: _text(v) for n, v in parsed.items()}
        except Exception as exc:
            return "error", str(exc), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = [one(*row) for row in zip(pdf[key], pdf[body], pdf[url])]
            yield pd.DataFrame({
                key: pdf[key], "status": [d[0] for d in done], "error": [d[1] for d in done], "result": [d[2] for d in done],
            })

    return raw.select(key, body, url).mapInPandas(run, schema)


def run_extractor(pages: DataFrame, extract: Callable[[str], list[dict]], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, item_idx, item): items of a user function html -> list of dicts; bad output gives no rows."""
    schema = T.StructType([pages.schema[key], T.StructField("item_idx", T.LongType()), T.StructField("item", MAP)])

    def items(text: str) -> Sequence[dict]:
        try:
            found = extract(text)
        except Exception:
            return []
        if not isinstance(found, list):
            return []
        clean = [{str(k): _text(v) for k, v in x.items()} for x in found if isinstance(x, dict)]
        return [x for x in clean if x]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, i, item) for k, text in zip(pdf[key], pdf[html]) for i, item in enumerate(items(text))]
            yield pd.DataFrame(rows, columns=schema.names)

    return pages.select(key, html).mapInPandas(run, schema)
