"""Order-dependent building blocks that stay balanced when one key holds most rows.

Running values are computed in two levels. The rows are cut into chunks along the
order column; a window runs inside (keys, chunk), a second tiny window runs over one
summary row per (keys, chunk), and the two are joined on the same partitioning. A
hot key is thus spread over as many tasks as there are chunks. Data that fits into
one chunk uses the plain window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_CHUNK = 2_000_000
SIZE_UNITS = 1_000_000
QUANTILES = 512
# A key's rows are first limited in so many parts, so that a hot key is not sorted in one task.
LIMIT_PARTS = 64


def order_key(order_by: Sequence[str]) -> Column:
    """One comparable column for a multi-column arrival order."""
    return F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)


def first_value_by(value: Column, order: Column, where: Column | None = None) -> Column:
    """Aggregate: value of the earliest row (that satisfies `where`)."""
    return F.min_by(value, order if where is None else F.when(where, order))


def last_value_by(value: Column, order: Column, where: Column | None = None) -> Column:
    return F.max_by(value, order if where is None else F.when(where, order))


def first_non_null(name: str, order: Column) -> Column:
    return first_value_by(F.col(name), order, F.col(name).isNotNull()).alias(name)


def last_non_null(name: str, order: Column) -> Column:
    return last_value_by(F.col(name), order, F.col(name).isNotNull()).alias(name)


def keep_first(df: DataFrame, keys: Sequence[Column | str], order_by: Sequence[Column | str]) -> DataFrame:
    """First row per key; at most one row per key and map task is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


# --- chunks ------------------------------------------------------------------------------


def _search(col: Column, bounds: list, lo: int, hi: int) -> Column:
    """Balanced comparison tree: number of bounds below the value."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(col <= F.lit(bounds[mid]), _search(col, bounds, lo, mid)).otherwise(
        _search(col, bounds, mid + 1, hi)
    )


def _as_number(df: DataFrame, name: str, c: Column) -> Column:
    """Order-preserving number of a date, time or numeric value (independent of the session time zone)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        days = F.datediff(c, F.lit("1970-01-01").cast("date"))
        return days * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    return c.cast("double")


def with_chunks(df: DataFrame, order_col: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> tuple[DataFrame, int]:
    """Add `_chunk`, monotone in the order column; returns (df, number of chunks).

    The cut points are at most QUANTILES approximate quantiles of one column; where that is
    too coarse, each range is cut into parts of equal width. They are literals, so the result
    does not depend on how often or where the plan is re-evaluated.
    """
    if isinstance(df.schema[order_col].dataType, T.StringType):
        # texts are cut by their first bytes, read as a number
        first = F.conv(F.rpad(F.hex(F.substring(F.col(order_col).cast("binary"), 1, 6)), 12, "0"), 16, 10)
        out, chunks = with_chunks(df.withColumn("_text_number", first.cast("double")), "_text_number", rows_per_chunk)
        return out.drop("_text_number"), chunks
    c = F.col(order_col)
    grid = [i / QUANTILES for i in range(1, QUANTILES)]
    row = df.agg(
        F.count("*").alias("n"), F.percentile_approx(order_col, grid, 10_000).alias("q"),
        F.min(order_col).alias("lo"), F.max(order_col).alias("hi"),
    ).first()
    wanted = -(-row["n"] // rows_per_chunk)
    if wanted <= 1 or row["lo"] is None:
        return df.withColumn("_chunk", F.lit(0)), 1
    ranges = min(QUANTILES, wanted)
    bounds = sorted({row["q"][max(i * QUANTILES // ranges - 1, 0)] for i in range(1, ranges)})
    # NULL sorts first
    coarse = F.when(c.isNull(), F.lit(0)).otherwise(_search(c, bounds, 0, len(bounds)))
    parts = -(-wanted // ranges)
    out = df.withColumn("_chunk", coarse)
    if parts > 1:
        edges = F.array(*[_as_number(df, order_col, F.lit(v).cast(df.schema[order_col].dataType)) for v in [row["lo"], *bounds, row["hi"]]])
        lo, hi = F.get(edges, F.col("_chunk")), F.get(edges, F.col("_chunk") + 1)
        place = F.floor((_as_number(df, order_col, c) - lo) / F.nullif(hi - lo, F.lit(0.0)) * parts)
        inside = F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(parts - 1))
        out = out.withColumn("_chunk", (F.col("_chunk") * parts + inside).cast("int"))
    return out, (len(bounds) + 1) * parts


def _match(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be NULL."""
    right = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return a.join(right, cond, "left").drop(*[f"_r_{k}" for k in keys])


def with_streaks(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    counts: Column | None = None,
    position: str = "position",
    streak: str | None = "streak",
    rows_per_chunk: int = ROWS_PER_CHUNK,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Add the 1-based position per key and the length of the current run of `counts` rows.

    `counts` marks rows that lengthen the run; any other row resets it to zero. `carry` (keys, n, run) says how
    many rows of a key came before and how long the run was then: one row per key, for rows that go on later.
    """
    flag = F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))
    base, chunks = with_chunks(df.withColumn("_flag", flag), order_by[0], rows_per_chunk)
    # one struct key: NULL members compare equal, and window, summary and join share a partitioning
    base = base.withColumn("_k", F.struct(*keys, F.lit(0)))
    w = Window.partitionBy("_k", "_chunk").orderBy(*order_by)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = base.withColumn("_rn", F.row_number().over(w).cast("bigint")).withColumn(
        "_reset", F.max(F.when(~F.col("_flag"), F.col("_rn"))).over(running)
    )
    if chunks > 1 or carry is not None:
        before = Window.partitionBy("_k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        summary = rows.groupBy("_k", "_chunk").agg(F.count("*").alias("_n"), F.max("_reset").alias("_last_reset"))
        first, reset = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
        if carry is not None:  # joined to one row per key and chunk, never to the rows of a hot key
            told = carry.select(F.struct(*keys, F.lit(0)).alias("_k"), F.col("n").alias("_first"), (F.col("n") - F.col("run")).alias("_before"))
            summary = summary.join(told, "_k", "left")
            first, reset = F.coalesce("_first", F.lit(0)).cast("bigint"), F.col("_before").cast("bigint")
        summary = summary.withColumn("_offset", first + F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
            "_carried", F.coalesce(F.max(F.col("_offset") + F.col("_last_reset")).over(before), reset)
        ).select("_k", "_chunk", "_offset", "_carried")
        rows = rows.join(summary, ["_k", "_chunk"])
    else:
        rows = rows.withColumns({"_offset": F.lit(0), "_carried": F.lit(None).cast("bigint")})
    pos = F.col("_offset") + F.col("_rn")
    last_reset = F.coalesce(F.col("_offset") + F.col("_reset"), F.col("_carried"), F.lit(0))
    out = rows.withColumn(position, pos.cast("bigint"))
    if streak:
        out = out.withColumn(streak, (F.col(position) - last_reset).cast("bigint"))
    return out.select(*df.columns, position, *([streak] if streak else []))


def with_positions(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str = "position",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """1-based position per key in the given order."""
    return with_streaks(df, keys, order_by, None, name, None, rows_per_chunk)


# --- limits and batches ------------------------------------------------------------------


def limit_items(df: DataFrame, n: int, order_by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """First n rows in order, overall or per key."""
    if not keys:
        return df.orderBy(*order_by).limit(n)
    part = F.pmod(F.xxhash64(*order_by), F.lit(LIMIT_PARTS))
    for cut in ([*keys, part], list(keys)):
        w = Window.partitionBy(*cut).orderBy(*order_by)
        df = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return df


def fixed_batches(df: DataFrame, n: int, order_by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """0-based `batch` of n consecutive rows per key."""
    return with_positions(df, keys, order_by, "_pos").withColumn(
        "batch", F.floor((F.col("_pos") - 1) / F.lit(n)).cast("bigint")
    ).drop("_pos")


def _edges(sizes: pd.Series) -> np.ndarray:
    """Total size of the rows before each row, and of all."""
    return np.concatenate([[0], np.cumsum(sizes.to_numpy(dtype=np.int64))])


def _next_starts(edges: np.ndarray, ends: np.ndarray | int, budget: int) -> np.ndarray:
    """Where the batch after one that opens at row i would open, for every row i; `ends` bounds the rows of i's key."""
    rows = np.arange(len(edges) - 1)
    beyond = np.searchsorted(edges, edges[:-1] + budget, side="right") - 1
    return np.minimum(np.maximum(beyond, rows + 1), ends)


def _reached(starts: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Marks of all rows that jumps `after` reach from `starts`: jumps of 1, 2, 4, .. steps are composed, so that
    the passes grow with the logarithm of the rows."""
    n = len(after)
    marks, jump = np.zeros(n + 1, dtype=bool), np.append(after, n)
    marks[starts] = True
    while True:
        marks[jump[np.flatnonzero(marks)]] = True
        if (jump[:-1] == n).all():
            return marks[:n]
        jump = jump[jump]


def _numbered(frames: Iterator[pd.DataFrame], part: list[str], size_col: str, budget: int, names: list[str]) -> Iterator[pd.DataFrame]:
    """Batch numbers over rows sorted by part and order, each part starting from its entry (_used, _opened, _first);
    a part that goes on in the next frame hands its open batch over."""
    last, left, batch = None, 0, 0
    for pdf in frames:
        if pdf.empty:
            continue
        k, n = pdf[part], len(pdf)
        before = k.shift()
        changed = ((k != before) & ~(k.isna() & before.isna())).any(axis=1).to_numpy(copy=True)
        changed[0] = True
        starts = np.flatnonzero(changed)
        used, opened, first = (pdf[c].to_numpy()[starts].copy() for c in ("_used", "_opened", "_first"))
        if last == tuple(None if pd.isna(v) else v for v in k.iloc[0]):
            used[0], opened[0], first[0] = left, True, batch
        edges, ends = _edges(pdf[size_col]), np.append(starts[1:], n)
        of = np.cumsum(changed) - 1
        # the first row that does not fit into what is open on entry
        break_at = np.clip(np.searchsorted(edges, edges[starts] + budget - used, side="right") - 1, starts, ends)
        opens = np.where(opened.astype(bool), break_at, starts)
        # a part without a break of its own opens no batch; no jump crosses into the next part
        inside = opens[opens < ends]
        after = _next_starts(edges, ends[of], budget)
        crosses = after == ends[of]
        marks = _reached(inside, np.where(crosses, n, after))
        count = np.concatenate([[0], np.cumsum(marks)])
        numbers = count[1:] - count[starts][of] + np.where(opened.astype(bool), first, first - 1)[of]
        at = np.flatnonzero(marks[starts[-1] :])
        left = int(edges[n] - edges[starts[-1] + at[-1]]) if len(at) else int(used[-1] + edges[n] - edges[starts[-1]])
        last, batch = tuple(None if pd.isna(v) else v for v in k.iloc[-1]), int(numbers[-1])
        yield pdf[names].assign(batch=numbers.astype(np.int64))


def pack_batches(
    df: DataFrame, size_col: str, budget: int, order_by: Sequence[str], keys: Sequence[str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Greedy batches per key: a row opens a new 0-based `batch` when it does not fit the budget.

    Sizes are summed as whole millionths, so that fractions add up the same in any grouping; NULL
    and sizes below zero count as zero.

    A key with more rows than a chunk is cut into chunks: each reports how it would end for every distinct fill
    level of the batch it may receive, and a fold over its reports yields the true levels. All rows, of long and
    short keys, are then numbered the same way from the level on entry (nothing for a key's first chunk): where the
    next batch opens is one function of the row, whose compositions reach every opening row.
    """
    names = df.columns
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0))
    df = df.withColumn("_size", F.round(size * SIZE_UNITS).cast("bigint"))
    budget, part = round(budget * SIZE_UNITS), [*keys, "_chunk"]
    base, chunks = with_chunks(df, order_by[0], rows_per_chunk)
    entry = {"_used": F.lit(0).cast("bigint"), "_opened": F.lit(False), "_first": F.lit(0).cast("bigint")}
    if chunks > 1:
        # at most (rows / rows_per_chunk) keys can be this large
        large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_chunk)
        base = _match(base, large.withColumn("_large", F.lit(True)).drop("_n"), keys)
        base = base.withColumn("_chunk", F.when(F.col("_large"), F.col("_chunk")).otherwise(0).cast("int"))
        entries = _entries(base.filter("_large"), base.schema, budget, order_by, keys)
        base = _match(base, entries, part)
        entry = {c: F.coalesce(F.col(c), v) for c, v in entry.items()}
    schema = T.StructType([*[f for f in base.schema.fields if f.name in names], T.StructField("batch", T.LongType())])
    ordered = base.withColumns(entry).repartition(*part).sortWithinPartitions(*part, *order_by)
    order = schema.names[:-1]
    return ordered.mapInPandas(lambda it: _numbered(it, part, "_size", budget, order), schema).select(*names, "batch")


def _entries(base: DataFrame, schema: T.StructType, budget: int, order_by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """How full the open batch is (_used, _opened) and its number (_first) where each chunk of a long key begins."""
    part, size_col = [*keys, "_chunk"], "_size"

    key_fields = [schema[k] for k in keys]
    report_schema = T.StructType([
        *key_fields, T.StructField("_chunk", T.IntegerType()), T.StructField("total", T.LongType()),
        *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("fits", "opens", "left")],
    ])

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order_by), kind="stable")
        edges = _edges(pdf[size_col])
        n = len(pdf)
        # first rows that could open a batch in this chunk, all followed at once from batch to batch
        reach = min(max(int(np.searchsorted(edges, budget, side="right")) - 1, 0), n - 1)
        after = _next_starts(edges, n, budget)
        at = np.arange(reach + 1)
        fits, opens = edges[at + 1], np.ones(reach + 1, dtype=np.int64)
        while (more := after[at] < n).any():
            at = np.where(more, after[at], at)
            opens += more
        left = edges[n] - edges[at]
        head = {k: [pdf[k].iloc[0]] for k in part}
        return pd.DataFrame({**head, "total": [int(edges[n])], "fits": [fits], "opens": [opens], "left": [left]})

    entry_schema = T.StructType([
        *key_fields, T.StructField("_chunk", T.IntegerType()), T.StructField("_used", T.LongType()),
        T.StructField("_opened", T.BooleanType()), T.StructField("_first", T.LongType()),
    ])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        rows, used, batch, opened = [], 0, 0, False
        for r in pdf.itertuples(index=False):
            rows.append((used, opened, batch))
            fits = np.asarray(r.fits)
            at = int(np.searchsorted(fits, budget - used, side="right")) if opened else 0
            if at < len(fits):
                batch += int(r.opens[at]) if opened else int(r.opens[at]) - 1
                used = int(r.left[at])
            else:
                used += int(r.total)
            opened = True
        return pd.DataFrame({
            **{k: pdf[k].to_numpy() for k in part},
            "_used": [x[0] for x in rows], "_opened": [x[1] for x in rows], "_first": [x[2] for x in rows],
        })

    narrow = base.select(*dict.fromkeys([*part, *order_by, size_col]))
    reports = narrow.groupBy(*part).applyInPandas(report, report_schema)
    return reports.groupBy(*keys).applyInPandas(fold, entry_schema)


# --- running analytics -------------------------------------------------------------------


def zero_streak(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], items: str, **kw) -> DataFrame:
    """Running count of consecutive pages without items, reset by a page with items."""
    return with_streaks(df, keys, order_by, F.coalesce(F.col(items), F.lit(0)) == 0, "pages_processed", "zero_streak", **kw)


def switch_points(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], items: str,
    min_pages: int = 3, min_streak: int = 2, **kw,
) -> DataFrame:
    """First row per attempt where enough pages were seen and the empty run is long enough."""
    rows = zero_streak(df, keys, order_by, items, **kw).filter(
        (F.col("pages_processed") >= min_pages) & (F.col("zero_streak") >= min_streak)
    )
    return keep_first(rows, keys, order_by)


def breaker_windows(
    df: DataFrame, keys: Sequence[str], ts: str, order_by: Sequence[str], failed: Column,
    max_errors: int = 3, cooldown_s: int = 600, **kw,
) -> DataFrame:
    """Rows that (re)open the circuit breaker, with the end of the pause they cause."""
    rows = with_streaks(df, keys, order_by, failed, "_pos", "consecutive_errors", **kw).drop("_pos")
    opened = rows.filter(F.col("consecutive_errors") >= max_errors)
    return opened.withColumn("disabled_until", F.col(ts) + F.expr(f"INTERVAL {cooldown_s} SECONDS"))


def best_candidate(df: DataFrame, job: str, method: str, score: Column, order_by: Sequence[str]) -> DataFrame:
    """Best method per job, its score and the margin over the second (earlier wins ties)."""
    w = Window.partitionBy(job).orderBy(F.desc("_score"), *order_by)
    top = df.withColumn("_score", score).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
    best = F.max(F.when(F.col("_rn") == 1, F.col("_score")))
    second = F.coalesce(F.max(F.when(F.col("_rn") == 2, F.col("_score"))), F.lit(0.0))
    return top.groupBy(job).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(method))).alias("best_method"),
        best.alias("best_score"),
        F.greatest(best - second, F.lit(0.0)).alias("margin"),
    )


def latest_two(reports: DataFrame, name: str) -> DataFrame:
    """Newest and previous report by name, ranked 1 and 2."""
    two = reports.orderBy(F.desc(name)).limit(2)
    return two.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(name))).cast("bigint"))


def status_timeline(events: DataFrame, ts: Column, status: str, reason: str) -> DataFrame:
    """One timeline line per status event; the order column of the input is kept for sorting."""
    base = F.concat(ts, F.lit(" status="), F.col(status))
    has_reason = F.coalesce(F.col(reason), F.lit("")) != ""
    return events.withColumn(
        "line", F.when(has_reason, F.concat(base, F.lit(" reason="), F.col(reason))).otherwise(base)
    )


def carry_forward_group(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], marker: Column, name: str,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
) -> DataFrame:
    """Each row gets the latest non-null marker at or before it.

    `rows_per_chunk=None` is for groups that are known to be short (lines of one document).
    """
    base, chunks = df.withColumn("_m", marker), 1
    if rows_per_chunk:
        base, chunks = with_chunks(base, order_by[0], rows_per_chunk)
    else:
        base = base.withColumn("_chunk", F.lit(0))
    base = base.withColumn("_k", F.struct(*keys, F.lit(0)))
    w = Window.partitionBy("_k", "_chunk").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = base.withColumn("_own", F.last("_m", ignorenulls=True).over(w))
    if chunks > 1:
        before = Window.partitionBy("_k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        tails = base.groupBy("_k", "_chunk").agg(
            F.max_by("_m", F.when(F.col("_m").isNotNull(), F.struct(*order_by))).alias("_tail")
        )
        carried = tails.withColumn("_carried", F.last("_tail", ignorenulls=True).over(before)).drop("_tail")
        rows = rows.join(carried, ["_k", "_chunk"]).withColumn("_own", F.coalesce("_own", "_carried"))
    return rows.withColumn(name, F.col("_own")).select(*df.columns, name)
