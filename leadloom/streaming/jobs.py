"""Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leadloom.functions.text import normalize_name, trim_ws
from leadloom.operators.dedup import lead_key
from leadloom.operators.filters import actionable_requests
from leadloom.operators.merge import EXHIBITOR_LAST, SELLER_FIRST, SELLER_LAST, absorb_yearless
from leadloom.operators.ordered import keep_first, order_key, with_streaks
from leadloom.operators.quality import job_counters
from leadloom.schemas import COMPANY_ATTRIBUTES, REQUEST_COLUMNS, TABLES
from leadloom.streaming.store import DeltaStore, Fold, compact

#: A table with more parts than this is folded to one after a batch.
MOST_PARTS = 24


def stream_requests(spark: SparkSession, folder: str) -> DataFrame:
    """New requests as they appear in the inbox folder."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in REQUEST_COLUMNS])
    return actionable_requests(spark.readStream.schema(schema).option("header", True).csv(folder))


def stream_dedup_leads(leads: DataFrame, event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """Each lead once. With a horizon the keys are forgotten after it, so the state stays bounded;
    a duplicate later than that passes again."""
    k1, k2 = lead_key()
    keyed = leads.select("*", k1, k2)
    if horizon is None:
        return keyed.dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")
    return keyed.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["_k1", "_k2"]).drop("_k1", "_k2")


# --- master tables -----------------------------------------------------------------------


def master_fold(table: str, columns: Sequence[str] = ()) -> Fold:
    """The rule of a master table for rows with `columns` (all of the rule where none are given)."""
    has = lambda names: [c for c in names if not columns or c in columns]
    return {
        "companies": Fold(["name_normalized"], first=["name", "created_at"], first_filled=has(COMPANY_ATTRIBUTES), last=["updated_at"], sources={"created_at": "_seen", "updated_at": "_seen"}),
        "company_socials": Fold(["company_id", "platform"], last=["url"]),
        "events": Fold(["name_normalized", "year"], first=["name", "city", "country", "website"]),
        "event_exhibitors": Fold(["company_id", "event_id"], last_filled=has(EXHIBITOR_LAST)),
        "marketplace_sellers": Fold(["company_id", "marketplace_id"], first=has(SELLER_FIRST), last_filled=has(SELLER_LAST)),
    }[table]


def _folded_rows(table: str, rows: DataFrame, order_by: Sequence[str], seen_at: str | None) -> DataFrame:
    order = order_key(order_by)
    fold = master_fold(table, rows.columns)
    if table == "companies":
        named = rows.withColumns({"name_normalized": normalize_name("name"), "_seen": F.col(seen_at)}).filter(F.col("name_normalized") != "")
        # a mention without any attribute does not touch the company
        touched = F.coalesce(*[F.col(a).cast("string") for a in fold.first_filled]).isNotNull() if fold.first_filled else F.lit(False)
        return fold.rows(named, order, {"updated_at": touched})
    if table == "events":
        return fold.rows(rows.withColumn("name_normalized", normalize_name("name")), order)
    if table == "company_socials":
        usable = rows.withColumns({"platform": F.lower(trim_ws("platform")), "url": trim_ws("url")}).filter(~F.lower("url").isin("nan", "none", ""))
        return fold.rows(usable, order)
    return fold.rows(rows, order)


def stream_master(
    rows: DataFrame, path: str, checkpoint: str, order_by: Sequence[str], tables: Mapping[str, Callable[[DataFrame], DataFrame]], seen_at: str | None = None,
) -> StreamingQuery:
    """Keep master tables up to date from a stream of rows; `tables` gives the mentions of each table in a batch.

    Every batch is folded to one row per key and added to all tables in one version; a winner keeps its order, so
    that batches may come in any order. A replayed batch adds nothing.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        target = DeltaStore(batch.sparkSession, path)
        if batch_id <= target.version()[1]:
            return
        if len(tables) > 1:
            batch.persist()
        try:
            target.commit(batch_id, {name: _folded_rows(name, build(batch), order_by, seen_at) for name, build in tables.items()})
        finally:
            batch.unpersist()
        compact(target, {name: _stored_fold(target, name) for name in tables}, MOST_PARTS)

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored_fold(store: DeltaStore, table: str) -> Fold:
    return master_fold(table, store.read(table).columns)


def read_master(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A master table as the version in force has it."""
    store = DeltaStore(spark, path)
    fold, parts = _stored_fold(store, table), store.read(table)
    if table == "events":
        first = fold.folded(parts).withColumn("_first", F.col("name")["o"])
        return absorb_yearless(first.select(*fold.keys, "_first", *[F.col(c)["v"].alias(c) for c in fold.columns]))
    rows = fold.values(parts)
    if table == "companies":
        return rows.withColumns({"updated_at": F.coalesce("updated_at", "created_at"), "company_id": F.md5("name_normalized")})
    return rows


def compact_master(spark: SparkSession, path: str) -> None:
    """Fold the parts of every table of a master to one; readers see the old parts or the new one."""
    store = DeltaStore(spark, path)
    compact(store, {name: _stored_fold(store, name) for name in store.version()[2]})


def stream_company_master(mentions: DataFrame, path: str, checkpoint: str, order_by: str, seen_at: str) -> StreamingQuery:
    """The companies of a stream of mentions, as `merge_companies` has them, whatever the order of the batches."""
    return stream_master(mentions, path, checkpoint, [order_by], {"companies": lambda b: b}, seen_at)


def read_company_master(spark: SparkSession, path: str) -> DataFrame:
    return read_master(spark, path, "companies")


def stream_job_counters(progress: DataFrame, job: str) -> DataFrame:
    """Live job counters; use update or complete output mode."""
    return job_counters(progress, job)


# --- runs --------------------------------------------------------------------------------

_STATE = Fold(["_key"], last=["n", "run"])


def stream_runs(
    rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order_by: Sequence[str], counts: Column, found: Callable[[DataFrame], DataFrame],
    horizon: str, rows_per_chunk: int = 200_000,
) -> StreamingQuery:
    """Running positions and streaks over a stream, in the order of the rows and not of their files.

    Rows wait until the latest time seen is `horizon` (an SQL interval) ahead of them; `order_by` begins with the
    time. Then they are counted in chunks of the order column, so that the rows of one key are spread over tasks,
    and go on from the position and run that their key had: one state row per key. What `found` takes from the rows
    with `position` and `streak` is added to the table `found`. Rows that come more than `horizon` late are kept
    in the table `late` and counted nowhere; rows without a time go first, later ones are late. `finish_runs`
    counts what still waits.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        _run_step(DeltaStore(batch.sparkSession, path), batch_id, batch, keys, order_by, counts, found, horizon, rows_per_chunk)

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _run_step(
    store: DeltaStore, batch_id: int | None, batch: DataFrame | None, keys: Sequence[str], order_by: Sequence[str], counts: Column,
    found: Callable[[DataFrame], DataFrame], horizon: str | None, rows_per_chunk: int,
) -> None:
    if batch_id is not None and batch_id <= store.version()[1]:
        return
    waiting = store.read("waiting") if store.has("waiting") else None
    if batch is None and waiting is None:
        return
    ts = order_by[0]
    kind = (batch if batch is not None else waiting).schema[ts].dataType
    now = F.lit(None).cast(kind)
    if store.has("clock"):
        now = F.lit(store.read("clock").agg(F.max("until").cast("string")).first()[0]).cast(kind)
    fresh = late = None
    if batch is not None:
        batch = batch.persist()
        on_time = (F.col(ts) > now) | now.isNull()
        fresh, late = batch.filter(F.coalesce(on_time, F.lit(False))), batch.filter(~F.coalesce(on_time, F.lit(False)))
    rows = fresh if waiting is None else waiting if fresh is None else waiting.unionByName(fresh)
    if horizon is None:
        ready, rest, until = rows, rows.filter(F.lit(False)), now
    else:
        latest = rows.agg((F.max(ts) - F.expr(f"INTERVAL {horizon}")).cast(kind).cast("string")).first()[0]
        until = F.greatest(now, F.lit(latest).cast(kind))
        done = F.coalesce(F.col(ts) <= until, F.col(ts).isNull())
        ready, rest = rows.filter(done), rows.filter(~done)
    key = F.struct(*keys, F.lit(0)).alias("_key")
    carry = None
    if store.has("state"):
        carry = _STATE.values(store.read("state")).select("_key.*", "n", "run").select(*keys, "n", "run")
    runs = with_streaks(ready, keys, order_by, counts, rows_per_chunk=rows_per_chunk, carry=carry).persist()
    last = _STATE.rows(runs.select(key, F.col("position").alias("n"), F.col("streak").alias("run")), F.col("n"))
    clock = store.spark.range(1).select(until.alias("until"))
    try:
        store.commit(batch_id, {"state": last, "found": found(runs), "clock": clock, **({} if late is None else {"late": late})}, {"waiting": rest})
    finally:
        runs.unpersist()
        if batch is not None:
            batch.unpersist()
    compact(store, {"state": _STATE}, MOST_PARTS)


def stream_switch_alerts(
    progress: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order_by: Sequence[str], items: str, horizon: str,
    min_pages: int = 3, min_streak: int = 2, **kw,
) -> StreamingQuery:
    """An alert when the empty-page run of an attempt gets too long; `read_switch_alerts` has one per attempt."""
    return stream_runs(progress, path, checkpoint, keys, order_by, _empty(items), _switches(keys, min_pages, min_streak), horizon, **kw)


def _empty(items: str) -> Column:
    return F.coalesce(F.col(items), F.lit(0)) == 0


def _switches(keys: Sequence[str], min_pages: int, min_streak: int) -> Callable[[DataFrame], DataFrame]:
    def found(runs: DataFrame) -> DataFrame:
        hit = runs.filter((F.col("position") >= min_pages) & (F.col("streak") >= min_streak))
        return keep_first(hit, keys, ["position"]).select(*keys, F.col("position").alias("pages_processed"), F.col("streak").alias("zero_streak"))

    return found


def finish_switch_alerts(spark: SparkSession, path: str, keys: Sequence[str], order_by: Sequence[str], items: str, min_pages: int = 3, min_streak: int = 2, rows_per_chunk: int = 200_000) -> None:
    """Count the rows that still wait for later ones: the stream has ended."""
    _run_step(DeltaStore(spark, path), None, None, keys, order_by, _empty(items), _switches(keys, min_pages, min_streak), None, rows_per_chunk)


def read_switch_alerts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The first alert of every attempt."""
    return keep_first(DeltaStore(spark, path).read("found"), keys, ["pages_processed"])


def stream_breaker(
    calls: DataFrame, path: str, checkpoint: str, key: str, order_by: Sequence[str], failed: str, horizon: str, max_errors: int = 3, cooldown_s: int = 600, **kw,
) -> StreamingQuery:
    """A row of the table `found` each time a provider is paused; only a success resets the error count.

    The pause is data (`disabled_until`), so the state is two numbers per provider and needs no timer.
    """
    return stream_runs(calls, path, checkpoint, [key], order_by, F.col(failed), _pauses(key, order_by[0], max_errors, cooldown_s), horizon, **kw)


def _pauses(key: str, ts: str, max_errors: int, cooldown_s: int) -> Callable[[DataFrame], DataFrame]:
    def found(runs: DataFrame) -> DataFrame:
        until = (F.col(ts) + F.expr(f"INTERVAL {cooldown_s} SECONDS")).alias("disabled_until")
        return runs.filter(F.col("streak") >= max_errors).select(key, ts, F.col("streak").alias("consecutive_errors"), until)

    return found


def finish_breaker(spark: SparkSession, path: str, key: str, order_by: Sequence[str], failed: str, max_errors: int = 3, cooldown_s: int = 600, rows_per_chunk: int = 200_000) -> None:
    _run_step(DeltaStore(spark, path), None, None, [key], order_by, F.col(failed), _pauses(key, order_by[0], max_errors, cooldown_s), None, rows_per_chunk)


def read_breaker(spark: SparkSession, path: str) -> DataFrame:
    return DeltaStore(spark, path).read("found")


def run_checkpointed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is new since the last run and stop; finished input is never read again."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def run_snapshots(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the full results of an aggregating stream as versions of a table; `read_snapshot` has the latest."""
    def store(batch: DataFrame, batch_id: int) -> None:
        DeltaStore(batch.sparkSession, path).commit(batch_id, replace={"result": batch})

    return (
        stream.writeStream.foreachBatch(store).outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return DeltaStore(spark, path).read("result")
