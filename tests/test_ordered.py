"""Running operators against brute force, also in the chunked path and with a hot key."""
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import ordered as O


def skewed(n, seed):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(6)}", i, rnd.choice([0, 0, 1, 3]), rnd.choice([0, 5, 40, 90, 150])) for i in range(n)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_per_chunk,quantiles", [(10_000, 512), (60, 512), (20, 4)])
def test_streaks_and_positions(spark, monkeypatch, rows_per_chunk, quantiles):
    monkeypatch.setattr(O, "QUANTILES", quantiles)
    rows = skewed(900, 1)
    df = spark.createDataFrame(rows, "k string, o long, items int, size long").repartition(5)
    got = {(r.k, r.o): (r.pages_processed, r.zero_streak) for r in O.zero_streak(df, ["k"], ["o"], "items", rows_per_chunk=rows_per_chunk).collect()}
    want, state = {}, {}
    for k, o, items, _ in sorted(rows, key=lambda r: r[1]):
        pages, streak = state.get(k, (0, 0))
        state[k] = (pages + 1, streak + 1 if items == 0 else 0)
        want[(k, o)] = state[k]
    assert got == want


@pytest.mark.parametrize("rows_per_chunk", [10_000, 50])
@pytest.mark.parametrize("budget", [100, 1000])
def test_pack_batches(spark, rows_per_chunk, budget):
    rows = skewed(700, budget)
    df = spark.createDataFrame(rows, "k string, o long, items int, size long").repartition(4)
    got = {(r.k, r.o): r.batch for r in O.pack_batches(df, "size", budget, ["o"], ["k"], rows_per_chunk).collect()}
    want, state = {}, {}
    for k, o, _, size in sorted(rows, key=lambda r: r[1]):
        used, batch, any_row = state.get(k, (0, 0, False))
        if any_row and used + size > budget:
            used, batch = 0, batch + 1
        state[k] = (used + size, batch, True)
        want[(k, o)] = batch
    assert got == want


def test_limits_and_batches(spark):
    rows = skewed(500, 3)
    df = spark.createDataFrame(rows, "k string, o long, items int, size long").repartition(4)
    small = O.limit_items(df, 5, ["o"], ["k"]).groupBy("k").count().collect()
    assert all(r["count"] == 5 for r in small)
    batches = O.fixed_batches(df, 10, ["o"], ["k"]).groupBy("k", "batch").count().collect()
    assert all(r["count"] <= 10 for r in batches) and sum(r["count"] for r in batches) == 500
    assert [r.o for r in O.limit_items(df, 3, ["o"]).orderBy("o").collect()] == [0, 1, 2]


def test_keep_first_prefilters_on_the_map_side(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    out = O.keep_first(df, ["k"], ["id"])
    assert sorted(r.id for r in out.collect()) == [0, 1, 2]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_breaker_and_switch(spark):
    rows = [("p", i, bad) for i, bad in enumerate([1, 1, 1, 1, 0, 1, 1])]
    df = spark.createDataFrame(rows, "p string, o long, bad int").withColumn("ts", F.timestamp_seconds("o"))
    got = [(r.o, r.consecutive_errors, (r.disabled_until - r.ts).seconds) for r in O.breaker_windows(df, ["p"], "ts", ["o"], F.col("bad") == 1).orderBy("o").collect()]
    assert got == [(2, 3, 600), (3, 4, 600)]
    pages = spark.createDataFrame([("j", i, n) for i, n in enumerate([0, 5, 0, 0, 0])], "j string, o long, n int")
    r = O.switch_points(pages, ["j"], ["o"], "n").first()
    assert (r.o, r.pages_processed, r.zero_streak) == (3, 4, 2)


def test_best_candidate_margin(spark):
    df = spark.createDataFrame([("j", "css", 3.0, 0), ("j", "ai", 3.0, 1), ("one", "css", 2.0, 0)], "j string, m string, s double, o int")
    got = {r.j: (r.best_method, r.best_score, r.margin) for r in O.best_candidate(df, "j", "m", F.col("s"), ["o"]).collect()}
    assert got == {"j": ("css", 3.0, 0.0), "one": ("css", 2.0, 2.0)}


def test_chunks_follow_any_order_type(spark, monkeypatch):
    monkeypatch.setattr(O, "QUANTILES", 4)
    ids = spark.range(200).select(
        F.when(F.col("id") > 5, F.col("id")).alias("n"), F.timestamp_seconds(F.col("id") * 977).alias("t"),
        F.timestamp_seconds(F.col("id") * 977).cast("timestamp_ntz").alias("z"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"),
    )
    for c in ("n", "t", "z", "d"):
        out, chunks = O.with_chunks(ids, c, 10)
        rows = [r["_chunk"] for r in out.orderBy(c).select("_chunk").collect()]
        assert rows == sorted(rows) and 15 <= chunks <= 20 and len(set(rows)) >= 15


def test_packing_goes_on_over_frames(spark):
    """A key that spans several Arrow batches keeps its open batch; short keys share frames with it."""
    rnd = random.Random(8)
    rows = [(rnd.choice(["hot", "hot", f"k{rnd.randrange(90)}", None]), i, rnd.choice([0, 1, 5, 30, 90, 101, 250])) for i in range(2_000)]
    df = spark.createDataFrame(rows, "k string, o long, size long").repartition(3)
    want, state = {}, {}
    for k, o, size in rows:
        used, batch = state.get(k, (None, 0))
        if used is not None and used + size > 100:
            used, batch = 0, batch + 1
        state[k] = ((used or 0) + size, batch)
        want[k, o] = batch
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, chunk in ((7, 1_000_000), (64, 40), (10_000, 300)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            assert {(r.k, r.o): r.batch for r in O.pack_batches(df, "size", 100, ["o"], ["k"], chunk).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("rows_per_chunk", [2, 3, 5, 1_000_000])
def test_packing_of_fractions_and_nulls_is_the_same_in_chunks(spark, rows_per_chunk):
    rows = [("k", i, s) for i, s in enumerate([0.6] * 9 + [None, 0.4, 0.4, 0.2, 1.5, 0.1, None, 0.9])] + [(None, i, 0.5) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, o int, size double")
    got = {(r.k, r.o): r.batch for r in O.pack_batches(df, "size", 1, ["o"], ["k"], rows_per_chunk).collect()}
    want = {}
    for key in ("k", None):
        used, batch = None, 0
        for k, o, s in rows:
            if k == key:
                units = round((s or 0) * 1_000_000)
                if used is None:
                    used = units
                elif used + units > 1_000_000:
                    used, batch = units, batch + 1
                else:
                    used += units
                want[k, o] = batch
    assert got == want


@pytest.mark.parametrize("rows_per_chunk", [1, 4, 1_000_000])
def test_texts_can_be_the_order(spark, rows_per_chunk):
    df = spark.createDataFrame([("k", f"n{i:04d}", int(i % 3 == 0)) for i in range(700)], "k string, o string, items int")
    got = {r.o: (r.pages_processed, r.zero_streak) for r in O.zero_streak(df, ["k"], ["o"], "items", rows_per_chunk=rows_per_chunk).collect()}
    assert got == {f"n{i:04d}": (i + 1, i % 3) for i in range(700)}


@pytest.mark.parametrize("n", [1, 7, 1500])
def test_limits_are_one_path(spark, n):
    df = spark.createDataFrame([("hot" if i % 4 else None, i) for i in range(2_000)], "k string, o int")
    got = sorted((str(r.k), r.o) for r in O.limit_items(df, n, ["o"], ["k"]).collect())
    want = sorted((str(k), o) for k in ("hot", None) for o in [i for i in range(2_000) if ("hot" if i % 4 else None) == k][:n])
    assert got == want
