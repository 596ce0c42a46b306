import pytest
from pyspark.sql import functions as F

from leadloom.operators import merge as M
from leadloom.operators import ordered as O
from leadloom.operators import reports as R
from leadloom.plans.io import _deliver
from leadloom.sources import readers as RD
from leadloom.sources import writers as W
from leadloom.sources.split_csv import csv_records
from leadloom.streaming import jobs as S
from leadloom.streaming.store import DeltaStore


def test_csv_with_bom_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿name,note\n"A ""x"", b","line 1\nline 2"\nB,\n'.encode())
    rows = RD.read_leads_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [('A "x", b', "line 1\nline 2"), ("B", None)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, end):
    import csv
    import random

    rnd = random.Random(1)
    field = lambda: rnd.choice(["", "a", 'say ""x""'.replace('""', '"'), "one\ntwo", '\n"', "é, ü", '",\n', '5" disk', "日本", '"', "\n\n"])
    rows = [[str(i), field(), field(), f"end{i}"] for i in range(400)]
    path = tmp_path / "big.csv"
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        csv.writer(f, lineterminator=end).writerows([["id", "a b", "c`d", "z"], *rows])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500"), spark.conf.set("spark.sql.files.openCostInBytes", "0")
        records = csv_records(spark, str(path))
        df = RD.read_leads_csv(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() >= 15
        got = sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))
        assert [r.record for r in records.orderBy("record").collect()] == list(range(1, 402))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert df.columns == ["id", "a b", "c`d", "z"]
    assert got == [tuple(v or None for v in r) for r in rows]


@pytest.mark.parametrize("lines_per_chunk", [1, 2, 7, 4_096])
def test_chunks_of_lines_change_no_csv_record(spark, tmp_path, lines_per_chunk):
    import random

    rnd = random.Random(2)
    field = lambda: rnd.choice(["", "a", '"b"', '"one\ntwo"', '"\n\n\n\n"', '"say ""x"",\n"', '5" disk', '"' + "long\n" * 20 + '"'])
    want = {}
    for name, n in (("a.csv", 120), ("b.csv", 3), ("c.csv", 60)):
        want[name] = ["id,x,y", *[f"{i},{field()},{field()}" for i in range(n)], *(['9,"open\n,z'] if name == "c.csv" else [])]
        (tmp_path / name).write_text("\n".join(want[name]) + ("\n" if name == "a.csv" else ""))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700"), spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = csv_records(spark, str(tmp_path), lines_per_chunk).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.file.rsplit("/", 1)[1], r.record, r.text) for r in rows) == [(f, i, t) for f in sorted(want) for i, t in enumerate(want[f], 1)]


def test_lines_of_one_block_are_dealt_to_many_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n" + "".join(f'{i},"[""a"",""{i}""]"\n' for i in range(40_000)))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() == 1
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        held = RD.read_leads_csv(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    # a window holds all rows of its group: a block of a file would be one group
    assert sum(r["count"] for r in held) == 40_000 and max(r["count"] for r in held) < 25_000


def test_csv_quotes_inside_plain_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,t\n1,5" disk\n2,"x\n\n""y"""\n\n3,"open\n4,z\n')
    (tmp_path / "b.csv").write_text("n,t\n9,q")
    rows = {(r.source_file, r.n): r.t for r in RD.read_csv_glob(spark, str(tmp_path), "*.csv").collect()}
    assert rows[("a.csv", "1")] == '5" disk' and rows[("a.csv", "2")] == 'x\n\n"y"' and rows[("b.csv", "9")] == "q" and len(rows) == 4


def test_run_reports(spark, tmp_path):
    (tmp_path / "smoke-20240101-000000.json").write_text('{"summary":{"total":4,"passed":3},"results":[{"profile_name":"a","passed":true},"junk",{"passed":false,"diagnostics":{"counters":{"empty_pages":2},"parser_metrics":{"scalar_ratio":0.5}}}]}')
    (tmp_path / "smoke-20240102-000000.json").write_text('{"results":[{"profile_name":"b","passed":false,"reason":"x"}]}')
    rows = RD.read_run_reports(spark, str(tmp_path))
    s = {r.report: r for r in R.summarize_run(rows, "report", summary=True).collect()}
    a, b = s["smoke-20240101-000000.json"], s["smoke-20240102-000000.json"]
    assert (a.total, a.passed, a.failed, a.pass_rate, a.avg_empty_pages, a.avg_parser_scalar_ratio) == (4, 3, 1, 0.75, 1.0, 0.25)
    assert (b.total, b.passed, b.failed) == (1, 0, 1)
    failed = R.failed_profiles(rows, "report").collect()
    assert sorted(r.profile_name for r in failed) == ["b", "unknown-profile"]


def test_compare_runs_gates(spark):
    rows = [("r1", f"p{i}", i > 0, 0, 0, 0.9, 0.9) for i in range(10)] + [("r2", f"p{i}", i > 2, 3, 0, 0.5, 0.9) for i in range(10)]
    df = spark.createDataFrame(rows, "report string, profile_name string, passed boolean, empty_pages long, method_switches long, scalar_ratio double, structured_ratio double")
    r = R.compare_runs(df, "report").first()
    assert not r.ok and list(r.issues) == [
        "pass_rate_drop=0.200 exceeds threshold 0.100", "avg_empty_pages_increase=3.000 exceeds threshold 2.000",
        "avg_parser_scalar_drop=0.400 exceeds threshold 0.100", "new_failed_profiles=p1, p2 exceeds allowed count 0",
    ]


def test_corrupt_job_is_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"1","status":"scraping"}')
    (tmp_path / "b.json").write_text("{oops")
    assert [r.id for r in RD.read_jobs(spark, str(tmp_path)).collect()] == ["1"]


def test_checkpoint_maps(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"1":{"status":"ok"},"2":{"status":"error","error":"HTTP 500"}}')
    got = {r.id: (r.status, r.error) for r in RD.read_progress_map(spark, str(tmp_path / "p.json")).collect()}
    assert got == {"1": ("ok", None), "2": ("error", "HTTP 500")}
    (tmp_path / "e.json").write_text('{"done_slugs":["a","b"],"enrichments":{"a":{"vertical":"V"},"c":{}}}')
    got = {r.slug: (r.done, r.enrichment) for r in RD.read_enrichment_map(spark, str(tmp_path / "e.json")).collect()}
    assert got == {"a": (True, {"vertical": "V"}), "b": (True, None), "c": (False, {})}


def test_write_with_log_counts_in_one_pass(spark, tmp_path):
    W.write_with_log(spark.range(7), str(tmp_path / "d"), str(tmp_path / "log"), "event", "Fair", "2026-01-01")
    r = spark.read.parquet(str(tmp_path / "log")).first()
    assert (r.row_count, r.source_name) == (7, "Fair")


def _batches(spark, path, frames):
    """Stream of the frames, one file per trigger in order."""
    import time

    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{path}/tmp{i}")
        import glob, shutil
        shutil.copy(glob.glob(f"{path}/tmp{i}/part-*.parquet")[0], f"{path}/in/f{i}.parquet")
        time.sleep(0.02)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_company_master_over_batches_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    cols = "o long, at string, name string, country string, city string"
    a = spark.createDataFrame([(1, "t1", "Acme", None, "B"), (2, "t2", "Beta", "FR", None)], cols)
    b = spark.createDataFrame([(3, "t3", "ACME ", "DE", "C"), (4, "t4", "Beta", "XX", None)], cols)
    c = spark.createDataFrame([(5, "t5", "acme", None, None)], cols)
    stream = _batches(spark, tmp_path, [a, b, c])
    run = lambda: S.stream_company_master(stream, str(tmp_path / "m"), str(tmp_path / "ck"), "o", "at").awaitTermination()
    run()
    run()  # a restart adds nothing
    key = lambda df: sorted((r["name"], r.country, r.city, r.created_at, r.updated_at) for r in df.collect())
    batch = M.merge_companies(a.union(b).union(c), ["o"], "at")
    assert key(S.read_company_master(spark, str(tmp_path / "m"))) == key(batch)
    S.compact_master(spark, str(tmp_path / "m"))
    assert key(S.read_company_master(spark, str(tmp_path / "m"))) == key(batch)


def test_master_of_several_tables_in_any_order(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(S, "MOST_PARTS", 2)  # compacts on the way
    (tmp_path / "in").mkdir()
    rnd = random.Random(2)
    some = lambda *v: rnd.choice([None, *v])
    rows = [(i, f"t{i:03}", rnd.choice(["Acme", "acme ", "Beta", ""]), some("DE", "FR"), some("B", "C"), rnd.choice("mn"), some(1.0, 2.0), some("k1", "k2"), rnd.choice(["Fair", "fair"]), some(2024, 2025)) for i in range(60)]
    cols = "o long, at string, name string, country string, city string, marketplace_id string, rating double, kvk_number string, event string, year int"
    whole = spark.createDataFrame(rows, cols)
    rnd.shuffle(rows)
    stream = _batches(spark, tmp_path, [spark.createDataFrame(rows[i : i + 12], cols) for i in range(0, 60, 12)])
    named = lambda b: b.filter("trim(name) <> ''")
    tables = {
        "companies": lambda b: b.drop("year"),
        "marketplace_sellers": lambda b: named(b).select(F.lower(F.trim("name")).alias("company_id"), "marketplace_id", "rating", "kvk_number", "o"),
        "events": lambda b: b.select(F.col("event").alias("name"), "year", "city", "country", F.col("at").alias("website"), "o"),
    }
    run = lambda: S.stream_master(stream, str(tmp_path / "m"), str(tmp_path / "ck"), ["o"], tables, "at").awaitTermination()
    run()
    want = {"companies": M.merge_companies(whole, ["o"], "at"), "marketplace_sellers": M.merge_sellers(tables["marketplace_sellers"](whole), ["o"]), "events": M.merge_events(tables["events"](whole), ["o"])}
    for name, df in want.items():
        got = S.read_master(spark, str(tmp_path / "m"), name)
        assert set(got.columns) == set(df.columns)
        assert sorted(map(str, got.select(df.columns).collect())) == sorted(map(str, df.collect()))


def test_store_versions(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path / "s"))
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    assert store.version() == (0, -1, {}) and not store.has("a")
    assert store.commit(0, {"a": one(1), "b": one(10)})
    seen = store.read("a")
    assert not store.commit(0, {"a": one(9)})  # a replay
    store.commit(1, {"a": one(2)}, replace={"b": one(20)})
    values = lambda df: sorted(r.v for r in df.collect())
    assert values(seen) == [1] and values(store.read("a")) == [1, 2] and values(store.read("b")) == [20]
    # parts without a version, as a failed batch leaves them, are not seen
    one(7).write.parquet(str(tmp_path / "s" / "a" / "3-lost"))
    assert values(store.read("a")) == [1, 2]


def test_stream_alerts_equal_the_batch_result(spark, tmp_path):
    import random

    (tmp_path / "in").mkdir()
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), t, i, rnd.choice([0, 0, 0, 4, None])) for i, t in enumerate(sorted(rnd.randrange(300) for _ in range(200)))]
    cols = "j string, t int, o int, n int"
    whole = spark.createDataFrame(rows, cols).withColumn("t", F.timestamp_seconds("t"))
    files = sorted(rows, key=lambda r: r[1] + rnd.randrange(20))  # up to 20 seconds out of order
    frames = [spark.createDataFrame(files[i : i + 40], cols).withColumn("t", F.timestamp_seconds("t")) for i in range(0, 200, 40)]
    stream = _batches(spark, tmp_path, frames)
    path = str(tmp_path / "out")
    S.stream_switch_alerts(stream, path, str(tmp_path / "ck"), ["j"], ["t", "o"], "n", "20 SECONDS", rows_per_chunk=7).awaitTermination()
    assert DeltaStore(spark, path).read("waiting").count() > 0 and DeltaStore(spark, path).read("late").count() == 0
    S.finish_switch_alerts(spark, path, ["j"], ["t", "o"], "n")
    got = sorted(map(str, S.read_switch_alerts(spark, path, ["j"]).collect()))
    assert got == sorted(map(str, O.switch_points(whole, ["j"], ["t", "o"], "n").select("j", "pages_processed", "zero_streak").collect()))
    S.stream_breaker(stream.withColumn("bad", F.coalesce(F.col("n") == 0, F.lit(False))), str(tmp_path / "br"), str(tmp_path / "ck2"), "j", ["t", "o"], "bad", "20 SECONDS", max_errors=2, rows_per_chunk=7).awaitTermination()
    S.finish_breaker(spark, str(tmp_path / "br"), "j", ["t", "o"], "bad", max_errors=2)
    want = O.breaker_windows(whole, ["j"], "t", ["t", "o"], F.coalesce(F.col("n") == 0, F.lit(False)), max_errors=2)
    assert sorted(map(str, S.read_breaker(spark, str(tmp_path / "br")).collect())) == sorted(map(str, want.select("j", "t", "consecutive_errors", "disabled_until").collect()))


def test_rows_beyond_the_horizon_are_kept_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    cols = "j string, t int, o int, n int"
    make = lambda *r: spark.createDataFrame(list(r), cols).withColumn("t", F.timestamp_seconds("t"))
    frames = [make(("a", 100, 1, 0), ("a", 200, 2, 0)), make(("a", 50, 3, 5), ("a", 195, 4, 0), ("a", None, 5, 0))]
    path = str(tmp_path / "out")
    S.stream_switch_alerts(_batches(spark, tmp_path, frames), path, str(tmp_path / "ck"), ["j"], ["t", "o"], "n", "10 SECONDS").awaitTermination()
    S.finish_switch_alerts(spark, path, ["j"], ["t", "o"], "n")
    S.finish_switch_alerts(spark, path, ["j"], ["t", "o"], "n")  # nothing waits any more
    assert sorted(r.o for r in DeltaStore(spark, path).read("late").collect()) == [3, 5]
    assert [tuple(r) for r in S.read_switch_alerts(spark, path, ["j"]).collect()] == [("a", 3, 3)]


def test_stream_dedup_with_horizon(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("A", "w", None, 1), ("a ", "W", None, 2), ("B", None, "u", 3)]
    df = spark.createDataFrame(rows, "name string, website string, source_url string, s long").withColumn("at", F.timestamp_seconds("s"))
    unique = S.stream_dedup_leads(_batches(spark, tmp_path, [df]), "at", "1 hour")
    S.run_checkpointed(unique, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_long_reports_come_in_pieces(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("ord"), F.concat(F.lit("r"), F.col("id") % 2).alias("report"), (F.col("id") % 3 == 0).alias("passed"), F.concat(F.lit("p"), "id").alias("profile_name"))
    W.write_run_reports(rows, f"{tmp_path}/r", F.struct("profile_name", "passed"), "ord", rows_per_file=300)
    back = RD.read_run_reports(spark, f"{tmp_path}/r", files="report=*/piece=*/*", name=F.regexp_extract("_metadata.file_path", r"report=([^/]+)/", 1))
    got = back.select("report", "summary_total", "profile_name", "passed", "pos").collect()
    assert sorted((r.report, r.profile_name, r.passed) for r in got) == sorted((f"r{i % 2}", f"p{i}", i % 3 == 0) for i in range(5000))
    assert {r.summary_total for r in got} == {2500} and max(r.pos for r in got) < 600


def test_odd_report_files(spark, tmp_path):
    for name, text in {
        "a": '\ufeff{"summary": {"total": 9},\n "results": [{"profile_name": "x", "passed": true}, 5, "t", null]}', "b": "{broken", "c": "", "d": '{"results": []}',
    }.items():
        (tmp_path / f"smoke-{name}.json").write_text(text)
    got = sorted((r.report, r.summary_total, r.profile_name, r.passed) for r in RD.read_run_reports(spark, str(tmp_path)).collect() if r.profile_name or r.report != "smoke-a.json")
    assert got == [("smoke-a.json", 9, "x", True), ("smoke-b.json", 0, None, False), ("smoke-d.json", 0, None, False)]


def test_a_stream_drop_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 6).select(F.col("id").alias("ord"))
    seen = []

    def job(stream):
        seen.append(len(list((tmp_path / "in").glob("*.parquet"))))
        return S.run_checkpointed(stream, f"{tmp_path}/out", f"{tmp_path}/check")

    _deliver(rows, f"{tmp_path}/in", F.col("ord") % 3, 3, job)
    assert seen == [6, 12] and spark.read.parquet(f"{tmp_path}/out").count() == 4000
