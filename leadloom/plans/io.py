"""Queries over sources, sinks and streams: tables are written to a scratch folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadloom.functions import text as X
from leadloom.operators import dedup as DD
from leadloom.operators.quality import table_stats
from leadloom.plans.companies import (
    COMPANIES_SQL, EVENT_ROWS_SQL, EXHIBITORS_SQL, LEAD_KEY, LEAD_TEXT, SELLERS_SQL, SOCIALS_SQL, company_tables, lead_records, merged_tables,
    social_links,
)
from leadloom.plans.jobs import ERRORS, ZERO
from leadloom.plans.registry import Tables, query
from leadloom.schemas import REQUEST_COLUMNS
from leadloom.session import ensure_checkpoint_dir
from leadloom.sources import readers as R
from leadloom.sources import writers as W
from leadloom.streaming import jobs as S


def scratch(t: Tables) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(t.spark)}/leadloom-{uuid.uuid4().hex}"


class Streams(Tables):
    """The derived views over a streaming `events` or `orders` table."""

    def __init__(self, t: Tables, table: str) -> None:
        super().__init__(t.spark, t.folder)
        self._table = table

    def __getattr__(self, name):
        if name == self.__dict__.get("_table"):
            schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
            return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)
        return super().__getattr__(name)


@query("src1_read_leads_csv", "SELECT page_id, cname || chr(10) || 'line \"two\", ' || nname AS note, '=' || CASE WHEN page_id % 3 = 0 THEN '' ELSE seg END AS seg FROM {detail_pages}")
def _(t):
    path = scratch(t)
    note = F.concat("cname", F.lit('\nline "two", '), "nname")
    W.write_csv(t.detail_pages.select("page_id", note.alias("note"), F.when(F.col("page_id") % 3 != 0, F.col("seg")).alias("seg")), path)
    back = R.read_leads_csv(t.spark, path)
    return back.select(F.col("page_id").cast("bigint").alias("page_id"), "note", F.concat(F.lit("="), F.coalesce("seg", F.lit(""))).alias("seg"))


@query("src2_read_csv_glob", "SELECT s_suppkey AS id, s_name AS name, s_nationkey || chr(10) || '\"' || s_name || '\", x' AS note FROM supplier")
def _(t):
    path = scratch(t)
    note = F.concat(F.col("s_nationkey").cast("string"), F.lit('\n"'), "s_name", F.lit('", x'))
    W.write_csv(t.supplier.select("s_suppkey", "s_name", note.alias("note")).repartition(4, "s_suppkey"), path)
    back = R.read_csv_glob(t.spark, path, "part-*.csv").filter(F.startswith("source_file", F.lit("part-")))
    return back.select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_name").alias("name"), "note")


@query("src3_read_results_json", "SELECT ord, name, website, CASE WHEN brands_text IS NULL THEN 0 ELSE 2 END AS n_brands, social_linkedin AS linkedin FROM {leads}")
def _(t):
    path = scratch(t)
    records = lead_records(t).withColumn("source_url", F.col("ord").cast("string"))
    keep = ["name", "website", "brands", "social_media", "source_url"]
    W.write_results_json(records.select(*keep), path)
    back = R.read_results_json(t.spark, path, multi_line=False)
    return back.select(
        F.col("source_url").cast("bigint").alias("ord"), "name", "website", F.size("brands").alias("n_brands"), F.col("social_media")["linkedin"].alias("linkedin")
    )


@query(
    "src4_read_run_reports",
    "SELECT report || '.json' AS report, count(*) AS rows, sum(empty_pages)::BIGINT AS empty_pages, count(*) FILTER (WHERE NOT passed) AS failed FROM {run_results} GROUP BY report",
)
def _(t):
    path = scratch(t)
    row = F.struct(
        "profile_name", "status", "reason", "passed",
        F.struct(F.create_map(F.lit("empty_pages"), "empty_pages").alias("counters"), F.create_map(F.lit("scalar_ratio"), "scalar_ratio").alias("parser_metrics")).alias("diagnostics"),
    )
    W.write_run_reports(t.run_results, path, row, "ord")
    # one folder per report was written; the reader takes the files under their report name
    back = R.read_run_reports(t.spark, path, files="report=*/piece=*/*", name=F.regexp_extract("_metadata.file_path", r"report=([^/]+)/", 1))
    return back.groupBy(F.concat("report", F.lit(".json")).alias("report")).agg(
        F.count("*").alias("rows"), F.sum("empty_pages").alias("empty_pages"), F.count_if(~F.col("passed")).alias("failed")
    )


@query("src5_read_jobs", "SELECT CAST(id AS VARCHAR) AS id, status, CASE WHEN error IS NULL THEN 0 ELSE 1 END AS has_error, n_pending FROM {jobs} WHERE id % 10 <> 3")
def _(t):
    path = scratch(t)
    pending = F.array_repeat(F.lit("u"), F.col("n_pending").cast("int"))
    text = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "status", "error", pending.alias("pending_detail_urls")))
    t.jobs.select(F.when(F.col("id") % 10 == 3, F.lit('{"id": broken')).otherwise(text).alias("value")).write.text(path)
    back = R.read_jobs(t.spark, path, multi_line=False)
    return back.select("id", "status", F.when(F.col("error").isNull(), 0).otherwise(1).alias("has_error"), F.coalesce(F.size("pending_detail_urls"), F.lit(0)).cast("bigint").alias("n_pending"))


@query("src6_read_progress_map", "SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_acctbal < 0 THEN 'error' WHEN s_acctbal < 3000 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN s_acctbal < 0 THEN s_name END AS error FROM supplier")
def _(t):
    path = scratch(t)
    status = F.when(F.col("s_acctbal") < 0, "error").when(F.col("s_acctbal") < 3000, "empty").otherwise("ok")
    entry = F.struct(status.alias("status"), F.when(F.col("s_acctbal") < 0, F.col("s_name")).alias("error"))
    # one checkpoint file per nation
    maps = t.supplier.groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("k"), entry.alias("v")))).alias("m"))
    maps.select("s_nationkey", F.to_json("m").alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    return R.read_progress_map(t.spark, f"{path}/*")


@query("src7_read_sitemaps", "SELECT count(*) AS n, count(DISTINCT url) AS urls FROM {site_urls}")
def _(t):
    path = scratch(t)
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url>"))), ""), F.lit("</urlset>"))
    t.site_urls.groupBy("host").agg(xml.alias("value")).repartition("host").write.partitionBy("host").text(path)
    t.spark.range(1).select(F.lit("bad").alias("host"), F.lit("<urlset><url><loc>https://lost</loc>").alias("value")).write.mode("append").partitionBy("host").text(path)
    return R.read_sitemaps(t.spark, f"{path}/*").agg(F.count("*").alias("n"), F.countDistinct("loc").alias("urls"))


# a request without a number (or with zero) is an empty sheet row
REQ_SQL = "SELECT request_num, status, priority, source_type, event_name, url FROM {requests} WHERE request_num <> 0"


def _request_sheet(t: Tables):
    have = {c: F.col(c).cast("string") for c in ("request_num", "status", "source_type", "event_name", "url")}
    have["priority"] = F.when(F.col("priority") != "Normal", F.col("priority"))
    return t.requests.select(*[have.get(c, F.lit(None).cast("string")).alias(c) for c in REQUEST_COLUMNS])


@query("src9_read_requests", REQ_SQL)
def _(t):
    path = scratch(t)
    blank = t.spark.range(1).select(*[F.lit(None).cast("string").alias(c) for c in REQUEST_COLUMNS])
    W.write_csv(_request_sheet(t).unionByName(blank), path)
    return R.read_requests(t.spark, path).select("request_num", "status", "priority", "source_type", "event_name", "url")


@query("snk2_write_csv", "SELECT ord, name, concat_ws('|', nullif(trim(replace(cats_text, ' ; ', '|')), '')) AS cats FROM {leads}")
def _(t):
    path = scratch(t)
    W.write_csv(lead_records(t).select("ord", "name", "product_categories"), path)
    back = R.read_leads_csv(t.spark, path)
    return back.select(F.col("ord").cast("bigint").alias("ord"), "name", F.array_join(F.from_json("product_categories", "array<string>"), "|").alias("cats"))


@query("snk3_write_results_json", "SELECT count(*) AS n, count(website) AS with_website FROM {leads}")
def _(t):
    path = scratch(t)
    W.write_results_json(t.leads.select("name", "website"), path)
    lines = t.spark.read.text(path)
    return lines.agg(F.count("*").alias("n"), F.count_if(F.contains("value", F.lit('"website"'))).alias("with_website"))


@query("snk4_union_of_keys", "SELECT s_name AS name, s_suppkey AS a, CAST(NULL AS BIGINT) AS b FROM supplier UNION ALL SELECT c_name, NULL, c_custkey FROM customer")
def _(t):
    return W.union_of_keys([t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("a")), t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("b"))])


@query("snk5_write_tables", "SELECT 'companies' AS \"table\", (SELECT count(*) FROM supplier) AS rows UNION ALL SELECT 'marketplace_sellers', (SELECT count(*) FROM (SELECT DISTINCT company, marketplace FROM {facts}))")
def _(t):
    path = scratch(t)
    W.write_tables({k: v for k, v in merged_tables(t).items() if k in ("companies", "marketplace_sellers")}, path)
    return table_stats({n: t.spark.read.parquet(f"{path}/{n}") for n in ("companies", "marketplace_sellers")})


@query("snk7_write_by_source", "SELECT CASE source_type WHEN 'Marketplace' THEN 'Marketplace Scraped Data' WHEN 'Trade Fair' THEN 'Event Scraped Data' ELSE 'Other' END AS source_folder, replace(event_name, '/', '-') AS source_dir, count(*) AS n FROM {requests} GROUP BY 1, 2")
def _(t):
    path = scratch(t)
    W.write_by_source(t.requests, path, files_per_source=2)
    return t.spark.read.parquet(path).groupBy("source_folder", "source_dir").agg(F.count("*").alias("n"))


# --- streams -----------------------------------------------------------------------------


def _finish(stream) -> None:
    stream.awaitTermination()


@query("st1_stream_requests", "SELECT CAST(request_num AS VARCHAR) AS request_num, url FROM {requests} WHERE status = 'New'")
def _(t):
    path = scratch(t)
    W.write_csv(_request_sheet(t), f"{path}/inbox")
    _finish(S.run_checkpointed(S.stream_requests(t.spark, f"{path}/inbox"), f"{path}/out", f"{path}/check"))
    return t.spark.read.parquet(f"{path}/out").select("request_num", "url")


@query("st2_stream_dedup_leads", f"SELECT DISTINCT k1, k2 FROM (SELECT {LEAD_KEY} FROM {{leads}})")
def _(t):
    path = scratch(t)
    k1, k2 = DD.lead_key()
    # keys are forgotten after the horizon, here longer than the table's seven years
    leads = Streams(t, "orders").leads.withColumn("at", F.col("seen_at").cast("timestamp"))
    unique = S.stream_dedup_leads(leads, "at", "4000 days").select(k1.alias("k1"), k2.alias("k2"))
    _finish(S.run_checkpointed(unique, f"{path}/out", f"{path}/check"))
    return t.spark.read.parquet(f"{path}/out")


def _deliver(df, path: str, part, parts: int, job) -> None:
    """`df` as a stream that comes in drops, two at a time: the rows of drop i have part = i. After each delivery
    `job` takes the stream and is run on what is new, as a batch of its own; a drop has as many files as it was
    written by tasks."""
    cut = df.withColumn("_part", part)
    for i in range(0, parts, 2):
        cut.filter(F.col("_part").isin(i, i + 1)).drop("_part").write.mode("append").parquet(path)
        _finish(job(df.sparkSession.readStream.schema(df.schema).parquet(path)))


@query("st3_stream_company_master", COMPANIES_SQL)
def _(t):
    path = scratch(t)
    mentions = t.leads.select("ord", "seen_at", "name", *[X.clean_str(c).alias(c) for c in LEAD_TEXT])
    # any drop may hold the first or the last mention of a company
    _deliver(mentions, f"{path}/in", F.pmod(F.xxhash64("ord"), F.lit(5)), 5, lambda stream: S.stream_company_master(stream, f"{path}/master", f"{path}/check", "ord", "seen_at"))
    return S.read_company_master(t.spark, f"{path}/master")


def _stream_table(t: Tables, name: str, rows):
    path = scratch(t)
    _deliver(rows, f"{path}/in", F.pmod(F.xxhash64("ord"), F.lit(3)), 3, lambda stream: S.stream_master(stream, f"{path}/master", f"{path}/check", ["ord"], {name: lambda b: b}))
    S.compact_master(t.spark, f"{path}/master")
    return S.read_master(t.spark, f"{path}/master", name)


@query("st3_stream_sellers", SELLERS_SQL)
def _(t):
    return _stream_table(t, "marketplace_sellers", company_tables(t)["marketplace_sellers"])


@query("st3_stream_exhibitors", EXHIBITORS_SQL)
def _(t):
    return _stream_table(t, "event_exhibitors", company_tables(t)["event_exhibitors"])


@query("st3_stream_events", EVENT_ROWS_SQL)
def _(t):
    return _stream_table(t, "events", t.event_mentions)


@query("st3_stream_socials", SOCIALS_SQL)
def _(t):
    return _stream_table(t, "company_socials", social_links(t))


@query(
    "st4_stream_job_counters",
    """SELECT job, count(*) FILTER (WHERE stage = 'scraping_pages') AS pages_processed, CAST(coalesce(sum(greatest(page_items, 0)) FILTER (WHERE stage = 'scraping_pages'), 0) AS BIGINT) AS items_extracted,
      count(*) FILTER (WHERE stage = 'scraping_pages' AND page_items = 0) AS empty_pages, count(*) FILTER (WHERE stage = 'method_fallback') AS method_fallbacks, CAST(0 AS BIGINT) AS method_switches FROM {progress} GROUP BY job""",
)
def _(t):
    path = scratch(t)
    _deliver(t.progress, f"{path}/in", F.pmod(F.xxhash64("ord"), F.lit(4)), 4, lambda stream: S.run_snapshots(S.stream_job_counters(stream, "job"), f"{path}/out", f"{path}/check"))
    return S.read_snapshot(t.spark, f"{path}/out")


def _days(ts, shift):
    """Drops of ten days that overlap: a row comes up to a day after its time."""
    return F.floor((F.unix_timestamp(ts.cast("timestamp")) - F.lit(1704067200) + shift) / F.lit(10 * 86400)).cast("int")


@query("st5_stream_switch_alerts", f"WITH {ZERO}, h AS (SELECT *, rn - coalesce(last_reset, 0) AS z FROM r), p AS (SELECT job, min(rn) AS rn FROM h WHERE rn >= 3 AND z >= 2 GROUP BY job) SELECT h.job, h.pages_processed, h.z AS zero_streak FROM h JOIN p ON h.job = p.job AND h.rn = p.rn")
def _(t):
    path = scratch(t)
    rows = t.progress.select("job", "ts", "ord", "page_items")
    _deliver(rows, f"{path}/in", _days(F.col("ts"), F.pmod(F.xxhash64("ord"), F.lit(86400))), 4, lambda stream: S.stream_switch_alerts(
        stream, f"{path}/out", f"{path}/check", ["job"], ["ts", "ord"], "page_items", "1 DAY", rows_per_chunk=1_000
    ))
    S.finish_switch_alerts(t.spark, f"{path}/out", ["job"], ["ts", "ord"], "page_items")
    return S.read_switch_alerts(t.spark, f"{path}/out", ["job"])


@query("st6_stream_breaker", f"WITH {ERRORS} SELECT provider, ts, rn - coalesce(last_reset, 0) AS consecutive_errors, ts + INTERVAL 600 SECONDS AS disabled_until FROM r WHERE failed AND rn - coalesce(last_reset, 0) >= 3")
def _(t):
    path = scratch(t)
    calls = t.calls.select("provider", "ts", "ord", "failed")
    # the two providers hold all rows: chunks of their time are counted apart
    _deliver(calls, f"{path}/in", _days(F.col("ts"), F.pmod(F.xxhash64("ord"), F.lit(86400))), 4, lambda stream: S.stream_breaker(
        stream, f"{path}/out", f"{path}/check", "provider", ["ts", "ord"], "failed", "1 DAY", rows_per_chunk=1_000
    ))
    S.finish_breaker(t.spark, f"{path}/out", "provider", ["ts", "ord"], "failed")
    return S.read_breaker(t.spark, f"{path}/out")


@query("st7_run_checkpointed", "SELECT ord, job, page_items FROM {progress}")
def _(t):
    path = scratch(t)
    rows = Streams(t, "events").progress.select("ord", "job", "page_items")
    for _run in range(2):
        # the second run finds nothing new
        _finish(S.run_checkpointed(rows, f"{path}/out", f"{path}/check"))
    return t.spark.read.parquet(f"{path}/out")
