"""File sources. CSV columns are always read as text; cleaning decides the types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.text import clean_int, trim_ws
from leadloom.operators.frontier import sitemap_locs
from leadloom.schemas import JOB_SCHEMA, LEAD_SCHEMA, REQUEST_COLUMNS
from leadloom.sources.split_csv import read_csv_split


def read_leads_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, UTF-8 with or without byte-order mark, quoted line breaks allowed; large files are split."""
    return read_csv_split(spark, path).drop("source_file")


def read_csv_glob(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Many files as one table, with `source_file` as the order key of the files."""
    return read_csv_split(spark, f"{folder}/{pattern}")


def read_results_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON array of leads (or JSON lines with `multi_line=False`); missing keys are NULL."""
    return spark.read.schema(LEAD_SCHEMA).option("multiLine", multi_line).json(path)


def read_run_reports(
    spark: SparkSession, folder: str, files: str = "smoke-*.json", name: Column | None = None
) -> DataFrame:
    """One row per result of every `smoke-*.json` report, with the stored totals of its report.

    Names sort by time. Result entries that are not objects are skipped; the total falls
    back to the number of entries.
    A file is read by one task; a long report may come as several files under one `name`, `pos` counts in its file.
    """
    schema = "summary struct<total:bigint,passed:bigint,failed:bigint>, results array<string>"
    row = "profile_name string, status string, reason string, passed boolean, " \
          "diagnostics struct<counters:map<string,bigint>,parser_metrics:map<string,double>>"
    # the JSON reader would go back to the file for the text of every entry; a generator parses a document once
    text = F.ltrim("value", F.lit("\ufeff"))
    raw = spark.read.text(f"{folder}/{files}", wholetext=True).filter(trim_ws(text) != "").select(
        (F.col("_metadata.file_name") if name is None else name).alias("report"), F.inline(F.array(F.from_json(text, schema)))
    )
    n = F.coalesce(F.size("results"), F.lit(0)).cast("bigint")
    total = F.coalesce("summary.total", F.greatest(n, F.lit(0)))
    passed = F.coalesce("summary.passed", F.lit(0).cast("bigint"))
    flat = raw.select(
        "report", total.alias("summary_total"), passed.alias("summary_passed"),
        F.coalesce("summary.failed", F.greatest(total - passed, F.lit(0))).alias("summary_failed"),
        F.posexplode_outer("results").alias("pos", "_raw"),
    ).filter(F.col("_raw").isNull() | F.startswith(trim_ws("_raw"), F.lit("{")))
    r = F.from_json("_raw", row)
    counter = lambda k: F.coalesce(F.element_at(r["diagnostics"]["counters"], F.lit(k)), F.lit(0).cast("bigint"))
    metric = lambda k: F.coalesce(F.element_at(r["diagnostics"]["parser_metrics"], F.lit(k)), F.lit(0.0))
    return flat.select(
        "report", "summary_total", "summary_passed", "summary_failed", "pos",
        r["profile_name"].alias("profile_name"), r["status"].alias("status"), r["reason"].alias("reason"),
        F.coalesce(r["passed"], F.lit(False)).alias("passed"),
        counter("empty_pages").alias("empty_pages"), counter("method_switches").alias("method_switches"),
        metric("scalar_ratio").alias("scalar_ratio"), metric("structured_ratio").alias("structured_ratio"),
    )


def read_jobs(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """One JSON snapshot per job and file (or per line); corrupt snapshots are left out."""
    schema = T.StructType([*JOB_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    raw = (
        spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    )
    return raw.filter(F.col("_corrupt").isNull() & F.col("id").isNotNull()).drop("_corrupt")


def read_progress_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, status, error) rows of a checkpoint map {id: {status, error}}."""
    raw = spark.read.option("wholetext", True).text(path)
    entries = raw.select(F.explode(F.from_json("value", "map<string,struct<status:string,error:string>>")).alias("id", "s"))
    return entries.select("id", F.col("s.status").alias("status"), F.col("s.error").alias("error"))


def read_enrichment_map(spark: SparkSession, path: str) -> DataFrame:
    """(slug, done, enrichment) rows of a checkpoint {done_slugs: [...], enrichments: {slug: {...}}}."""
    raw = spark.read.option("wholetext", True).text(path)
    parsed = raw.select(F.from_json("value", "done_slugs array<string>, enrichments map<string,map<string,string>>").alias("p"))
    done = parsed.select(F.explode("p.done_slugs").alias("slug")).distinct().withColumn("done", F.lit(True))
    rows = parsed.select(F.explode("p.enrichments").alias("slug", "enrichment"))
    return rows.join(done, "slug", "full_outer").withColumn("done", F.coalesce("done", F.lit(False)))


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, pos, loc) of stored sitemap documents; malformed documents have no rows."""
    raw = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_name").alias("source_file"))
    return raw.select("source_file", F.posexplode(sitemap_locs(F.col("value"))).alias("pos", "loc"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page corpus (page_id, url, html)."""
    return spark.read.parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request sheet exported as CSV: positional columns, rows without a number dropped, blanks filled."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).schema(
        T.StructType([T.StructField(c, T.StringType()) for c in REQUEST_COLUMNS])
    ).csv(path)
    text = lambda c: trim_ws(F.coalesce(F.col(c), F.lit("")))
    keep_space = ["date", "submitted_by", "country", "fields_wanted", "notes", "results_link", "completed_date", "processor_notes"]
    return raw.filter(clean_int("request_num").isNotNull() & (clean_int("request_num") != 0)).select(
        clean_int("request_num").alias("request_num"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in keep_space],
        *[text(c).alias(c) for c in ("source_type", "event_name", "url", "status")],
        F.coalesce(F.nullif(F.col("priority"), F.lit("")), F.lit("Normal")).alias("priority"),
        clean_int("companies_found").alias("companies_found"),
    )
