"""URL-frontier jobs: id ranges, robots rules, sitemaps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import trim_ws
from leadloom.functions.urls import expand_pages, extrapolate_pages, url_path
from leadloom.operators.ordered import carry_forward_group, keep_first, limit_items
from leadloom.session import cut_lineage


def id_range_frontier(done: DataFrame, first: int, last: int, key: str = "id") -> DataFrame:
    """Ids of a range that are not done yet."""
    ids = done.sparkSession.range(first, last + 1).withColumnRenamed("id", key)
    return ids.join(done.select(F.col(key).cast("bigint").alias(key)), key, "left_anti")


def page_frontier(plans: DataFrame, key: str, urls: str, total_hint: str, max_pages: int | None = None) -> DataFrame:
    """(key, pos, url) of all listing pages of each plan."""
    pages = expand_pages(urls, total_hint, max_pages)
    return plans.select(key, F.posexplode(pages).alias("pos", "url"))


def numbered_page_frontier(pagers: DataFrame, key: str, links: str) -> DataFrame:
    """(key, pos, url) of all pages behind a numbered pager."""
    ordered = F.array_sort(F.col(links))
    distinct = F.array_distinct(F.transform(ordered, lambda x: x["href"]))
    top = F.array_max(F.transform(ordered, lambda x: x["num"]))
    pages = F.when(top > F.size(distinct), extrapolate_pages(ordered, top)).otherwise(distinct)
    return pagers.select(key, F.posexplode(pages).alias("pos", "url"))


def robots_rules(robots: DataFrame, user_agent: str = "*") -> DataFrame:
    """(host, line_no, kind, value) of robots files: disallow and crawl_delay of our groups, all sitemaps."""
    lines = robots.select("host", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "raw")).select(
        "host", "line_no", trim_ws(F.regexp_replace("raw", r"#.*$", "")).alias("line")
    ).filter(F.col("line") != "")
    low = F.lower("line")
    value = trim_ws(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    agent = F.when(F.startswith(low, F.lit("user-agent:")), F.lower(value))
    # lines of one file come from one text value, so a window group is one document
    marked = carry_forward_group(lines.withColumn("_value", value), ["host"], ["line_no"], agent, "_agent", None)
    ours = F.coalesce(F.col("_agent").isin("*", user_agent.lower()), F.lit(False))
    kind = (
        F.when(F.startswith(low, F.lit("user-agent:")), F.lit(None).cast("string"))
        .when(ours & F.startswith(low, F.lit("disallow:")), F.lit("disallow"))
        .when(F.startswith(low, F.lit("sitemap:")), F.lit("sitemap"))
        .when(ours & F.startswith(low, F.lit("crawl-delay:")) & F.col("_value").try_cast("double").isNotNull(),
              F.lit("crawl_delay"))
    )
    fixed = F.when((kind == "sitemap") & F.startswith("_value", F.lit("//")), F.concat(F.lit("https:"), "_value")).otherwise(
        F.col("_value")
    )
    return marked.select("host", "line_no", kind.alias("kind"), fixed.alias("value")).filter(
        F.col("kind").isNotNull() & (F.col("value") != "")
    )


def filter_allowed(urls: DataFrame, rules: DataFrame, host: str = "host", url: str = "url") -> DataFrame:
    """URLs whose path starts with none of the disallow rules of their host (a trailing * is ignored).

    Rules are joined as keys: a distinct path is cut to the lengths that rules of its host have, and a cut that is a
    rule blocks it. The plan is the same for any number of rules. A URL without host or path is kept.
    """
    listed = rules.filter(F.col("kind") == "disallow").select(
        F.col("host").alias("_host"), F.regexp_replace("value", r"\*$", "").alias("_rule")
    ).distinct()
    sizes = listed.groupBy("_host").agg(F.collect_set(F.char_length("_rule")).alias("_sizes"))
    paths = urls.select(F.col(host).alias("_host"), url_path(url).alias("_path")).distinct()
    blocked = (
        paths.join(sizes, "_host")
        .select("_host", "_path", F.explode(F.transform("_sizes", lambda n: F.left(F.col("_path"), n))).alias("_rule"))
        .join(listed, ["_host", "_rule"], "left_semi")
        .select("_host", "_path").distinct()
    )
    return urls.join(blocked, (F.col(host) == F.col("_host")) & (url_path(url) == F.col("_path")), "left_anti")


def sitemap_locs(xml: Column) -> Column:
    """<loc> texts of a sitemap or sitemap index in document order; malformed XML -> empty."""
    well_formed = F.rlike(xml, F.lit(r"(?s)^\s*(?:<\?xml[^>]*\?>\s*)?<(?:\w+:)?(urlset|sitemapindex)\b.*</(?:\w+:)?\1>\s*$"))
    found = F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?loc>(.*?)</(?:\w+:)?loc>"), F.lit(1)), trim_ws)
    decoded = F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.when(F.coalesce(well_formed, F.lit(False)), F.filter(decoded, lambda u: u != "")).otherwise(
        F.array().cast("array<string>")
    )


def sitemap_frontier(
    sites: DataFrame, rules: DataFrame, sitemaps: DataFrame, index_levels: int | None = None,
    max_sitemaps: int | None = None, max_urls: int | None = None,
) -> DataFrame:
    """(host, doc_no, pos, url): page URLs of each site from its sitemaps, breadth first.

    Declared documents (or /sitemap.xml) are joined with the stored documents (url, xml), the documents that new
    ones list with them again, until no new document appears, or `index_levels` times. A document counts once per
    host, where it comes first, so that indexes may list each other. Each level is a table in the checkpoint
    folder. With `max_sitemaps` and `max_urls` only the first documents and URLs of a host are kept.
    """
    docs = cut_lineage(sitemaps.select(F.col("url").alias("_doc"), sitemap_locs(F.col("xml")).alias("locs")))
    declared = rules.filter(F.col("kind") == "sitemap").select(
        F.col("host").alias("_host"), F.col("line_no").cast("bigint").alias("_pos"), F.col("value").alias("_declared")
    )
    listed = sites.join(declared, F.col("host") == F.col("_host"), "left").select(
        "host",
        F.coalesce("_declared", F.concat("origin", F.lit("/sitemap.xml"))).alias("doc"),
        F.array(F.lit(0).cast("bigint"), F.coalesce("_pos", F.lit(0))).alias("path"),
    )
    is_map = lambda c: F.endswith(c, F.lit(".xml")) | F.endswith(c, F.lit(".xml.gz"))
    read = None
    for level in count():
        once = keep_first(listed, ["host", "doc"], ["path"])
        if read is not None:
            once = once.join(read.select("host", "doc"), ["host", "doc"], "left_anti")
        new = cut_lineage(once.join(docs, F.col("doc") == F.col("_doc")).select("host", "doc", "path", "locs"))
        if read is not None and new.isEmpty():
            break
        read = new if read is None else read.unionByName(new)
        if index_levels is not None and level >= index_levels:
            break
        # children sort after every document of their parent's level
        listed = new.select("host", "path", F.posexplode("locs").alias("_i", "doc")).filter(is_map("doc")).select(
            "host", "doc",
            F.concat(F.array(F.lit(level + 1).cast("bigint")), F.slice("path", F.lit(2), F.size("path")), F.array(F.col("_i").cast("bigint"))).alias("path"),
        )
    numbered = read.withColumn("doc_no", F.row_number().over(Window.partitionBy("host").orderBy("path")))
    if max_sitemaps is not None:
        numbered = numbered.filter(F.col("doc_no") <= max_sitemaps)
    urls = numbered.select("host", "doc_no", F.posexplode("locs").alias("pos", "url")).filter(~is_map("url"))
    return urls if max_urls is None else limit_items(urls, max_urls, ["doc_no", "pos"], ["host"])
