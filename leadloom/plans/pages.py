"""Queries over the page corpus: DOM, items, structured data, templates, selector quality, adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions.nested import map_to_text
from leadloom.functions.user_code import run_adapter, run_extractor
from leadloom.operators import classify as C
from leadloom.operators import pages as P
from leadloom.operators import sellers as S
from leadloom.operators.dom import page_dom, page_nodes, select, select_nodes, visible_text
from leadloom.plans import duck as D
from leadloom.plans.registry import query
from leadloom.sources.readers import read_pages

TARGET = P.Target(
    container="div.exhibitor-card",
    fields={"name": "h3.company-name", "country": "span.country", "booth": ".booth", "logo": "img.logo", "blank": " ", "broken": "h3:::bad"},
    attributes={"logo": "src"},
    detail_link="a.detail-link",
    id_selector="a.hall-map",
    id_regex=None,
)


@query("src8_read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def _(t):
    return read_pages(t.spark, f"{t.folder}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query("ht1_page_nodes", """SELECT page_id, CAST(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS n_li, CAST(len(regexp_extract_all(html, '<a[ >]')) AS BIGINT) AS n_a, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS n_p, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def _(t):
    n = page_nodes(t.pages)
    return n.groupBy("page_id").agg(
        F.count_if(F.col("tag") == "li").alias("n_li"), F.count_if(F.col("tag") == "a").alias("n_a"), F.count_if(F.col("tag") == "p").alias("n_p"),
        F.max(F.when(F.col("tag") == "html", F.col("attrs")["lang"])).alias("lang"),
    )


LINKS = """l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS txt FROM pages)"""


@query("ht2_select", f"WITH {LINKS} SELECT page_id, href, {D.trim('txt')} AS text FROM l WHERE href LIKE '/t%'")
def _(t):
    return select_nodes(page_dom(t.pages), "nav > ul li > a[href^='/t']").select("page_id", F.col("attrs")["href"].alias("href"), "text")


@query(
    "ht3_extract_items",
    """SELECT page_id, 0 AS item_idx, '_detail_api_id=fair24.' || CAST(100 + page_id AS VARCHAR) || '|blank=~|booth=Hall 5, Stand A' || CAST(page_id AS VARCHAR) || '|broken=~|country=' || n_name || '|detail_link=/e/' || CAST(page_id AS VARCHAR) || '|logo=/l.png|name=' || s_name AS item
      FROM {listing_pages} JOIN supplier ON page_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey UNION ALL
      SELECT page_id, 1, '_detail_api_id=~|blank=~|booth=~|broken=~|country=|detail_link=e/second|logo=~|name=Second ' || n_name FROM {listing_pages} JOIN supplier ON page_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
)
def _(t):
    return P.extract_items(page_dom(t.listing_pages), TARGET).select("page_id", "item_idx", map_to_text(F.col("item")).alias("item"))


@query("ht4_extract_detail_id", "SELECT page_id, 'fair24.' || CAST(100 + page_id AS VARCHAR) AS from_params, CAST(100 + page_id AS VARCHAR) AS from_regex, '1' AS from_attr, CAST(NULL AS VARCHAR) AS no_id FROM {listing_pages}")
def _(t):
    dom = page_dom(t.listing_pages)
    node = F.get(select("a.hall-map"), F.lit(0))
    card = F.get(select(".exhibitor-card"), F.lit(0))
    more = F.get(select(".list"), F.lit(0))
    return dom.select(
        "page_id", P.detail_id(node, None, None).alias("from_params"), P.detail_id(node, None, r"actionItem=(\d+)").alias("from_regex"),
        P.detail_id(card, "data-id", None).alias("from_attr"), P.detail_id(more, "data-none", None).alias("no_id"),
    )


@query(
    "ht5_detail_fields",
    "SELECT page_id, 'title: ' || cname || ' & Co' || chr(10) || 'seller: ' || cname || chr(160) || 'Ltd' || chr(10) || 'rating: Beoordeling: ' || CAST(page_id % 5 AS VARCHAR) || '.5 van de 5 sterren op basis van ' || CAST(page_id AS VARCHAR) || ' recensies' AS text FROM {detail_pages} WHERE page_id % 10 <> 9",
)
def _(t):
    fields = {"title": "h1", "meta_og": "meta", "seller": "p[data-test-id=seller-name]", "rating": "span", "cookie_note": "p", "none": ".absent", "empty": ""}
    out = P.detail_fields(page_dom(t.detail_pages), fields, {"rating": "aria-label"})
    return out.filter(~F.contains("text", F.lit("could not be found")))


@query(
    "ht6_json_ld",
    """SELECT page_id, 0 AS pos, 'Organization' AS type, cname AS name FROM {detail_pages} WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 0, 'WebPage', NULL FROM {detail_pages} WHERE page_id % 5 = 1 UNION ALL SELECT page_id, 1, '["Thing","Product"]', seg FROM {detail_pages} WHERE page_id % 5 = 1
      UNION ALL SELECT page_id, 0, 'Product', 'a' FROM {detail_pages} WHERE page_id % 5 = 2 UNION ALL SELECT page_id, 1, '[]', 'empty' FROM {detail_pages} WHERE page_id % 5 = 2""",
)
def _(t):
    return P.json_ld(t.detail_pages).select("page_id", "pos", F.get_json_object("object", "$['@type']").alias("type"), F.get_json_object("object", "$.name").alias("name"))


@query("ht7_open_graph", "SELECT page_id, 'og:title=' || cname || '|twitter:card=' || seg AS og FROM {detail_pages}")
def _(t):
    return P.open_graph(page_dom(t.detail_pages)).select("page_id", map_to_text(F.col("open_graph")).alias("og"))


MICRO = """SELECT s_suppkey AS page_id, s_name AS sname, n_name AS nname, '<body><div itemscope itemtype="https://schema.org/Organization"><h1 itemprop="name">' || s_name || '</h1><a itemprop="url" href="/s">x</a><div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><span itemprop="city">'
  || n_name || '</span><meta itemprop="country" content="' || n_name || '"></div><div itemscope><span itemprop="lost">z</span></div><span itemprop="tag">a</span><span itemprop="tag">b</span></div><p itemprop="stray">s</p></body>' AS html FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


def _micro_pages(t):
    return t.spark.sql(MICRO, supplier=t.wide("supplier"), nation=t.nation)


@query(
    "ht8_microdata",
    """WITH b AS (SELECT s_suppkey AS page_id, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT page_id, 'Organization' AS type, 'name' AS prop, s_name AS value, false AS nested FROM b UNION ALL SELECT page_id, 'Organization', 'url', '/s', false FROM b
      UNION ALL SELECT page_id, 'Organization', 'address', NULL, true FROM b UNION ALL SELECT page_id, 'PostalAddress', 'city', n_name, false FROM b UNION ALL SELECT page_id, 'PostalAddress', 'country', n_name, false FROM b UNION ALL SELECT page_id, 'Organization', 'tag', 'a', false FROM b UNION ALL SELECT page_id, 'Organization', 'tag', 'b', false FROM b""",
)
def _(t):
    m = P.microdata(page_dom(_micro_pages(t)))
    return m.select("page_id", "type", "prop", "value", F.col("value_scope").isNotNull().alias("nested"))


@query(
    "ht9_merge_structured",
    """WITH p AS (SELECT page_id, seg, cname, CASE page_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS n FROM {detail_pages}) SELECT seg, arg_min(n, page_id) FILTER (WHERE n > 0) AS n_json_ld, arg_min(cname, page_id) AS title FROM p GROUP BY seg""",
)
def _(t):
    og = page_dom(t.detail_pages, keep=("page_id", "seg", "html"))
    rows = P.open_graph(og.withColumn("k", F.struct("page_id", "seg", "html")), "k").select(
        "k.page_id", "k.seg", P.json_ld_objects(F.col("k.html")).alias("json_ld"), "open_graph"
    )
    merged = P.merge_structured(rows, "seg", ["page_id"], ["json_ld", "open_graph"])
    return merged.select("seg", F.size("json_ld").alias("n_json_ld"), F.col("open_graph")["og:title"].alias("title"))


EMBED = """SELECT s_suppkey AS page_id, '<body><div class="app" data-info=''{{"meta":{{"n":1}},"results":[{{"id":1,"name":"' || s_name || '","values":{{"website":"w","city":"c"}}}},{{"id":2,"name":"' || s_name || ' second company","values":{{"website":"w2"}}}}]}}''></div>'
  || '<script type="application/json">{{"items":[{{"a":"' || s_name || '"}},{{"a":"padding padding padding padding padding padding padding padding padding"}}]}}</script></body>' AS html FROM {supplier}"""


# lists that begin with entries without a hint
ADVERTS = """SELECT s_suppkey AS page_id, '<body><div class="app" data-info=''{{"meta":{{"n":1}},"results":[' || repeat('{{"x":1}},', CAST(s_suppkey % 15 AS INT)) || '{{"id":1,"name":"' || s_name || '","values":{{"website":"w","city":"c"}}}},{{"id":2,"name":"' || s_name || ' second company padding padding","values":{{"website":"w2"}}}}]}}''></div></body>' AS html FROM {supplier}"""


@query("ht10_embedded_source", "SELECT s_suppkey AS page_id, 72 + s_suppkey % 15 AS score, 'results' AS path, 'data-info' AS attribute, 2 + s_suppkey % 15 AS total, s_name || ' second company padding padding' AS last_name FROM supplier")
def _(t):
    pages = t.spark.sql(ADVERTS, supplier=t.wide("supplier"))
    best = P.embedded_source(page_dom(pages))
    wide = lambda c: F.col(c).cast("bigint").alias(c)
    return best.select("page_id", wide("score"), "path", "attribute", wide("total"), F.get_json_object(F.element_at("items", -1), "$.name").alias("last_name"))


@query(
    "ht11_score_long_lists",
    "WITH b AS (SELECT s_suppkey AS id, 2 + s_suppkey % 30 AS n FROM supplier) SELECT id, 30 + 30 + n + CASE WHEN n > 20 THEN 100 WHEN n > 5 THEN 50 ELSE 0 END AS score FROM b",
)
def _(t):
    bodies = t.wide("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("["), F.expr("repeat('{\"x\":1},', CAST(s_suppkey % 30 AS INT))"), F.lit('{"name":"'), "s_name", F.lit('","phone":"1"},{"name":"c"}]')).alias("body"))
    score = P.listing_api_score(F.lit("https://api.fair.example.com/exhibitor/list"), F.col("body"), F.lit("www.fair.example.com"))
    return bodies.select("id", score.cast("bigint").alias("score"))


@query(
    "ht10_embedded_items",
    """SELECT s_suppkey AS page_id, 0 AS pos, '1' AS id, s_name AS name, 'w' AS website, 'c' AS city FROM supplier
      UNION ALL SELECT s_suppkey, 1, '2', s_name || ' second company', 'w2', NULL FROM supplier""",
)
def _(t):
    rows = P.embedded_items(page_dom(t.spark.sql(EMBED, supplier=t.wide("supplier"))), "div.app", "data-info", "results")
    at = lambda k: F.col("item")[k]
    return rows.select("page_id", "pos", at("id").alias("id"), at("name").alias("name"), at("values.website").alias("website"), at("values.city").alias("city"))


@query(
    "ht11_score_api_responses",
    """SELECT id, 'detail' AS kind, CASE WHEN s5 = 0 OR id % 7 = 0 OR kind = 0 THEN -1000 ELSE 15 + CASE kind WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 22 END END AS score FROM (SELECT *, CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS s5 FROM {api_bodies}) UNION ALL
      SELECT id, 'listing', CASE WHEN id % 7 = 0 OR id % 5 = 0 THEN -1000 WHEN id % 5 = 1 THEN -500 ELSE CASE kind WHEN 0 THEN 20 + 30 + 2 WHEN 1 THEN 30 + 30 + 2 WHEN 2 THEN 10 + 30 + 1 ELSE -500 END END FROM {api_bodies}""",
)
def _(t):
    b = t.api_bodies
    detail = b.select("id", F.lit("detail").alias("kind"), P.detail_api_score(F.col("url"), F.col("body")).alias("score"))
    listing = b.select("id", F.lit("listing").alias("kind"), P.listing_api_score(F.col("url"), F.col("body"), F.lit("www.fair.example.com")).alias("score"))
    return detail.unionByName(listing)


@query("ht11_best_api_response", "SELECT name, kind AS k FROM (SELECT name, kind FROM {api_bodies} WHERE id % 7 <> 0 AND id % 5 <> 0 AND kind <> 0)")
def _(t):
    best = P.score_api_responses(t.api_bodies, "name", ["id"])
    return best.select("name", F.col("kind").alias("k"))


# pages without nested noise: what is removed can be written as patterns
SIMPLE = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _tag in ("script", "style", "noscript", "svg", "iframe", "header", "footer", "nav"):
    SIMPLE = rf"regexp_replace({SIMPLE}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', '', 'g')"
SHORT = r"regexp_replace(regexp_replace({}, '\n\s*\n', chr(10), 'g'), ' {{{{2,}}}}', ' ', 'g')"


@query("ht12_simplify_html", f"SELECT page_id, {SHORT.format(SIMPLE)} AS html FROM pages")
def _(t):
    return P.simplify_pages(t.pages)


BARE = rf"regexp_replace({SIMPLE}, '(?is)<head\b[^>]*>.*?</head>', '', 'g')"
BARE = rf"""regexp_replace({BARE}, '(?is)<img\b[^>]*?( alt="[^"]+")[^>]*>', '<img src="[removed]"\1>', 'g')"""


@query("ht12_simplify_html_aggressive", f"SELECT page_id, {SHORT.format(BARE)} AS html FROM pages")
def _(t):
    return P.simplify_pages(t.pages, aggressive=True)


NOISY = """SELECT s_suppkey AS page_id, '<html><head><title>' || s_name || '</title></head><body><nav>x<nav>y</nav>menu</nav><header>h</header><p>' || s_name || '</p><!-- c -->'
  || '<div class="a cookie-banner"><div>deep ' || s_name || '</div>We use</div><div id="cookie-consent">no</div><div class="ad-top"><div>in</div>ad</div><section><nav>open ' || n_name || '</section>'
  || '<img src="/x.png" alt="' || n_name || '" class="logo"><a href="javascript:go()" data-k="1" onclick="t()">l</a>   <em style="c">e</em><footer>f</footer></body></html>' AS html FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey"""


@query(
    "ht12_simplify_nested",
    """SELECT s_suppkey AS page_id,
      '<html><head><title>' || s_name || '</title></head><body><p>' || s_name || '</p><div class="ad-top"><div>in</div>ad</div><section></section><img src="/x.png" alt="' || n_name || '" class="logo"><a href="javascript:go()" data-k="1" onclick="t()">l</a> <em style="c">e</em></body></html>' AS plain,
      '<html><body><p>' || s_name || '</p><section></section><img src="[removed]" alt="' || n_name || '"><a href="#">l</a> <em>e</em></body></html>' AS aggressive
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _(t):
    pages = t.spark.sql(NOISY, supplier=t.wide("supplier"), nation=t.nation)
    plain = P.simplify_pages(pages).withColumnRenamed("html", "plain")
    return plain.join(P.simplify_pages(pages, aggressive=True).withColumnRenamed("html", "aggressive"), "page_id")


@query("ht13_visible_text", "SELECT page_id, cname || ' ' || CASE WHEN page_id % 10 = 9 THEN 'Unfortunately, the seller could not be found' ELSE cname || ' & Co' END || ' Office address: Street ' || CAST(page_id AS VARCHAR) || ' Back City ' || nname || ' VAT number NL' || CAST(100000000 + page_id AS VARCHAR) || 'B01 City ' || seg || ' Empty ' || cname || chr(160) || 'Ltd ' || nname || ' Phone: +31 (0)20 ' || CAST(page_id AS VARCHAR) || ' Fax: 020-' || CAST(page_id AS VARCHAR) || ' mail info@c' || CAST(page_id AS VARCHAR) || '.shop.nl or noreply@shop.nl 1 2 next' AS text FROM {detail_pages}")
def _(t):
    return page_dom(t.detail_pages).select("page_id", visible_text().alias("text"))


@query(
    "ht14_page_links",
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\\s+href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a\\s+href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS x FROM pages), e AS (SELECT page_id, h, x, unnest(range(0, len(h))) AS pos FROM l)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, h[pos + 1] AS href, x[pos + 1] AS text FROM e""".replace("\\\\", "\\"),
)
def _(t):
    return P.page_links(t.pages)


@query("ht15_max_page_number", "SELECT page_id, greatest(page_id % 9, 2) AS top FROM {detail_pages}")
def _(t):
    return t.detail_pages.select("page_id", P.max_page_number("html").alias("top"))


@query("ht15_numbered_links", "SELECT page_id, '1=/list?av_page=' || CAST(page_id % 9 AS VARCHAR) || '|2=/list?av_page=2' AS links FROM {detail_pages}")
def _(t):
    links = P.numbered_links(P.page_links(t.detail_pages))
    return links.select("page_id", F.array_join(F.transform("links", lambda l: F.concat(l["num"].cast("string"), F.lit("="), l["href"])), "|").alias("links"))


@query("ht16_dt_dd_pairs", "SELECT page_id, 'City=' || seg || '|Office address:=Street ' || CAST(page_id AS VARCHAR) || ' Back|VAT number=NL' || CAST(100000000 + page_id AS VARCHAR) || 'B01' AS pairs FROM {detail_pages}")
def _(t):
    return t.detail_pages.select("page_id", map_to_text(P.dt_dd_pairs("html")).alias("pairs"))


@query("ht17_by_test_id", "SELECT page_id, cname || ' Ltd' AS first, cname || ' Ltd;' || nname AS every, '' AS absent FROM {detail_pages}")
def _(t):
    return t.detail_pages.select(
        "page_id", P.by_test_id("html", "seller-name").alias("first"), F.array_join(P.all_by_test_id("html", "seller-name"), ";").alias("every"), P.by_test_id("html", "nothing").alias("absent")
    )


HASH = r"left(sha256(regexp_replace(regexp_replace(html, '>([^<]+)<', '><', 'g'), '\s[^>]*>', '>', 'g')), 16)"
HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query("ht18_structural_hash", f"SELECT page_id, {HASH} AS hash FROM pages")
def _(t):
    return t.pages.select("page_id", P.structural_hash("html").alias("hash"))


@query("ht19_template_clusters", f"SELECT {HOST} AS host, {HASH} AS hash, count(*) AS pages, min(url) AS sample_url FROM pages GROUP BY 1, 2")
def _(t):
    return P.template_clusters(t.pages)


def _rules(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(body, '(?i){p}') THEN '{n}'" for n, p in rules) + " END"


MARKS = ["wp-content/x", "cdn.shopify.com/a", "<div id=\"__next\">", "ng-app", "gatsby-chunk wix.com", "plain"]
MARK_SQL = "CASE page_id % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MARKS)) + " END"


@query(
    "ht20_fingerprint",
    f"""WITH p AS (SELECT page_id, html || {MARK_SQL} AS body FROM pages) SELECT page_id, {_rules(P.CMS_RULES)} AS cms, {_rules(P.SHOP_RULES)} AS ecommerce, CASE WHEN page_id % 4 = 1 THEN 'Next.js' ELSE {_rules(P.JS_RULES)} END AS js_framework, CASE page_id % 4 WHEN 0 THEN 'Cloudflare' WHEN 2 THEN 'Akamai' END AS cdn,
      CASE WHEN page_id % 4 = 3 THEN NULL ELSE 'nginx' END AS server, page_id % 4 = 3 OR regexp_matches(body, '(?i)/api/v\\d|/api/graphql|/graphql|__NEXT_DATA__|window\\.__INITIAL_STATE__|application/ld\\+json') AS has_api,
      regexp_matches(body, '(?i)<div\\s+id="(?:app|root|__next|__nuxt|___gatsby)"|ng-app|ng-version|data-reactroot|_reactRootContainer|__NEXT_DATA__|__NUXT__') AS is_spa FROM p""",
)
def _(t):
    k = F.col("page_id") % 4
    headers = F.map_filter(F.create_map(
        F.lit("server"), F.when(k != 3, F.lit("nginx/1.2")), F.lit("cf-ray"), F.when(k == 0, F.lit("x")), F.lit("via"), F.when(k == 2, F.lit("1.1 Akamai")),
        F.lit("x-powered-by"), F.when(k == 1, F.lit("Next.js 13")), F.lit("content-type"), F.when(k == 3, F.lit("application/json")),
    ), lambda a, b: b.isNotNull())
    rows = t.pages.withColumn("body", F.concat("html", F.expr(MARK_SQL)))
    return rows.select("page_id", P.fingerprint("body", headers).alias("f")).select("page_id", "f.*").drop("signals")


PIECES = r"regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)', 1), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->|</?[a-z][^>]*>', chr(1), 'g'), '\s*\x01[\s\x01]*', '', 'g')"
PLAIN = f"length(trim(replace(replace(replace(replace({PIECES}, '&amp;', '&'), '&copy;', 'c'), '&middot;', 'm'), '&nbsp;', ' ')))"


@query(
    "ht21_needs_rendering",
    f"SELECT page_id, contains(url, '#/') OR contains(url, '#!/') OR length(html) < 2000 OR contains(lower(html), '<noscript>') OR {D.any_of('lower(html)', P.SPA_STRONG)} OR ({D.any_of('lower(html)', P.SPA_WEAK)} AND {PLAIN} < 500) OR {PLAIN} < 200 AS needs_js FROM pages",
)
def _(t):
    return P.needs_rendering(t.pages)


@query("ht22_selector_metrics", "SELECT s_suppkey AS page_id, 3 AS container_count, 3 AS sampled_containers, 15 AS field_checks, 6 AS field_hits, round(6 / 15, 4) AS field_hit_ratio FROM supplier")
def _(t):
    return P.selector_metrics(page_dom(t.listing_pages), TARGET)


@query("ht23_content_score", "SELECT s_suppkey AS page_id, round(5 / 15, 6) AS content_score FROM supplier")
def _(t):
    return P.content_score(page_dom(t.listing_pages), TARGET).select("page_id", F.round("content_score", 6).alias("content_score"))


@query(
    "ht24_selector_verdict",
    """SELECT id, CASE WHEN n_pending > 0 AND n_records = 0 THEN 'all field selectors are empty' WHEN n_records < 3 THEN 'container selector matched only ' || CAST(n_records AS VARCHAR) WHEN s < 0.2 AND n_records > 0 THEN 'low hit ratio ' || format('{:.3f}', s)
      WHEN n_pending > 0 AND s / 2 < 0.3 THEN 'content test failed ' || format('{:.2f}', s / 2) END AS verdict FROM (SELECT *, coalesce(score, 1) AS s FROM {jobs})""",
)
def _(t):
    s, n = F.coalesce("score", F.lit(1.0)), F.col("n_records")
    return t.jobs.select("id", C.selector_verdict(F.col("n_pending"), n, n, s, s / 2).alias("verdict"))


@query(
    "ht25_is_shell_detail",
    "SELECT id, id % 3 = 0 AS junk_fields, id % 6 IN (0, 3) OR (id % 3 = 1 AND id % 6 = 0) AS shell FROM {hrefs} WHERE id % 3 <> 1 UNION ALL SELECT id, false, id_href LIKE '%showExhibitor%' FROM {hrefs} WHERE id % 3 = 1",
)
def _(t):
    k = F.col("id") % 3
    fields = F.when(k == 0, F.array(F.lit("meta_title"), F.lit("map_link"))).when(k == 2, F.array(F.lit("company_name"), F.lit("og_x")))
    return t.hrefs.select("id", (k == 0).alias("junk_fields"), C.is_shell_detail(F.col("id_href"), F.col("base"), fields).alias("shell"))


@query("ht26_detail_fields_or_generic", f"SELECT id, CASE WHEN id % 3 = 0 THEN 'name;email;cookie_x' ELSE '{';'.join(C.GENERIC_DETAIL_FIELDS)}' END AS fields FROM {{hrefs}}")
def _(t):
    k = F.col("id") % 3
    fields = F.when(k == 0, F.array(F.lit("name"), F.lit("email"), F.lit("cookie_x"))).when(k == 1, F.array(F.lit("name"), F.lit("meta_a"), F.lit("gdpr_b")))
    return t.hrefs.select("id", F.array_join(C.detail_fields_or_generic(fields), ";").alias("fields"))


# --- adapters ----------------------------------------------------------------------------

BQ = """SELECT c_custkey AS seller_id, c_name AS cname, c_mktsegment AS seg, n_name AS nname, 'https://shop/' || CAST(c_custkey AS STRING) AS url, '{{"data":{{"attributes":{{"corporateName":"' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ' ' || c_name || ' ' END || '","sellerName":"S ' || c_name || '","taxIdentificationNumber":"GB'
  || CAST(c_custkey AS STRING) || '","corporateContactInformation":{{"street1":"' || CASE WHEN c_custkey % 3 = 0 THEN 'tbc' ELSE 'Main 1' END || '","city":"' || CASE WHEN c_custkey % 3 = 0 THEN 'TBC' ELSE n_name END || '"}},"contactInformation":{{"street1":"Side 2","postCode":"' || CAST(c_custkey AS STRING) || '"}},"shippingCountry":null}}}}}}' AS body
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""


@query(
    "cl14_seller_from_api",
    """SELECT c_custkey AS seller_id, CASE WHEN c_custkey % 4 = 0 THEN 'S ' || c_name ELSE c_name END AS business_name, 'GB' || CAST(c_custkey AS VARCHAR) AS vat_number, CASE WHEN c_custkey % 3 = 0 THEN 'Side 2, ' || CAST(c_custkey AS VARCHAR) ELSE 'Main 1, ' || n_name END AS registered_address, '' AS shipped_from,
      'https://shop/' || CAST(c_custkey AS VARCHAR) AS source_url FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t):
    return S.seller_from_api(t.spark.sql(BQ, customer=t.wide("customer"), nation=t.nation))


@query(
    "cl14_seller_from_page",
    """SELECT page_id, cname || ' & Co' AS business_name, 'info@c' || CAST(page_id AS VARCHAR) || '.shop.nl' AS email, '' AS phone, page_id % 5 + 0.5::DOUBLE AS rating, 5::DOUBLE AS rating_out_of, page_id AS review_count, '' AS company_name, 'Street ' || CAST(page_id AS VARCHAR) || ' Back' AS address, '' AS zip_code, seg AS city, '' AS kvk_number,
      'NL' || CAST(100000000 + page_id AS VARCHAR) || 'B01' AS vat_number FROM {detail_pages} WHERE page_id % 10 <> 9""",
)
def _(t):
    return S.seller_from_page(t.detail_pages, "page_id")


@query(
    "cl14_seller_embedded",
    """SELECT c_custkey AS seller_id, 'Shop } { "' || c_name AS business_name, 'c' || CAST(c_custkey AS VARCHAR) || '@shop.example' AS email, c_custkey AS review_count, CASE WHEN c_custkey % 2 = 0 THEN 'Ede' ELSE '' END AS city FROM customer""",
)
def _(t):
    # braces and escaped quotes inside the texts of the embedded object
    key = F.col("c_custkey").cast("string")
    embedded = F.concat(
        F.lit('<html><script>{"x":1,"__typename":"GraphqlMarketplaceSeller","id":"'), key, F.lit('","name":"Shop } { \\"'), F.col("c_name"), F.lit('","rating":4.5,"visibleReviewsCount":'), key,
        F.lit(',"contactInfoForCustomers":{"email":"c'), key, F.lit('@shop.example","note":"}}"}},"y":{"optimizelyDataFile":1}}</script><h1>x</h1>'),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("<dl><dt>Plaats</dt><dd>Ede</dd></dl>")).otherwise(F.lit("")), F.lit("</html>"),
    )
    rows = t.wide("customer").select(F.col("c_custkey").alias("seller_id"), embedded.alias("html"))
    return S.seller_from_page(rows).select("seller_id", "business_name", "email", "review_count", "city")


def _parse_seller(raw, seller_id, url):
    if seller_id % 10 == 9:
        raise ValueError("no page")
    title = raw.split("<title>")[1].split("</title>")[0] if seller_id % 7 else ""
    return {"name": title, "id": seller_id, "tags": [url]}


@query(
    "ud1_run_adapter",
    "SELECT page_id, CASE WHEN page_id % 10 = 9 THEN 'error' WHEN page_id % 7 = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN page_id % 10 = 9 THEN 'no page' END AS error, CASE WHEN page_id % 10 <> 9 AND page_id % 7 <> 0 THEN cname END AS name FROM {detail_pages}",
)
def _(t):
    out = run_adapter(t.detail_pages, _parse_seller, lambda p: not p["name"], "page_id", "html", "url")
    return out.select("page_id", "status", "error", F.col("result")["name"].alias("name"))


def _page_titles(html):
    if "<title>" not in html:
        return None
    return [{"title": html.split("<title>")[1].split("</title>")[0], "n": 1}, {}, "x"]


@query("ud2_run_extractor", """SELECT page_id, CAST(0 AS BIGINT) AS item_idx, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, '1' AS n FROM pages WHERE contains(html, '<title>')""")
def _(t):
    out = run_extractor(t.pages, _page_titles)
    return out.select("page_id", "item_idx", F.col("item")["title"].alias("title"), F.col("item")["n"].alias("n"))
