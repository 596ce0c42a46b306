import json

import pytest
from pyspark.sql import functions as F

from leadloom.operators import dom as DM
from leadloom.operators import frontier as FR
from leadloom.operators import pages as P
from leadloom.plans.registry import BUILDS, Tables

CARD = """<html><body><div class="exhibitor-card" data-id="101"><h3 class="company-name">Acme <b>Corp</b></h3><span class="country">Germany</span>
<span class="booth">Hall 5, Stand A20</span><a class="detail-link" href="/exhibitors/acme-corp">Details</a>
<a class="hall-map" href="/hallplan?actionItem=101">Map</a><img class="logo" src="/acme.png"></div>
<div class="exhibitor-card big" data-id="102"><h3 class="company-name">Beta</h3><span class="country"></span><a class="detail-link" href="/exhibitors/beta">x</a></div>
<div class="exhibitor-card"><p></p></div></body></html>"""


def frame(spark, *htmls):
    return spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id long, html string")


def selected(spark, html, selector):
    return [r.text for r in DM.select_nodes(DM.page_dom(frame(spark, html)), selector).orderBy("idx").collect()]


def test_selectors(spark):
    html = '<div id="m" class="a b"><p>1</p><ul><li data-k="xyz">2<li>3</ul><section><p>4</p></section></div><p>5</p>'
    for sel, want in [
        ("p", ["1", "4", "5"]), ("#m > p", ["1"]), ("div p", ["1", "4"]), (".a.b section p", ["4"]), ("li", ["2", "3"]),
        ("[data-k]", ["2"]), ("li[data-k^='x'], section > p", ["2", "4"]), ("[data-k*=y]", ["2"]), ('[data-k$="z"]', ["2"]),
        ("[data-k=nope]", []), ("p:first-child", []), ("div >", []), ("", []), ("h3:::bad", []),
    ]:
        assert selected(spark, html, sel) == want, sel


def test_dom_text_and_raw(spark):
    html = "<body>a<script>var x = '<p>';</script><!-- c --><b> b&amp;c </b><br>d</body>"
    dom = DM.page_dom(frame(spark, html, None))
    assert [r.t for r in dom.orderBy("page_id").select(DM.visible_text().alias("t")).collect()] == ["a b&c d", ""]
    assert selected(spark, html, "script") == ["var x = '<p>';"]


def test_extract_items(spark):
    target = P.Target(
        ".exhibitor-card", {"name": ".company-name", "country": ".country", "logo": "img", "blank": "  ", "bad": "p:::x"}, {"logo": "src"},
        detail_link="a.detail-link", id_selector="a.hall-map", id_regex=r"actionItem=(\d+)",
    )
    rows = P.extract_items(DM.page_dom(frame(spark, CARD, "<html></html>")), target).orderBy("item_idx").collect()
    assert len(rows) == 2
    assert rows[0]["item"] == {"name": "Acme Corp", "country": "Germany", "logo": "/acme.png", "blank": None, "bad": None, "detail_link": "/exhibitors/acme-corp", "_detail_api_id": "101"}
    assert rows[1]["item"]["_detail_api_id"] is None and rows[1]["item"]["country"] == ""


def test_detail_id_keeps_raw_without_match(spark):
    dom = DM.page_dom(frame(spark, '<a data-x="77-b" href="/plain">t</a>'))
    node = F.get(DM.select("a"), F.lit(0))
    r = dom.select(P.detail_id(node, "data-x", r"q(\d+)").alias("a"), P.detail_id(node, None, None).alias("b"), P.detail_id(node, "data-x", r"(\d+)-(\w)").alias("c")).first()
    assert (r.a, r.b, r.c) == ("77-b", None, "77.b")


def test_json_ld(spark):
    block = lambda s: f'<script type="application/ld+json">{s}</script>'
    html = block('{"@graph":[{"@type":"Organization"},{"@type":"BreadcrumbList"},{"@type":"WebPage"}]}') + block("{bad") + block('[{"@type":"Product"},{"@type":null},{"x":1}]') + block('"text"')
    types = [json.loads(r.object).get("@type") for r in P.json_ld(frame(spark, html)).orderBy("pos").collect()]
    assert types == ["Organization", "WebPage", "Product", None]


def test_open_graph(spark):
    html = '<meta property="og:title" content="A"><meta property="og:title" content="B"><meta property="og:x" content=""><meta name="twitter:card" content="s"><meta name="other" content="z">'
    assert P.open_graph(DM.page_dom(frame(spark, html))).first().open_graph == {"og:title": "B", "twitter:card": "s"}


def test_microdata_nested(spark):
    html = """<div itemscope itemtype="https://schema.org/Organization"><span itemprop="name">Acme</span><div itemprop="address" itemscope itemtype="X"><meta itemprop="c" content="DE"></div>
    <div itemscope><i itemprop="lost">q</i></div></div><div itemscope itemtype="Y"><time itemprop="t" datetime="2024">now</time></div>"""
    got = {(r.type, r.prop, r.value, r.value_scope is not None) for r in P.microdata(DM.page_dom(frame(spark, html))).collect()}
    assert got == {("Organization", "name", "Acme", False), ("Organization", "address", None, True), ("X", "c", "DE", False), ("Y", "t", "2024", False)}


def test_embedded_source(spark):
    data = {"results": [{"id": i, "path": "p", "values": {"name": f"N{i}", "description": "d", "website": "w"}} for i in range(2)]}
    html = f"<app-list data-info='{json.dumps(data)}'></app-list>"
    r = P.embedded_source(DM.page_dom(frame(spark, html, "<p data-x='short'></p>"))).collect()
    assert len(r) == 1 and (r[0].path, r[0].total, r[0].tag, r[0].attribute) == ("results", 2, "app-list", "data-info")


def test_fingerprint(value):
    def run(html, **headers):
        h = {k.replace("_", "-"): v for k, v in headers.items()}
        return value(P.fingerprint("c", F.create_map(*[F.lit(x) for kv in h.items() for x in kv]) if h else None), c=html)

    assert run("/WP-content/x").cms == "WordPress" and run("cdn.shopify.com").ecommerce == "Shopify"
    r = run('<div id="__next">')
    assert r.js_framework == "Next.js" and r.is_spa
    assert run("<p ng-app>").js_framework == "Angular"
    r = run("salesforce x commerce /api/v2", cf_ray="1", server="nginx/1.25.3", x_powered_by="Next.js")
    assert (r.cdn, r.server, r.js_framework, r.ecommerce, r.has_api) == ("Cloudflare", "nginx", "Next.js", "Salesforce Commerce", True)
    assert run("<meta name='generator' content='Joomla! 4'>").cms == "Joomla"
    r = run("plain page squarespaceXcom")
    assert (r.cms, r.ecommerce, r.js_framework, r.cdn, r.is_spa, r.signals) == (None, None, None, None, False, [])


def test_simplify(spark):
    def run(html, **kw):
        return P.simplify_pages(spark.createDataFrame([(1, html)], "page_id int, html string"), **kw).first().html

    html = "<head><title>t</title></head><body><!-- x --><header>h</header><div class='ad-box'>ad<div>in</div></div><p data-x='1' onclick='y' style='z'>a  b</p><img src='data:1' alt='L'><address>keep</address><a href='javascript:x'>l</a></body>"
    basic = run(html)
    assert "<!--" not in basic and "header" not in basic and "ad<div>" in basic and "<p data-x='1' onclick='y' style='z'>a b</p>" in basic
    assert run(html, aggressive=True) == '<body><p>a b</p><img src="[removed]" alt="L"><address>keep</address><a href="#">l</a></body>'
    assert run("x" * 20, max_chars=10) == "x" * 10 + "\n<!-- TRUNCATED -->" and len(run("<p>" + "x" * 90_000)) == 90_003
    # nested noise goes whole; what is never closed ends with the element around it; stray end tags stay
    assert run("<nav>x<nav>y</nav>menu</nav><div class='b cookie-banner'><div>deep</div>c</div><p>k") == "<p>k"
    assert run("<div><nav>menu<p>one</p></div><p>two</p>") == "<div></div><p>two</p>"
    assert run("<body><div><nav>menu<p>one</p></div><p>two</p></body>", aggressive=True) == "<body><div></div><p>two</p></body>"
    assert run("a</i>b<br/><source src=x>c", aggressive=True) == "a</i>b<br/>c"
    assert run("<p>a &amp; &lt;b&gt; é\n\n \n日本</p><script>if (a<b) '</p>'</script>\n<i title='\"&quot;' data-a=1>x</i>", aggressive=True) == "<p>a &amp; &lt;b&gt; é\n日本</p>\n<i title=\"&quot;&quot;\">x</i>"
    assert run("") == run(None) == "" and run("<iframe><b>") == ""


def test_source_ranges(spark):
    html = "<!DOCTYPE html>\n<ul>\n<li>a<li class=x>b</ul><x-y>é<x-y>in</x-y></x-y><br>tail"
    row = DM.page_dom(spark.createDataFrame([(1, html)], "page_id int, html string"), source=True).first()
    assert "".join(p.text for p in row.pieces) == html
    got = [(n.tag, html[n.s0 : n.s1]) for n in row.nodes]
    assert got == [("ul", "<ul>\n<li>a<li class=x>b</ul>"), ("li", "<li>a"), ("li", "<li class=x>b"), ("x-y", "<x-y>é<x-y>in</x-y></x-y>"), ("x-y", "<x-y>in</x-y>"), ("br", "<br>")]
    assert all("".join(p.text for p in row.pieces[n.p0 : n.p1]) == html[n.s0 : n.s1] for n in row.nodes)


def test_nested_boxes_take_their_own_first_match(spark):
    import random

    rnd = random.Random(4)

    def tree(depth):
        return "".join(rnd.choice(["<b>{}</b>", "<div class='box'>{}</div>", "<i>{}</i>", "<b class='box'>{}</b>"]).format(tree(depth + 1) if depth < 5 else "t") for _ in range(rnd.choice([0, 1, 2, 3])))

    dom = DM.page_dom(spark.createDataFrame([(i, tree(0)) for i in range(40)] + [(99, None)], "page_id int, html string"))
    both = dom.withColumns({"f": DM.select("b"), "x": DM.select(".box")})
    slow = F.transform("x", lambda box: DM.first_inside(F.col("f"), box)["idx"])
    fast = F.transform(DM.first_inside_each(F.col("f"), F.col("x")), lambda n: n["idx"])
    rows = both.select(slow.alias("slow"), fast.alias("fast")).collect()
    assert all(r.slow == r.fast for r in rows) and sum(len(r.fast) for r in rows) > 100 and any(None in r.fast for r in rows)


def test_lists_score_by_all_their_items(spark):
    adverts, real = '{"x":1},' * 15, '{"name":"a","company":"b","city":"c"},{"name":"d","email":"e","phone":"f"}'
    html = f"<div data-info='[{adverts}{real}]'></div>" + " " * 100
    dom = DM.page_dom(spark.createDataFrame([(1, html)], "page_id int, html string"))
    assert [(r.score, r.total) for r in P.embedded_source(dom).collect()] == [(60 + 17, 17)]
    assert P.embedded_source(dom, scored_items=5).count() == 0
    score = lambda **kw: spark.range(1).select(P.listing_api_score(F.lit("https://h/x"), F.lit(f"[{adverts}{real}]"), F.lit("h"), **kw).alias("s")).first().s
    assert score() - score(scored_items=5) == 60


def test_needs_rendering(spark):
    body = "<p>" + "word " * 600 + "</p>"
    pages = spark.createDataFrame([
        (0, "https://a/#/x", f"<body>{body}</body>"), (1, "https://a", f"<body>{body}</body>"), (2, "https://a", "<body>short</body>"),
        (3, "https://a", f'<body><div id="app"></div><!--{"x" * 3000}--></body>'), (4, "https://a", f"<body>{body}<my-app>{'y' * 600}</my-app></body>"),
        (5, "https://a", f"<body>{body}<my-app>tiny</my-app></body>"), (6, "https://a", f"<body><p ng-app></p>{body}</body>"), (7, "https://a", f"<body><div>{body}<x-y>{'y' * 600}</x-y></div></body>"),
        # the element's own end counts, wherever an equal tag begins or ends
        (8, "https://a", f"<body>{body}<x-y><x-y>a</x-y>{'y' * 600}</x-y></body>"), (9, "https://a", f"<body><p><x-y>a</x-y></p>{body}<x-y>b</x-y></body>"),
    ], "page_id long, url string, html string")
    got = {r.page_id: r.needs_js for r in P.needs_rendering(pages).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: True, 9: False}


def test_selector_quality(spark):
    good = P.Target(".exhibitor-card", {"name": "h3", "country": ".country"})
    bad = P.Target(".exhibitor-card", {"name": ".none", "logo": "em"})
    dom = DM.page_dom(frame(spark, CARD))
    m = P.selector_metrics(dom, good).first()
    assert (m.container_count, m.field_checks, m.field_hits, m.field_hit_ratio) == (3, 6, 4, 0.6667)
    assert P.selector_metrics(dom, bad).first().field_hit_ratio == 0.0
    assert P.content_score(dom, good).first().content_score == 0.5
    assert P.content_score(dom, P.Target(".zzz", {"a": "p"})).first().content_score == 1.0


def test_sitemap_frontier(spark):
    sites = spark.createDataFrame([("h", "https://h"), ("g", "https://g")], "host string, origin string")
    rules = FR.robots_rules(spark.createDataFrame([("h", "User-agent: x\nDisallow: /no\nSitemap: https://h/i.xml")], "host string, text string"))
    loc = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    docs = spark.createDataFrame([
        ("https://h/i.xml", "<sitemapindex>" + "".join(f"<sitemap><loc>https://h/{n}.xml</loc></sitemap>" for n in ["i", "a", "b", "missing", "c", "d", "e"]) + "</sitemapindex>"),
        ("https://h/a.xml", loc("https://h/1", "https://h/2", "https://h/deep.xml")), ("https://h/b.xml", loc("https://h/3")), ("https://h/c.xml", "<urlset><url>"),
        ("https://h/d.xml", loc("https://h/4")), ("https://h/e.xml", loc("https://h/5")), ("https://h/deep.xml", loc("https://h/6")),
        ("https://g/sitemap.xml", loc("https://g/1")),
    ], "url string, xml string")
    got = [(r.host, r.url) for r in FR.sitemap_frontier(sites, rules, docs, max_sitemaps=5).orderBy("host", "doc_no", "pos").collect()]
    # five documents per site: index, a, b, c (malformed), d
    assert got == [("g", "https://g/1"), ("h", "https://h/1"), ("h", "https://h/2"), ("h", "https://h/3"), ("h", "https://h/4")]
    every = [r.url for r in FR.sitemap_frontier(sites, rules, docs).filter("host = 'h'").orderBy("doc_no", "pos").collect()]
    assert every == [f"https://h/{i}" for i in range(1, 7)]
    few = FR.sitemap_frontier(sites, rules, docs, max_urls=2).groupBy("host").count().collect()
    assert {r.host: r["count"] for r in few} == {"g": 1, "h": 2}


def test_sitemaps_are_followed_to_any_depth(spark):
    sites = spark.createDataFrame([("h", "https://h"), ("z", "https://z")], "host string, origin string")
    rules = FR.robots_rules(spark.createDataFrame([("h", "")], "host string, text string"))
    u = lambda n: f"https://h/{n}"
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    chain = [(u("sitemap.xml"), index(u("1.xml")))] + [(u(f"{i}.xml"), index(u("sitemap.xml"), u(f"{i + 1}.xml"), u(f"p{i}"), u("4.xml"))) for i in range(1, 7)]
    docs = spark.createDataFrame([*chain, (u("7.xml"), index(u("7.xml"), u("end")))], "url string, xml string")
    rows = FR.sitemap_frontier(sites, rules, docs).orderBy("doc_no", "pos").collect()
    # the fourth index is listed by the first already
    assert [(r.doc_no, r.url) for r in rows] == [(2, u("p1")), (3, u("p2")), (4, u("p4")), (5, u("p3")), (6, u("p5")), (7, u("p6")), (8, u("end"))]
    assert [r.url for r in FR.sitemap_frontier(sites, rules, docs, index_levels=2).orderBy("doc_no").collect()] == [u("p1"), u("p2"), u("p4")]
    assert FR.sitemap_frontier(sites, rules, docs.limit(0)).count() == 0


def test_robots(spark):
    text = "User-agent: Other\nDisallow: /x\r\nUser-agent: *\nDisallow: /admin/ # c\nDisallow: /tmp*\nCrawl-delay: 2\nSitemap: //h/s.xml"
    rules = FR.robots_rules(spark.createDataFrame([("h", text)], "host string, text string"))
    assert [(r.kind, r.value) for r in rules.orderBy("line_no").collect()] == [("disallow", "/admin/"), ("disallow", "/tmp*"), ("crawl_delay", "2"), ("sitemap", "https://h/s.xml")]
    urls = spark.createDataFrame([("h", "https://h/admin/settings"), ("h", "https://h/tmp/f"), ("h", "https://h/ok"), ("z", "https://z/admin/")], "host string, url string")
    assert sorted(r.url for r in FR.filter_allowed(urls, rules).collect()) == ["https://h/ok", "https://z/admin/"]


def test_allowed_urls_with_many_rules(spark):
    values = [f"/shop/{i}/" for i in range(0, 50_000, 2)] + ["/tmp*", "/a**", "/ä/*", "/long/" + "x" * 50]
    rules = spark.createDataFrame([("h", "disallow", v) for v in values] + [("all", "disallow", ""), ("z", "sitemap", "/ok")], "host string, kind string, value string")
    paths = [f"/shop/{i}/p" for i in range(300)] + ["/tmp", "/tmpfile", "/tm", "/a", "/a*b", "/ä/ö", "/long/" + "x" * 49, "", "/shop/2"]
    urls = [(h, f"https://{h}{p}", n) for h in ("h", "z", "all") for n, p in enumerate(paths)] + [(None, "https://h/tmp", 0), ("h", None, 0), ("h", "https://h/ok", 1), ("h", "https://h/ok", 1)]
    table = spark.createDataFrame(urls, "host string, url string, _rule int")
    heads = tuple(v[:-1] if v.endswith("*") else v for v in values)
    stays = lambda h, u: h == "z" or None in (h, u) or (h == "h" and not u[len("https://h"):].startswith(heads))
    got = FR.filter_allowed(table, rules)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((r for r in urls if stays(*r[:2])), key=key)
    assert FR.filter_allowed(table, rules.limit(0)).count() == len(urls)
    assert FR.filter_allowed(table.limit(0), rules).count() == 0


def test_fingerprint_signals(spark):
    pages = [
        (1, "<link href=/wp-content/x><meta name='generator' content='WordPress 6'>", {"server": "nginx/1.25", "cf-ray": "x"}),
        (2, '<div id="__next">', {"x-powered-by": "Express"}),
        (3, "<html ng-app><a href=/api/v2/x>", {"x-powered-by": "Next.js", "via": "1.1 akamai", "content-type": "application/json"}),
        (4, "plain", {}),
    ]
    df = spark.createDataFrame(pages, "id int, html string, headers map<string,string>")
    got = {r.id: r.f for r in df.select("id", P.fingerprint("html", F.col("headers")).alias("f")).collect()}
    assert got[1].signals == ["Server: nginx/1.25", "CDN: Cloudflare (cf-ray)", "CMS signal: WordPress", "Generator: WordPress 6"]
    assert got[2].signals == [
        "X-Powered-By: Express", "Node/Express backend detected", "JS framework signal: Next.js", 'SPA marker: <div\\s+id="(?:app|root|__next|__nuxt|___',
    ]
    assert got[3].signals == [
        "CDN: Akamai", "X-Powered-By: Next.js", "API evidence: Content-Type=application/json", "JS framework signal: Angular",
        "SPA marker: ng-app|ng-version", "API evidence in HTML: /api/v\\d|/api/graphql|/graphql",
    ]
    assert got[4].signals == [] and not got[4].is_spa and not got[4].has_api and got[2].is_spa


def test_embedded_items_of_a_known_source(spark):
    html = """<x-list data-info='{"results":[{"id":"1","path":"/acme","values":{"name":"Acme","n":null}},7,{"id":"2"}]}'>t</x-list><script id="s">{"a":{"b":1}}</script>"""
    dom = DM.page_dom(spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id int, html string"))
    rows = P.embedded_items(dom, "x-list", "data-info", "results").orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.item) for r in rows] == [(1, 0, {"id": "1", "path": "/acme", "values.name": "Acme", "values.n": None}), (1, 1, {"id": "2"})]
    assert [r.item for r in P.embedded_items(dom, "#s", None, None).collect()] == [{"a.b": "1"}]
    assert P.embedded_items(dom, "x-list", "data-info", "nothing.here").count() == 0


@pytest.mark.parametrize("name", [
    "ht5_detail_fields", "ht7_open_graph", "ht13_visible_text", "cl14_seller_embedded", "cl14_seller_from_page", "cl14_seller_from_api",
])
def test_pages_are_made_and_read_by_all_cores(spark, name):
    # the dimension is one small file: its rows are dealt out before they become pages, and nothing that reads pages is done before
    df = BUILDS[name](Tables(spark, "/root/testdata/sf0.001"))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition"):]
    assert "aggregate" not in below and "regexp" not in below and "ArrowBatches" not in below


def test_structured_data_is_read_by_all_cores(spark):
    plan = BUILDS["ht9_merge_structured"](Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Repartition")
