"""Lead-data views over the given tables, in SQL that Spark and the SQL oracle both accept.

`{table}` names a given table or another view. The text stays within the common dialect:
no regular expressions, no backslashes, no double-to-text casts.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    # company mentions in arrival order
    "leads": """
        SELECT o_orderkey AS ord, o_orderdate AS seen_at, c_custkey AS cust, c_mktsegment AS job,
          CASE o_orderkey % 3 WHEN 0 THEN replace(c_name, '#', ' #')
            WHEN 1 THEN '  ' || upper(replace(c_name, '#', ' #')) || ' '
            ELSE replace(c_name, '#', ' ' || chr(9) || ' #') END AS name,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE n_name END AS country,
          CASE WHEN o_orderkey % 13 = 0 THEN ' none ' ELSE c_mktsegment END AS city,
          CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority || ' Street' END AS address,
          CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE lpad(CAST(c_custkey AS STRING), 5, '0') END AS postal_code,
          CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'www.c' || CAST(c_custkey AS STRING) || '.example.com'
            ELSE 'https://www.c' || CAST(c_custkey AS STRING) || '.example.com' END AS website,
          CASE WHEN o_orderkey % 9 = 4 THEN 'https://shop.example.net/' || CAST(c_custkey AS STRING) ELSE '' END AS store_url,
          CASE WHEN o_orderkey % 3 = 1 THEN NULL WHEN o_orderkey % 8 = 0 THEN '  '
            ELSE 'sales@c' || CAST(c_custkey AS STRING) || '.example.org' END AS email,
          CASE WHEN o_orderkey % 4 = 1 THEN 'nan' ELSE '+49 30 ' || CAST(o_custkey AS STRING) END AS phone,
          CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_orderpriority || ' order by ' || c_name END AS description,
          CASE WHEN o_orderkey % 10 = 3 THEN 'Market ' || o_orderstatus END AS marketplace_name,
          CASE WHEN o_orderkey % 2 = 0 THEN 'E' || CAST(o_custkey % 100 AS STRING) END AS booth,
          CASE WHEN o_orderkey % 2 = 0 THEN CAST(c_nationkey AS STRING) END AS hall,
          CASE WHEN o_orderkey % 12 = 0 THEN 'https://img.example.com/' || CAST(c_custkey AS STRING) || '.png' END AS logo_url,
          'https://fair.example.com/list?page=' || CAST(o_custkey % 20 AS STRING) AS source_url,
          CASE WHEN o_orderkey % 3 = 0 THEN lower(c_mktsegment) || ' ; ' || o_orderpriority ELSE '' END AS cats_text,
          CASE WHEN o_orderkey % 4 = 0 THEN 'Brand' || o_orderstatus || '; ' || n_name END AS brands_text,
          CASE WHEN o_orderkey % 5 < 2 THEN 'https://linkedin.com/company/c' || CAST(c_custkey AS STRING) END AS social_linkedin,
          CASE WHEN o_orderkey % 6 = 1 THEN ' NaN ' WHEN o_orderkey % 6 = 2 THEN ' https://facebook.com/c' || CAST(c_custkey AS STRING) || ' ' END AS social_facebook,
          CASE WHEN o_orderkey % 7 = 3 THEN 'none' WHEN o_orderkey % 7 = 5 THEN o_orderstatus END AS extra_status
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    # exhibitor and seller facts
    "facts": """
        SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, s_name AS company, p_brand AS event, CAST(year(l_shipdate) AS INT) AS year,
          CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_linestatus || CAST(l_linenumber AS STRING) END AS stand,
          CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'H' || CAST(p_size % 10 AS STRING) END AS hall,
          CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE p_type END AS product_categories,
          CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE p_name END AS brands,
          CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE 'https://ev.example.com/' || CAST(l_partkey AS STRING) END AS detail_url,
          p_type AS marketplace, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey AS STRING) || '-' || l_returnflag END AS seller_id,
          CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax * 50 END AS rating,
          CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE CAST(5 AS DOUBLE) END AS rating_out_of,
          CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS review_count,
          CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE 'NL' || CAST(l_partkey AS STRING) END AS vat_number,
          CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 'K' || CAST(l_partkey AS STRING) END AS kvk_number,
          CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_returnflag END AS shipped_from,
          s_suppkey AS suppkey
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey""",
    # event mentions, some without a year
    "event_mentions": """
        SELECT o_orderkey AS ord, CASE o_orderkey % 2 WHEN 0 THEN 'Fair ' || c_mktsegment ELSE ' FAIR  ' || c_mktsegment || ' ' END
            || CAST(c_custkey % 40 AS STRING) AS name,
          CASE WHEN o_orderkey % 17 = 16 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE n_name END AS city, o_orderpriority AS country,
          CASE WHEN o_orderkey % 4 = 0 THEN 'https://fair.example.com/' || o_orderstatus END AS website
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    # financial mentions
    "financials": """
        SELECT o_orderkey AS ord, c_name AS company,
          CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS year,
          CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS source,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS total_gmv_eur,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice / 2 END AS growth_yoy,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice * 4 END AS total_annual_revenue,
          CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 1000 END AS rank_global,
          CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey % 500 END AS rank_filtered,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS confidence,
          CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_custkey END AS buyers
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # raw import sheet of a marketplace, all text
    "seller_sheet": """
        SELECT o_orderkey AS ord, CAST(o_custkey AS STRING) AS sellerId,
          CASE o_orderkey % 9 WHEN 0 THEN 'Seller Not Found' WHEN 1 THEN 'x' WHEN 2 THEN ' ' WHEN 3 THEN 'unknown vendor' ELSE c_name END AS businessName,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Street ' || CAST(o_custkey AS STRING) END AS address,
          'Registered ' || CAST(c_nationkey AS STRING) AS registeredAddress,
          CASE WHEN o_orderkey % 5 = 0 THEN 'nan' ELSE CAST(c_custkey AS STRING) END AS zipCode,
          CASE o_orderkey % 6 WHEN 0 THEN 'abc' WHEN 1 THEN ' 4.5 ' WHEN 2 THEN 'NaN' WHEN 3 THEN '1e1' WHEN 4 THEN 'inf' ELSE CAST(o_orderkey % 5 AS STRING) END AS rating,
          CASE o_orderkey % 5 WHEN 0 THEN '12.9' WHEN 1 THEN '-3.7' WHEN 2 THEN '' ELSE CAST(o_custkey AS STRING) END AS reviewCount,
          CASE WHEN o_orderkey % 3 = 0 THEN 'NL ' || CAST(1000000000 + o_custkey AS STRING) WHEN o_orderkey % 3 = 1 THEN 'AB' ELSE CAST(o_custkey AS STRING) || '-12345678' END AS vatNumber,
          CASE WHEN o_orderkey % 40 = 39 THEN 'rare' ELSE 'N/A' END AS sparse_tokens,
          CASE WHEN o_orderkey % 50 = 49 THEN 'rare' END AS sparse_nulls,
          CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN 'kept' ELSE '' END AS half_half
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # API items as JSON text
    "api_items": """
        SELECT p_partkey AS id, p_brand AS job, '{{"id":"' || CAST(p_partkey AS STRING) || '","values":{{"name":"' || p_name || '","size":' || CAST(p_size AS STRING)
          || ',"active":' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || ',"geo":{{"lat":1.5,"zip":"' || CAST(p_size AS STRING) || '"}}}},"contact":{{"email":'
          || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"info@p' || CAST(p_partkey AS STRING) || '.example.org"' END || '}},"tags":["' || p_type || '","' || p_brand || '"],"note":"'
          || CASE WHEN p_partkey % 4 = 0 THEN '[x] odd' ELSE p_type END || '","updatedAt":"2024"}}' AS body,
          p_name AS name, p_type AS type, p_brand AS brand, p_size AS size
        FROM {part}""",
    # API bodies that hold lists under different keys
    "api_bodies": """
        SELECT s_suppkey AS id, s_name AS name, s_suppkey % 4 AS kind,
          CASE s_suppkey % 4
            WHEN 0 THEN '[{{"name":"' || s_name || '"}},{{"name":"b"}},5]'
            WHEN 1 THEN '{{"total":2,"results":[{{"name":"' || s_name || '","phone":"1"}},{{"name":"c"}}]}}'
            WHEN 2 THEN '{{"page":{{"items":[{{"company":"' || s_name || '"}}]}}}}'
            ELSE '{{"company":"' || s_name || '","city":"B"}}' END AS body,
          'https://' || CASE WHEN s_suppkey % 5 = 0 THEN 'www.google-analytics.com' WHEN s_suppkey % 5 = 1 THEN 'other.example.org' ELSE 'api.fair.example.com' END
            || CASE WHEN s_suppkey % 7 = 0 THEN '/tracking' ELSE '/exhibitor/list' END AS url
        FROM {supplier}""",
    # detail pages with definition lists, test ids and structured data
    "detail_pages": """
        SELECT c_custkey AS page_id, c_name AS cname, n_name AS nname, c_mktsegment AS seg, 'https://shop.example.com/seller/' || CAST(c_custkey AS STRING) AS url,
          '<html><head><title>' || c_name || '</title><meta property="og:title" content="' || c_name || '"/><meta name="twitter:card" content="' || c_mktsegment || '">'
          || '<script type="application/ld+json">' || CASE c_custkey % 5
              WHEN 0 THEN '{{"@type":"Organization","name":"' || c_name || '"}}'
              WHEN 1 THEN '{{"@graph":[{{"@type":"WebPage","url":"/w"}},{{"@type":"BreadcrumbList"}},{{"@type":["Thing","Product"],"name":"' || c_mktsegment || '"}}]}}'
              WHEN 2 THEN '[{{"@type":"Product","name":"a"}},{{"name":"untyped"}},{{"@type":[],"name":"empty"}}]'
              WHEN 3 THEN '{{broken' ELSE '{{"@type":"BreadcrumbList"}}' END || '</script></head><body>'
          || '<h1>' || CASE WHEN c_custkey % 10 = 9 THEN 'Unfortunately, the seller could not be found' ELSE c_name || ' &amp; Co' END || '</h1>'
          || '<span aria-label="Beoordeling: ' || CAST(c_custkey % 5 AS STRING) || '.5 van de 5 sterren op basis van ' || CAST(c_custkey AS STRING) || ' recensies"></span>'
          || '<dl><dt>Office address:</dt><dd>Street ' || CAST(c_custkey AS STRING) || '<br>Back</dd><dt>City</dt> <dd> ' || n_name || ' </dd>'
          || '<dt>VAT number</dt><dd>NL' || CAST(100000000 + c_custkey AS STRING) || 'B01</dd><dt>City</dt><dd>' || c_mktsegment || '</dd><dt>Empty</dt><dd> </dd></dl>'
          || '<p data-test-id="seller-name" class="x">' || c_name || '&nbsp;Ltd</p><p data-test-id="seller-name">' || n_name || '</p><p data-test-id="other"> </p>'
          || '<div class="contact">Phone: +31 (0)20 ' || CAST(c_custkey AS STRING) || ' Fax: 020-' || CAST(c_custkey AS STRING) || ' mail info@c' || CAST(c_custkey AS STRING) || '.shop.nl or noreply@shop.nl</div>'
          || '<a href="/list?av_page=' || CAST(c_custkey % 9 AS STRING) || '">1</a><a href="/list?av_page=2">2</a><a href="/x">next</a></body></html>' AS html
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # listing pages with item cards
    "listing_pages": """
        SELECT s_suppkey AS page_id, 'https://fair.example.com/list?page=' || CAST(s_suppkey AS STRING) AS url,
          '<html><body><div class="list"><div class="exhibitor-card" data-id="1"><h3 class="company-name">' || s_name || '</h3><span class="country">' || n_name
          || '</span><span class="booth">Hall 5, Stand A' || CAST(s_suppkey AS STRING) || '</span><a class="detail-link" href="/e/' || CAST(s_suppkey AS STRING)
          || '">more</a><a class="hall-map" href="/hallplan?actionItem=' || CAST(100 + s_suppkey AS STRING) || '&amp;_event=fair24">map</a><img class="logo" src="/l.png"></div>'
          || '<div class="exhibitor-card"><h3 class="company-name">Second ' || n_name || '</h3><span class="country"></span><a class="detail-link" href="e/second">more</a></div>'
          || '<div class="exhibitor-card"><p>nothing</p></div></div></body></html>' AS html
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    # HTTP response headers
    "responses": """
        SELECT event_id AS id, 'https://api.example.com/items?page=' || CAST(user_id AS STRING) AS url, event_type AS kind, user_id AS n,
          CASE event_type WHEN 'click' THEN 'Application/JSON; charset=utf-8' WHEN 'view' THEN 'text/html' WHEN 'error' THEN NULL ELSE 'text/plain' END AS content_type,
          CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'W/' || CAST(event_id AS STRING) END AS etag,
          CASE WHEN user_id % 4 = 0 THEN 'soon' WHEN user_id % 4 = 1 THEN CAST(user_id AS STRING) WHEN user_id % 4 = 2 THEN '2.5' END AS retry_after,
          CASE WHEN user_id % 5 = 0 THEN 'many' WHEN user_id % 5 = 1 THEN CAST(user_id AS STRING) END AS rate_a,
          CASE WHEN user_id % 2 = 0 THEN CAST(event_id % 100 AS STRING) END AS rate_b,
          '<https://api.example.com/items?page=' || CAST(user_id + 1 AS STRING) || '>; rel="next", <https://api.example.com/items?page=1>;rel="first", broken' AS link
        FROM {events}""",
    # page-by-page progress of crawl attempts
    "progress": """
        SELECT event_id AS ord, ts, user_id AS job, CASE event_type WHEN 'signup' THEN 'method_fallback' ELSE 'scraping_pages' END AS stage,
          CASE WHEN event_type IN ('error', 'view') THEN 0 WHEN event_type = 'click' AND user_id % 4 = 0 THEN -1 ELSE CAST(floor(value) AS BIGINT) END AS page_items,
          event_type AS kind, value
        FROM {events}""",
    # model calls with cost figures
    "calls": """
        SELECT event_id AS ord, ts, user_id AS job, CASE WHEN user_id % 3 = 0 THEN 'other' ELSE 'openai' END AS provider,
          CASE event_type WHEN 'click' THEN 'css' WHEN 'view' THEN 'auto' ELSE event_type END AS method, event_type = 'error' AS failed,
          CASE WHEN event_type = 'purchase' THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS input_tokens,
          CASE WHEN event_type = 'signup' THEN NULL ELSE event_id % 977 END AS output_tokens,
          CASE WHEN event_type IN ('click', 'view', 'error') THEN NULL ELSE CAST(event_id % 31 AS DOUBLE) / 1000 END AS estimated_cost_usd
        FROM {events}""",
    # results of daily runs, one row per profile and event
    "run_results": """
        SELECT 'smoke-' || substr(CAST(CAST(ts AS DATE) AS STRING), 1, 10) AS report, event_id AS ord,
          CASE WHEN user_id % 50 = 0 THEN '' ELSE 'profile-' || CAST(user_id AS STRING) END AS profile_name,
          CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'partial' ELSE 'completed' END AS status,
          CASE WHEN event_type = 'error' AND user_id % 4 = 0 THEN ' ' WHEN event_type = 'error' THEN 'record_count ' || CAST(user_id % 6 AS STRING) ELSE 'ok' END AS reason,
          event_type <> 'error' AS passed, CAST(floor(value) AS BIGINT) % 7 AS empty_pages, user_id % 3 AS method_switches,
          CAST(event_id % 8 AS DOUBLE) / 8 AS scalar_ratio, CAST(user_id % 4 AS DOUBLE) / 4 AS structured_ratio
        FROM {events}""",
    # crawl jobs
    "jobs": """
        SELECT o_orderkey AS id, o_orderdate AS created_at, c_name AS name,
          CASE o_orderkey % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'planning' WHEN 2 THEN 'plan_review' WHEN 3 THEN 'preview' WHEN 4 THEN 'scraping'
            WHEN 5 THEN 'parsing' WHEN 6 THEN 'output' WHEN 7 THEN 'completed' ELSE 'failed' END AS status,
          CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 4 ELSE 0 END AS n_pending,
          CASE WHEN o_orderkey % 5 = 0 THEN 'old error' END AS error,
          CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) / 100 END AS score,
          o_custkey % 7 AS n_records, o_orderpriority AS method, o_orderstatus AS st
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # request sheet rows
    "requests": """
        SELECT o_orderkey AS request_num, CASE WHEN o_orderstatus = 'O' THEN 'New' WHEN o_orderstatus = 'F' THEN 'Done' ELSE 'In progress' END AS status,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Low' ELSE 'Normal' END AS priority,
          CASE WHEN o_orderkey % 3 = 0 THEN 'Marketplace' WHEN o_orderkey % 3 = 1 THEN 'Trade Fair' ELSE 'Brand' END AS source_type,
          'A/B ' || o_orderpriority AS event_name, 'https://www.' || CASE WHEN o_custkey % 4 = 0 THEN 'diy' WHEN o_custkey % 4 = 1 THEN 'electro' ELSE 'other' END || '.example.com/seller/' AS url
        FROM {orders}""",
    # plans with paging
    "paging": """
        SELECT c_custkey AS id, 'https://l.example.com/list?cat=' || c_mktsegment || '&start=' AS base, c_custkey % 3 AS kind, c_nationkey * 10 + 5 AS hint, c_custkey % 6 + 2 AS top
        FROM {customer}""",
    # robots files and sites
    "robots": """
        SELECT n_nationkey AS nk, 'www.n' || CAST(n_nationkey AS STRING) || '.example.com' AS host,
          'User-agent: somebot' || chr(10) || 'Disallow: /bot' || chr(10) || 'User-Agent: * # all' || chr(10) || 'Disallow: /admin/' || chr(10) || 'Disallow: /n' || CAST(n_regionkey AS STRING) || '*'
          || chr(10) || '# comment' || chr(10) || 'Crawl-delay: ' || CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS STRING) ELSE 'slow' END || chr(10) || 'Disallow:' || chr(10)
          || 'User-agent: other' || chr(10) || 'Disallow: /other' || chr(10) || 'Sitemap: https://www.n' || CAST(n_nationkey AS STRING) || '.example.com/map.xml' AS text
        FROM {nation}""",
    "site_urls": """
        SELECT c_custkey AS id, 'www.n' || CAST(c_nationkey AS STRING) || '.example.com' AS host,
          'https://www.n' || CAST(c_nationkey AS STRING) || '.example.com' || CASE c_custkey % 5 WHEN 0 THEN '/admin/x' WHEN 1 THEN '/n' || CAST(c_nationkey % 5 AS STRING) || 'abc?q=1'
            WHEN 2 THEN '/bot/' ELSE '/page/' || CAST(c_custkey AS STRING) END AS url
        FROM {customer}""",
    # links found on pages: base URL and href
    "hrefs": """
        SELECT o_orderkey AS id, 'https://www.dir' || CAST(o_custkey % 50 AS STRING) || '.example.com:8080/a/b/list.html?x=1#top' AS base,
          CASE o_orderkey % 9 WHEN 0 THEN '/e/' || CAST(o_custkey AS STRING) WHEN 1 THEN 'e-' || CAST(o_custkey AS STRING) || '?v=1' WHEN 2 THEN '../up/' || CAST(o_custkey AS STRING)
            WHEN 3 THEN 'https://other.example.org/p' WHEN 4 THEN '?page=2' WHEN 5 THEN '#frag' WHEN 6 THEN './here/../x' WHEN 7 THEN 'mailto:a@b.de' ELSE '' END AS href,
          '/floor/' || CASE o_orderkey % 6 WHEN 0 THEN 'plan?action=show&actionItem=' || CAST(o_custkey AS STRING) || '&_event=fair' || CAST(o_custkey % 3 AS STRING)
            WHEN 1 THEN 'x?companyId=' || CAST(o_custkey AS STRING) || '&id=' WHEN 2 THEN 'ex-' || CAST(o_custkey AS STRING) || '/profile' WHEN 3 THEN 'about/'
            WHEN 4 THEN 'y?uid=u%20' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey AS STRING) || '/a/b?sellerId=7&entityId=' || CAST(o_custkey AS STRING) END AS id_href,
          CASE o_orderkey % 3 WHEN 0 THEN 'profile=f.' || CAST(o_custkey AS STRING) WHEN 1 THEN '/p?a=b' ELSE CAST(o_custkey AS STRING) END AS api_id
        FROM {orders}""",
    # search results per company
    "search_hits": """
        SELECT l_suppkey AS company, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS pos,
          CASE WHEN l_partkey % 11 = 0 THEN 'https://www.linkedin.com/company/s' || CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey AS STRING) ELSE 'https://news.example.com/' || CAST(l_partkey AS STRING) END AS url,
          p_name || CASE p_size % 7 WHEN 0 THEN ' is Owned By ' || p_brand WHEN 1 THEN ' competes with others' WHEN 2 THEN ' has ' || CAST(l_partkey AS STRING) || ' employees'
            WHEN 3 THEN ' network and solar gear' WHEN 4 THEN ', 5,200+ staff' ELSE ' ' || lower(p_type) END AS snippet
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
}


def sql_text(text: str) -> str:
    """SQL for the oracle: referenced views become common table expressions; other braces stay."""
    names = sorted(VIEWS, key=len, reverse=True)
    needed: list[str] = []

    def collect(t: str) -> None:
        for n in names:
            if "{" + n + "}" in t and n not in needed:
                collect(VIEWS[n])
                needed.append(n)

    collect(text)
    plain = lambda t: re.sub(r"\{([a-z_]+)\}", r"\1", t)
    ctes = [f"{n} AS ({plain(VIEWS[n]).replace('{{', '{').replace('}}', '}')})" for n in needed]
    body = plain(text).strip()
    if not ctes:
        return body
    m = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}" + ", ".join(ctes) + ", " + body[m.end():]
    return "WITH " + ", ".join(ctes) + " " + body
