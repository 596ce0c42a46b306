"""Registered queries of the operators, with the SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import ball_codes, bpe, collocations, exact_dedup, packing, pii, secrets, simhash, suffix, topk, toxicity, urlfilter, winnow
from leadloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_simhash_groups")
def op1(spark, folder):
    return simhash.near_groups(table(spark, folder, "documents"))


@query("op2_bpe_round_trip")
def op2(spark, folder):
    import public_tokenizers as given

    return bpe.encode_documents(table(spark, folder, "documents"), given.path("byte_bpe_50k.json"), given.PATTERN, with_ids=False)


@query("op3_best_fit_packing")
def op3(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


@query(
    "op4_exact_dedup",
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
    FROM t WINDOW g AS (PARTITION BY text)
    """,
)
def op4(spark, folder):
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query(
    "op5_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
)
def op5(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


@query(
    "op6_secret_scan",
    r"""
    WITH r(kind, rank, re, part, least) AS (VALUES
        ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
        ('access', 1, 'AKIA[A-Z0-9]+', 0, 16), ('hex', 2, '[0-9a-f]+', 0, 32),
        ('pem', 3, '-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----', 0, 0), ('jwt', 4, 'eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}', 0, 0)),
    t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    m AS (SELECT doc_id, kind, rank, part, least, re, regexp_extract_all(text, re) AS v, string_split_regex(text, re) AS p FROM t, r),
    u AS (SELECT doc_id, kind, rank, least, CASE WHEN part = 2 THEN length(regexp_extract(x, re, 2)) ELSE length(x) END AS n, length(x) AS size, start
          FROM (SELECT *, unnest(v) AS x, unnest(list_transform(range(1, len(v) + 1), lambda i: list_sum(list_transform(p[1:i], lambda a: length(a))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda b: length(b))), 0))) AS start FROM m)),
    f AS (SELECT doc_id, kind, rank, start::BIGINT AS start, concat_ws(':', kind, start::BIGINT, (start + size)::BIGINT) AS span FROM u WHERE n >= least),
    g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS c,
          string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
    SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN g USING (doc_id)
    """,
)
def op6(spark, folder):
    return secrets.secret_report(table(spark, folder, "documents"))


@query("op7_suffix_dedup")
def op7(spark, folder):
    return suffix.remove_repeats(table(spark, folder, "documents"), with_text=False)


@query(
    "op8_url_filter",
    """
    WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM r),
    f AS (SELECT *,
        starts_with(path, '/') AND (host = 'com' OR ends_with(host, '.com')) AS a,
        starts_with(path, '/en/') AND (host = 'example.com' OR ends_with(host, '.example.com')) AS b,
        starts_with(path, '/en/') AND (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AS c,
        starts_with(path, '/es/') AND (host = 'net' OR ends_with(host, '.net')) AS d,
        starts_with(path, '/fr/') AND (host = 'net' OR ends_with(host, '.net')) AS e FROM p)
    SELECT page_id, host, path,
        CASE WHEN c THEN 'www.example.com/en/' WHEN b THEN 'example.com/en/' WHEN a THEN 'com/' WHEN d THEN 'net/es/' WHEN e THEN 'net/fr/' END AS rule,
        CASE WHEN c THEN 'allow' WHEN b THEN 'block' WHEN a THEN 'allow' WHEN d OR e THEN 'block' ELSE 'allow' END AS verdict
    FROM f
    """,
)
def op8(spark, folder):
    return urlfilter.judge_urls(table(spark, folder, "pages"))


@query("op9_toxicity")
def op9(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_personal_data")
def op10(spark, folder):
    return pii.personal_data_report(table(spark, folder, "documents"))


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 16) -> str:
    """The rounds of op11 unrolled; vectors have parts x width components."""
    steps = [f"""
    v AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    x AS MATERIALIZED (SELECT vec_id, p, v[p * {width} + 1:p * {width} + {width}] AS x FROM v, range({parts}) t(p)),
    c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x QUALIFY e < {entries})"""]
    for t in range(rounds + 1):
        steps.append(f"""
    a{t} AS MATERIALIZED (
        SELECT vec_id, p, any_value(x) AS x, min({{'d': (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT, 'e': e}}) AS b
        FROM x JOIN c{t} USING (p) GROUP BY vec_id, p
    )""")
        if t < rounds:
            steps.append(f"""
    m{t} AS (SELECT p, b.e AS e, i, floor(sum(x[i]) / count(*)) AS s FROM a{t}, range(1, {width} + 1) r(i) GROUP BY ALL),
    n{t} AS (SELECT p, e, list(s ORDER BY i) AS c FROM m{t} GROUP BY p, e),
    c{t + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN n{t} USING (p, e))""")
    return "WITH" + ",".join(steps) + f""",
    f AS (SELECT vec_id, string_agg(lower(lpad(to_hex(b.e), 2, '0')), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
    h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda z: z::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v USING (vec_id), h
    """


@query("op11_vector_codes", _codes_sql())
def op11(spark, folder):
    found = ball_codes.vector_codes(table(spark, folder, "embeddings"))
    return found.withColumn("code", ball_codes.hex_code(F.col("code")))


_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op12_contamination",
    f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
    i AS MATERIALIZED (
        SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM b WHERE len(w) > 0)
    ),
    s AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS j, w FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m),
    g AS (SELECT r, m, j, array_to_string(w[j:j + m - 1], ' ') AS g FROM s),
    h AS MATERIALIZED (SELECT DISTINCT r, m, j, item_id FROM g JOIN i USING (m, g)),
    hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(j, j + m)) AS pos FROM h) GROUP BY r),
    own AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
    """,
)
def op12(spark, folder):
    return winnow.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op13_collocations",
    r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents
    ),
    w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
    g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 5) t(m) WHERE len(w) >= m),
    f AS MATERIALIZED (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
    k AS (SELECT lang, phrase, a, w, unnest(range(1, m)) AS k, m FROM c),
    s AS (
        SELECT k.lang, k.phrase, a, min({'score': 2000000 * a // (x.f + y.f), 'k': k, 'l': x.f, 'r': y.f}) AS b
        FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
        GROUP BY ALL
    ),
    i AS (
        SELECT lang, sub AS phrase, max(a) AS longer
        FROM (SELECT lang, a, unnest(list_transform(range(1, m - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' '))) AS sub FROM c, range(2, 4) t(j) WHERE j < m) GROUP BY ALL
    ),
    o AS (SELECT s.lang, s.phrase, s.a, s.b FROM s LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * s.a)
    SELECT lang, row_number() OVER r AS rank, phrase, a::BIGINT AS a, b.l::BIGINT AS l, b.r::BIGINT AS r, n, b.score::BIGINT AS score
    FROM o JOIN n USING (lang) WINDOW r AS (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) QUALIFY row_number() OVER r <= 2000
    """,
)
def op13(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))
