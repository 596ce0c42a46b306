"""Exact dedup with collisions, URL rules and the filter cascade, SQL of the queries, the pipeline's stages."""
import hashlib
import os
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import exact_dedup as E
from leadloom.llm import queries as Q
from leadloom.llm import urlfilter as U

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("digits, bits", [(32, 1 << 12), (1, 32)])
def test_groups_are_of_equal_bytes_whatever_the_hash(spark, largest, digits, bits):
    rnd = random.Random(digits)
    texts = [None, "", " ", "é", "e\u0301", *[f"text {i}" for i in range(30)]]
    rows = [(i, rnd.choice(texts)) for i in range(120)] + [(None, "text 1"), (None, "null only"), (None, "null only"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, content string").repartition(4)
    got = E.exact_groups(docs, largest=largest, content=lambda t: F.substring(F.md5(t.cast("binary")), 1, digits).cast("binary"), bitmap_bits=bits).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    kept = defaultdict(int)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        t = sha[r.text_sha256]
        ids = [i for i in groups[t] if i is not None]
        assert r.group_size == len(groups[t]) and r.keep_id == ((max if largest else min)(ids) if ids else None)
        kept[t] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(kept[t] == 1 for t in groups)
    left = E.drop_exact_copies(docs)
    assert left.columns == docs.columns and sorted((r.text or "") for r in left.collect()) == sorted(groups)
    assert E.exact_groups(docs.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"host{i}.example/{i % 7}/" for i in range(4_000)]
    listed = set(keys[::9])
    frame = lambda k: spark.createDataFrame([(x,) for x in k], "key string")
    cascade = U.Cascade.build(frame(listed | {"not in the corpus/"}), frame(keys))
    got = {r.key: r.m for r in frame(keys).select("key", cascade.member(F.col("key")).alias("m")).collect()}
    assert {k for k, m in got.items() if m} == listed
    assert len(cascade.levels) > 1 and sum(level.bits for level in cascade.levels) < 20 * len(listed)
    assert U.Cascade.build(frame([]), frame(keys)).levels == []


def judged(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.action if best else "allow"


def test_urls_are_judged_by_the_longest_rule(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://COM", "http://com/", "http://a.com", "http://a.COM/x?y#z", "https://example.com/en/", "https://www.example.com/en/a", "https://WWW.Example.com/en", "http://x.www.example.com/en/?q",
            "http://notexample.com/en/1", "http://a.net/es/", "http://net/fr/x", "http://a.net/es", "http://a.net?b=/es/", "http://a.net#/es/", "ftp://a://b.com/", "http://.com/", "http://a..com//", "http://é.com/é", "http://a.net/ES/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[6], ""), (3, urls[3], "")], "page_id long, url string, host string")
    got = U.judge_urls(pages).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        want = judged(urls[6 if r.page_id is None else r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == want, r
    assert U.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = Q.QUERIES[name](spark, FOLDER)
    cur = con.execute(Q.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels; what each document is."""
    rnd = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi", "nu") for b in ("rat", "sil", "ton", "vex") for c in ("a", "e", "um", "or", "ish")]
    words = lambda n: [rnd.choice(vocabulary) + str(rnd.randrange(40)) for _ in range(n)]
    rows, labels, kind = [], [], {}
    for i in range(500):
        toxic = i % 5 == 0
        w = words(rnd.randrange(60, 200))
        if toxic:
            for bad in ("idiot", "moron", "scum", "trash"):
                w.insert(rnd.randrange(len(w)), bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
        kind[i] = "toxic" if toxic else "clean"
    base = {i: t for i, t in rows}
    for k in range(40):  # exact copies of a clean document
        rows.append((1000 + k, base[1]))
        kind[1000 + k] = "copy"
    for k in range(30):  # one word in another place
        w = base[2].split()
        w[7 + 2 * k] = "changed"
        rows.append((2000 + k, " ".join(w)))
        kind[2000 + k] = "near"
    rows += [(3000, "write to jane@mail.example.org or +49 30 1234567"), (3001, None), (3002, ""), (3003, "lone text")]
    kind |= {3000: "personal", 3001: "empty", 3002: "empty", 3003: "clean"}
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows), kind


def test_every_stage_of_the_pipeline(spark, corpus, tmp_path):
    folder, texts, kind = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    toxic = {i for i, k in kind.items() if k == "toxic"}
    assert len(ids["toxicity"] & toxic) < 0.1 * len(toxic) and len((set(kind) - toxic) - ids["toxicity"]) < 0.02 * len(kind)
    groups = defaultdict(list)
    for i in ids["toxicity"]:
        groups[texts[i] or ""].append(i)
    assert ids["exact_dedup"] == {max(g) for g in groups.values()}
    near = {i for i in ids["exact_dedup"] if i == 2 or kind[i] == "near"}
    assert ids["simhash_dedup"] == ids["exact_dedup"] - near | {min(near)}
    assert ids["personal_data"] == ids["simhash_dedup"]
    changed = {r.doc_id: r.text for r in kept["personal_data"] if r.text != texts[r.doc_id]}
    assert changed == {3000: "write to <EMAIL> or <PHONE>"}
    words = defaultdict(int)
    for r in kept["packing"]:
        words[r.doc_id] += r.length
    assert words == {r.doc_id: len((r.text or "").split()) for r in kept["personal_data"]}
    assert corpus_pipeline.run(spark, folder).count() == len(kept["packing"])


CLASHING = ["_score", "_key", "_sha", "_gone", "terms", "_terms", "_id", "_tk", "_base", "_key_text", "node", "content", "row", "component_id", "label", "toxic", "kept", "base", "text_key", "a.b"]


def test_stages_pass_columns_of_any_name(spark, corpus):
    """A caller's columns named like those that the stages add for themselves come out as they went in."""
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES:
        want, got = stage(spark, docs, folder), stage(spark, wide, folder)
        if name == "packing":
            assert got.columns == want.columns and got.count() == want.count()
            continue
        assert got.columns == wide.columns
        rows = got.collect()
        assert sorted(map(repr, (r[:5] for r in rows))) == sorted(map(repr, map(tuple, want.collect())))
        assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHING)


def test_stages_take_an_empty_table(spark, corpus):
    folder, _, _ = corpus
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_kept_rows_survive_another_parallelism(spark, tmp_path):
    """Files are dealt over tasks by the cores of the moment: rows must not be numbered while they are read again."""
    path = str(tmp_path / "docs")
    spark.range(8_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 300).alias("text")).repartition(40).write.parquet(path)
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    found = E.exact_groups(spark.read.parquet(path))
    try:
        for cores in ("2", "40"):
            spark.conf.set("spark.sql.files.minPartitionNum", cores)
            assert found.filter("kept").count() == 300
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
