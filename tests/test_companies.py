"""Merge rules, each also on shuffled and repartitioned input."""
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import dedup as D
from leadloom.operators import filters as FL
from leadloom.operators import joins as J
from leadloom.operators import merge as M


def variants(spark, rows, schema):
    for seed in (0, 1):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        yield spark.createDataFrame(mixed, schema).repartition(1 + 3 * seed)


def test_company_first_non_null(spark):
    rows = [(1, "t1", " Acme  Inc", None, "B"), (2, "t2", "ACME INC", "DE", "C"), (3, "t3", "acme inc ", "FR", None), (4, "t4", "acme inc", None, None), (5, "t5", " ", "X", "Y")]
    for df in variants(spark, rows, "o long, at string, name string, country string, city string"):
        out = M.merge_companies(df, ["o"], "at").collect()
        assert [(r["name"], r.name_normalized, r.country, r.city, r.created_at, r.updated_at) for r in out] == [(" Acme  Inc", "acme inc", "DE", "B", "t1", "t3")]


def test_events_null_year_absorbs(spark):
    rows = [(1, "Fair", 2024, "A"), (2, "fair ", None, "B"), (3, "FAIR", 2025, "C"), (4, "fair", 2024, "D"), (5, "Other", 2025, "E")]
    for df in variants(spark, rows, "o long, name string, year int, city string"):
        df = df.withColumns({"country": F.lit("x"), "website": F.lit(None).cast("string")})
        out = sorted((r.name_normalized, r.year or 0, r.city) for r in M.merge_events(df, ["o"]).collect())
        assert out == [("fair", 0, "B"), ("fair", 2024, "A"), ("other", 2025, "E")]


def test_exhibitor_seller_financial_rules(spark):
    rows = [(1, "c", "e", "h1", None), (2, "c", "e", None, "s2"), (3, "c", "e", "h3", None)]
    for df in variants(spark, rows, "o long, company_id string, event_id string, hall string, stand string"):
        assert [tuple(r) for r in M.merge_exhibitors(df, ["o"]).collect()] == [("c", "e", "h3", "s2")]
    rows = [(1, "c", "m", None, None), (2, "c", "m", 4.0, "K"), (3, "c", "m", None, "L")]
    for df in variants(spark, rows, "o long, company_id string, marketplace_id string, rating double, kvk_number string"):
        assert [tuple(r) for r in M.merge_sellers(df, ["o"]).collect()] == [("c", "m", 4.0, None)]
    rows = [(1, "c", None, "s", 1.0), (2, "c", None, "s", 2.0), (3, "c", 2024, "s", 3.0), (4, "c", 2024, "s", None), (5, "c", 2024, "s", 5.0)]
    for df in variants(spark, rows, "o long, company_id string, year int, source string, total_gmv_eur double"):
        out = sorted((r.year or 0, r.total_gmv_eur) for r in M.merge_financials(df, ["o"]).collect())
        assert out == [(0, 1.0), (0, 2.0), (2024, 5.0)]


def test_socials_last_wins(spark):
    rows = [(1, "c", "LinkedIn ", "a"), (2, "c", "linkedin", " b "), (3, "c", "linkedin", "NaN"), (4, "c", "x", None)]
    for df in variants(spark, rows, "o long, company_id string, platform string, url string"):
        assert [tuple(r) for r in M.upsert_socials(df, ["o"]).collect()] == [("c", "linkedin", "b")]


def test_dedup(spark):
    rows = [(1, "A", None, "u"), (2, " a ", "", "U "), (3, "A", "w", "u"), (4, None, None, None), (5, "", None, None)]
    for df in variants(spark, rows, "o long, name string, website string, source_url string"):
        assert sorted(r.o for r in D.dedup_leads(df, ["o"]).collect()) == [1, 3, 4]
    items = [(1, {"name": "A", "x": "1"}), (2, {"x": " 1 ", "name": "a"}), (3, {"detail_link": "/d", "name": "A"}), (4, {"detail_link": "/d", "name": "B"})]
    for df in variants(spark, items, "o long, item map<string,string>"):
        assert sorted(r.o for r in D.dedup_items(df, "item", ["o"]).collect()) == [1, 3]
        assert sorted(r.o for r in D.dedup_items(df, "item", ["o"], max_items=2).collect()) == [1]


def test_sparse_columns(spark):
    rows = [(f"n{i}", None if i else "x", "N/A" if i % 2 else None, "nan" if i else "v", "n/a") for i in range(40)]
    df = spark.createDataFrame(rows, "name string, nulls string, half string, tokens string, kept string")
    out = FL.drop_sparse_columns(df)
    # half nulls and half tokens are not added up; 'n/a' is no column token but cleans to NULL
    assert out.columns == ["name", "half", "kept"]
    assert out.filter("kept is not null or half is not null").count() == 0
    assert FL.drop_sparse_columns(df.limit(0)).columns == []


def test_search_hits(spark):
    rows = [(1, "c", "https://x", "Part OF big"), (2, "c", "https://linkedin.com/company/c", "owned by Y, 300 employees"), (3, "c", "https://linkedin.com/company/d", "rival of z")]
    for df in variants(spark, rows, "o long, c string, url string, snippet string"):
        r = M.merge_search_hits(df, ["c"], ["o"]).first()
        assert tuple(r)[1:] == ("https://linkedin.com/company/c", "Part OF big", "rival of z", "Mid-Market")
        assert M.merge_search_hits(df, ["c"], ["o"], keep="last").first().parent_group.startswith("owned by")


def test_backfill_links_greedy(spark):
    items = spark.createDataFrame([(1, 0, "Acme", None), (1, 1, "Acme Gmbh", None), (1, 2, "Acme", None), (1, 3, "Zed", "/own"), (2, 0, None, None)], "page_id long, idx int, name string, detail_link string")
    boxes = spark.createDataFrame([(1, 0, "Acme GmbH Berlin", "/a"), (1, 1, "acme  tools", "/b"), (1, 2, "acme x", None)], "page_id long, idx int, text string, link string")
    got = {(r.page_id, r.idx): r.detail_link for r in J.backfill_links(items, boxes).collect()}
    assert got == {(1, 0): "/b", (1, 1): "/a", (1, 2): None, (1, 3): "/own", (2, 0): None}


def _links_in_turn(items, boxes):
    """Plain form: items in order, each scans all containers of its page."""
    out, used = [], set()
    boxes = [(p, i, " ".join(t.lower().split()), l) for p, i, t, l in boxes if l is not None]
    for p, i, name, link in sorted(items, key=lambda r: (r[0], r[1])):
        low = (name or "").strip().lower()
        hits = [(len(b[2]), b[1]) for b in boxes if b[0] == p and (p, b[1]) not in used and low in b[2]] if low and not link else []
        if hits:
            used.add((p, min(hits)[1]))
            link = next(b[3] for b in boxes if (b[0], b[1]) == (p, min(hits)[1]))
        out.append((p, i, name, link))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_backfill_links_equals_the_plain_form(spark, seed):
    rnd = random.Random(seed)
    words = ["a", "ab", "Acme", "acme tools", "Äpfel", "tools gmbh", "item 1", "item 12", "12"]
    items, boxes = [], []
    for page in range(6):
        items += [(page, i, rnd.choice([*words, None, " ", "no such name"]), rnd.choice([None, None, "", "/own"])) for i in range(25)]
        boxes += [(page, i, "  ".join(rnd.choices([*words, "\n"], k=rnd.randint(0, 4))), rnd.choice(["", f"/{i}", f"/{i}", None])) for i in range(25)]
    rows = spark.createDataFrame(items, "page_id long, idx int, name string, detail_link string")
    got = J.backfill_links(rows, spark.createDataFrame(boxes, "page_id long, idx int, text string, link string"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == _links_in_turn(items, boxes)


def test_backfill_links_chains_repeats_and_nulls(spark):
    # each item is displaced by the one before it, so every round settles one
    chain = [(1, i, f"n{i};", None) for i in range(5)]
    boxes = [(1, i, f"n{i}; n{i + 1};", f"/{i}") for i in range(5)]
    # equal names share their containers, repeated rows count each
    same = [(2, 0, "x", None), (2, 0, "x", None), (2, 5, "X ", None), (None, 0, "x", None), (3, 0, "x", None)]
    boxes += [(2, i, "x" * (i + 1), f"/x{i}") for i in range(2)] + [(None, 0, "x", "/null"), (3, 0, None, "/none")]
    schema = "page_id long, idx int, name string, detail_link string"
    tables = [spark.createDataFrame(r, s) for r, s in ((chain + same, schema), (boxes, "page_id long, idx int, text string, link string"))]
    got = [(r.page_id, r.idx, r.detail_link) for r in J.backfill_links(*tables).collect()]
    assert sorted(g for g in got if g[0] == 1) == [(1, i, f"/{i}") for i in range(5)]
    assert sorted(g[2] or "" for g in got if g[0] == 2) == ["", "/x0", "/x1"]
    assert sorted((g for g in got if g[0] not in (1, 2)), key=str) == [(3, 0, None), (None, 0, None)]
    empty = [t.limit(0) for t in tables]
    assert J.backfill_links(*empty).count() == 0
    assert J.backfill_links(tables[0], empty[1]).filter("detail_link IS NOT NULL").count() == 0


def test_rules_join_takes_rows_as_they_are(spark):
    rules = spark.createDataFrame([(i, f"r{i}", p) for i, p in enumerate(["zz", "b", "a", "ab", "c"])], "priority int, name string, pattern string")
    df = spark.createDataFrame([(1, "abc"), (1, "c"), (None, "a"), (3, "x"), (4, None)], "id long, t string")
    got = [(r.id, r.rule) for r in J.rules_join(df, rules, "t").collect()]
    assert got == [(1, "r1"), (1, "r4"), (None, "r2"), (3, None), (4, None)]
    many = spark.createDataFrame([(i, f"n{i}", f"q{i}q") for i in range(3_000)] + [(5_000, "last", "x")], "priority int, name string, pattern string")
    assert [r.rule for r in J.rules_join(df, many, "t").collect()] == [None, None, None, "last", None]


def test_import_event(spark):
    df = spark.createDataFrame(
        [(1, "Acme", None, "B1", "x; y", "u", "N/A"), (2, " ", "S", None, None, None, None), (3, "acme", "S9", None, None, "nan", "late")],
        "o long, name string, stand string, booth string, brands string, social_x string, extra_note string",
    )
    parts = M.import_event(df, "Expo", 2026, ["o"])
    e = M.merge_exhibitors(parts["exhibitors"], ["o"]).first()
    assert (e.stand, e.brands, e.extra_data) == ("S9", '["x","y"]', '{"note":"late"}')
    assert [r.url for r in M.upsert_socials(parts["socials"], ["o"]).collect()] == ["u"]


def test_company_view_reads_mentions_once(spark, tmp_path):
    rows = [("a", 1, "e1", 3.0, 2020), ("a", 2, "e1", None, 2021), ("a", 3, None, 1.0, 2021), ("b", 4, "e1", None, None), ("b", 5, "e2", None, None), (None, 6, "e1", 9.0, 2024)]
    spark.createDataFrame(rows, "company_id string, o long, event string, stars double, y int").write.parquet(str(tmp_path / "m"))
    mentions = spark.read.parquet(str(tmp_path / "m"))
    kinds = [J.FactKind("event_exhibitors", ("event",)), J.FactKind("marketplace_sellers", ("event",), {"rating": "stars"}), J.FactKind("company_financials", ("y",), {"year": "y"})]
    facts = J.facts_of_mentions(mentions, kinds, ["o"])
    companies = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "company_id string, name string")
    socials = spark.createDataFrame([("b",), ("b",)], "company_id string")
    view = J.company_360({"companies": companies, "company_socials": socials}, facts)
    got = {r.company_id: (r.n_socials, r.n_events, r.n_marketplaces, r.best_rating, r.n_financials, r.latest_year, r.n_contacts) for r in view.collect()}
    # the rating of (a, e1) is that of its last mention with one; NULL is an event of its own
    assert got == {"a": (0, 2, 2, 3.0, 2, 2021, 0), "b": (2, 2, 2, None, 1, None, 0), "c": (0, 0, 0, None, 0, None, 0)}
    plan = view._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and plan.count("Join") == 1
    assert J.company_360({"companies": companies}).columns == ["company_id", "name"]


def _facts_in_turn(rows):
    """Plain form: mentions in order, the last value that is there stays."""
    out = {}
    for c, o, event, stars, y in sorted(rows, key=lambda r: r[1]):
        for table, key, stars_of, year_of in (("event_exhibitors", (event, y), None, None), ("marketplace_sellers", (event,), stars, None), ("company_financials", (y, event), None, y)):
            was = out.get((c, table, key), (0, None, None))
            out[c, table, key] = (was[0] + 1, was[1] if stars_of is None else stars_of, was[2] if year_of is None else year_of)
    return out


@pytest.mark.parametrize("order", [["o"], ["o", "stars"]])
def test_facts_of_mentions_fold_by_company(spark, tmp_path, order):
    rnd = random.Random(3)
    # a third of the mentions is one company's, the others lie all over the files
    rows = [("hot" if i % 3 == 0 else rnd.choice([None, *[f"c{j}" for j in range(90)]]), i, rnd.choice([None, "e1", "e2", "e3"]), rnd.choice([None, 1.0, 2.5]), rnd.choice([None, 2020, 2021])) for i in range(30_000)]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "company string, o long, event string, stars double, y int").repartition(8).write.parquet(str(tmp_path / "m"))
    kinds = [J.FactKind("event_exhibitors", ("event", "y")), J.FactKind("marketplace_sellers", ("event",), {"rating": "stars"}), J.FactKind("company_financials", ("y", "event"), {"year": "y"})]
    small = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(small, "20000")
    try:
        facts = J.facts_of_mentions(spark.read.parquet(str(tmp_path / "m")), kinds, order, "company")
        got = {(r.company_id, r.table, tuple(r.key)): (r.n_mentions, r.rating, r.year) for r in facts.collect()}
        plan = facts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(small)
    text = lambda k: tuple(None if x is None else str(x) for x in k)
    assert got == {(c, t, text(k)): v for (c, t, k), v in _facts_in_turn(rows).items()}
    # dealt by company first, the large one over several tasks, facts meet by their own key
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "skewed" in plan and "hashpartitioning(company_id" in plan
    if len(order) == 1:
        assert "SortAggregate" not in plan


def test_company_360_query_folds_without_a_sort(spark):
    import __spark_entry__ as entry

    view = entry.queries()["jn15_company_360"](spark, "/root/testdata/sf0.001")
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "REBALANCE_PARTITIONS_BY_COL" in plan
