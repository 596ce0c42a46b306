"""Packing rules, exact top-k against brute force, toxicity on a small corpus."""
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import packing as P
from leadloom.llm import topk as K
from leadloom.llm import toxicity as T


@pytest.mark.parametrize("seed", range(5))
def test_every_piece_takes_the_tightest_compatible_bin(seed):
    rnd = random.Random(seed)
    n, capacity = 300, 100
    lengths = [rnd.choice([0, 1, 3, 17, 40, 55, 99, 100, 101, 250]) for _ in range(n)]
    sources = [rnd.choice(["hot", "hot", "hot", None, *"abcdefgh"]) for _ in range(n)]
    clusters = [rnd.choice([1, 2, 3, None, *range(10, 200)]) for _ in range(n)]
    ids = list(range(n))
    bins = defaultdict(lambda: [capacity, set(), set()])
    total = defaultdict(int)
    for i, piece, start, size, b, at in P.pack_shard(ids, lengths, sources, clusters, capacity):
        assert start == piece * capacity and at == capacity - bins[b][0]
        fits = [x for x, (left, s, c) in bins.items() if left >= size and left > 0 and (size < capacity or not lengths[i]) and sources[i] not in s and clusters[i] not in c]
        if size < capacity:
            if fits:
                assert b in bins and bins[b][0] == min(bins[x][0] for x in fits) and b in fits
            else:
                assert b not in bins
            if sources[i] is not None:
                bins[b][1].add(sources[i])
            if clusters[i] is not None:
                bins[b][2].add(clusters[i])
        bins[b][0] -= size
        total[i] += size
    assert [total[i] for i in ids] == lengths and all(x[0] >= 0 for x in bins.values())


def test_pack_documents_keeps_all_words(spark):
    rnd = random.Random(1)
    texts = [None, "", " ", *[" ".join(f"w{j}" for j in range(rnd.randrange(400))) for _ in range(150)], " ".join(["x"] * 1000)]
    rows = [(i, t, "hot" if i % 3 else None, "clash") for i, t in enumerate(texts)] + [(None, "no id", "s", ""), (5, texts[5], "hot", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin string").repartition(4)
    got = P.pack_documents(docs, capacity=128, shard_rows=40).collect()
    words = defaultdict(int)
    for r in got:
        words[r.doc_id] += r.length
    want = defaultdict(int)
    for i, t, _, _ in rows:
        want[i] += len((t or "").split())
    assert words == want
    fill = defaultdict(int)
    hot = defaultdict(set)
    for r in got:
        fill[r.shard, r.bin] += r.length
        if r.doc_id is not None and r.doc_id % 3 and r.length < 128:
            assert r.doc_id not in hot[r.shard, r.bin]
            hot[r.shard, r.bin].add(r.doc_id)
    assert max(fill.values()) <= 128 and all(len(v) <= 1 for v in hot.values())
    assert P.pack_documents(docs.limit(0)).count() == 0
    unique = docs.filter("doc_id <> 5 and doc_id is not null")
    back = P.bin_texts(P.pack_documents(unique, capacity=128), unique).collect()
    assert sorted(" ".join(r.text for r in back).split()) == sorted(w for i, t, _, _ in rows if i not in (5, None) for w in (t or "").split())


@pytest.mark.parametrize("bins, block", [(512, 4096), (7, 16)])
def test_top_k_equals_brute_force(spark, bins, block):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=6)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (350, [float("inf")] * 6), (None, rows[0][1]), (7, rows[7][1]), (400, [0.5])]
    vectors = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    got = sorted(tuple(r) for r in K.top_k(vectors, F.col("vec_id") % 50 == 0, 5, bins=bins, candidates=block).collect())
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (6 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in ok if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_top_k_of_few_rows(spark):
    two = spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in K.top_k(two, F.col("vec_id") == 50).collect()] == [(50, 1, 51, 256 * 512)]
    assert K.top_k(two.limit(0), F.col("vec_id") == 50).count() == 0
    assert K.top_k(two, F.col("vec_id") == 3).count() == 0


def test_toxicity_learns_and_scores_every_row(spark):
    rnd = random.Random(4)
    plain, bad = [f"word{i}" for i in range(300)], ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(1200):
        y = int(i % 4 == 0)
        text = [rnd.choice(plain) for _ in range(rnd.randrange(20, 80))]
        for _ in range(3 * y):
            text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        rows.append((i, " ".join(text), "clash"))
        labels.append((i, y, "x"))
    rows += [(5000, None, ""), (5001, "", ""), (None, "idiot scum moron", ""), (0, rows[0][1], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    marks = spark.createDataFrame(labels + [(None, 1, ""), (5000, None, "")], "doc_id long, toxic int, text string")
    got = T.toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert len(held) > 100 and np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    again = {(r.doc_id, r.score) for r in T.toxicity(docs.repartition(7), marks.repartition(3)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert T.toxicity(docs.limit(0), marks).count() == 0
    assert {r.score for r in T.toxicity(docs, marks.limit(0)).collect()} == {0.5}
    kept = T.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)
