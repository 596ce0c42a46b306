"""Ball k-means codes, winnowing and collocations against plain versions."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import ball_codes as B
from leadloom.llm import collocations as C
from leadloom.llm import common
from leadloom.llm import winnow as W


def plain_codes(vectors, parts, entries, rounds):
    x = np.array(vectors, np.int64).reshape(len(vectors), parts, -1)
    books = [[list(v) for v in x[:entries, p]] for p in range(parts)]

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (sum((int(a) - int(b)) ** 2 for a, b in zip(v[p], books[p][e])), e)) for p in range(parts)] for v in x]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[i, p] for i, c in enumerate(codes) if c[p] == e]
                if own:
                    books[p][e] = [int(sum(int(o[j]) for o in own)) // len(own) for j in range(x.shape[2])]
    codes = assign()
    errors = [sum(sum((int(a) - int(b)) ** 2 for a, b in zip(v[p], books[p][c[p]])) for p in range(parts)) for v, c in zip(x, codes)]
    return codes, errors


def test_codes_equal_full_comparison(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-2.0, -0.5, 0.0, 0.25, 0.3, 3.0]) + rnd.choice([0, 0, rnd.random()]) for _ in range(8)], rnd.choice(["a", None, "b"])) for i in range(300)]
    rows += [(900, None, "a"), (901, [1.0, None] + [0.0] * 6, "a"), (902, [float("nan")] * 8, "a"), (903, [float("inf")] * 8, None), (904, rows[5][1], "a")]
    good = rows[:300] + rows[-1:]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label string, code string, dist int").repartition(7)
    got = {r.vec_id: r for r in B.vector_codes(df, parts=4, entries=20, rounds=3).collect()}
    whole = [[int(np.floor(1024 * x)) for x in v] for _, v, _ in good]
    codes, errors = plain_codes(whole, 4, 20, 3)
    assert set(got) == {r[0] for r in good}
    for (i, _, label), code, error in zip(good, codes, errors):
        assert list(got[i].code) == code and got[i].error == error
        assert got[i].label_error == sum(e for (_, _, other), e in zip(good, errors) if other == label)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert B.vector_codes(spark.createDataFrame([], schema)).collect() == []
    got = B.vector_codes(spark.createDataFrame([(1, [], None), (None, [], 3)], schema)).collect()
    assert [(list(r.code), r.error) for r in got] == [([0, 0, 0, 0], 0)] * 2
    # shorter vectors are padded, few vectors make small codebooks, repeated rows stay
    got = B.vector_codes(spark.createDataFrame([(1, [1.0] * 5, 1), (1, [1.0] * 5, 1), (2, [0.5], None), (None, [0.5, 0.0], None)], schema)).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.error) for r in got) == [(False, 1, 0), (False, 1, 0), (False, 2, 0), (True, None, 0)]
    with pytest.raises(ValueError):
        B.vector_codes(spark.createDataFrame([(1, [1e9], 1)], schema))


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_rings_hold_every_nearer_entry(kind):
    rng = np.random.default_rng(1)
    x, book = rng.integers(-9, 9, (500, 3)).astype(kind), rng.integers(-9, 9, (40, 3)).astype(kind)
    code, _ = B.nearest(x, rng.integers(-9, 9, (40, 3)).astype(kind))
    own = ((x - book[code]) ** 2).sum(1)
    radii = np.array([np.sqrt(own[code == e].max()) if (code == e).any() else -1.0 for e in range(40)])
    got = B.moved(x, code, book, B.balls(book, radii))
    want = B.nearest(x, book)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def words_of(text):
    return bytes(W._BYTES[b] for b in (text or "").encode()).decode().split()


def plain_hits(text, items):
    own, hit, found = words_of(text), set(), set()
    for name, other in items:
        theirs = words_of(other)
        m = min(10, len(theirs))
        windows = {tuple(theirs[i : i + m]) for i in range(max(1, len(theirs) - 9))} if m else set()
        for i in range(len(own) - m + 1):
            if m and tuple(own[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found |= {name} - {None}
    return len(own), len(hit), sorted(found)


def test_contamination_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    vocab = ["a", "b", "Über", "the", "x1", "日本"]
    text = lambda n, k=6: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab[:k]) for _ in range(n))
    items = [(str(i), text(rnd.choice([9, 10, 11, 14, 25, 60]))) for i in range(25)] + [("s1", "zeta eta"), ("s2", "Zeta-ETA"), ("one", "omega"), (None, "null id item here"), ("e", ""), ("n", None), ("s1", "other text")]
    long = " ".join([text(4000), items[0][1], text(2500, 2), items[3][1], text(900)])
    docs = [(i, text(rnd.choice([0, 3, 10, 40, 200]), rnd.choice([2, 6]))) for i in range(60)]
    docs += [(100 + i, f"{text(20)} {items[i % 25][1]} {text(15)}") for i in range(40)]
    docs += [(200, None), (201, ""), (202, "say Omega! zeta eta"), (202, "say Omega! zeta eta"), (None, "null ID item here"), (203, long), (204, "w" * 50_000 + " omega")]
    monkeypatch.setattr(W, "SEGMENT", 700)
    df = spark.createDataFrame([(i, t, 5, "clash") for i, t in docs], "doc_id long, text string, row int, words string").repartition(5)
    got = W.contamination(df, spark.createDataFrame(items, "item_id string, text string"), bitmap_bits=1 << 15)
    have = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in got.collect())
    want = Counter((i, n, h, len(found), tuple(found), h > 0) for i, t in docs for n, h, found in [plain_hits(t, items)])
    assert have == want
    assert sum(1 for x in want if x[2]) > 40


def test_contamination_of_pieces(monkeypatch):
    monkeypatch.setattr(W, "SEGMENT", 16)
    text = " ".join(f"w{i}" for i in range(100))
    pieces = list(W.word_pieces(text.encode(), 9))
    assert len(pieces) > 5
    for first, words in pieces:
        assert words == [f"w{i}".encode() for i in range(first, first + len(words))]
    spans = [(first, first + len(words)) for first, words in pieces]
    assert all(any(a <= i and i + 10 <= b for a, b in spans) for i in range(91))


def test_contamination_of_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id int, text string"
    none = spark.createDataFrame([], items)
    assert W.contamination(spark.createDataFrame([], docs), none).collect() == []
    got = W.contamination(spark.createDataFrame([(1, "a b c")], docs), none).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(3, 0, [])]


def plain_collocations(rows, least, most):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in bytes(C._BYTES[b] for b in (text or "").encode()).decode().split("\n"):
            words = [w for w in piece.split(" ") if w]
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, w.decode(), -a, left, right, n[lang], -s) for i, (s, a, w, left, right) in enumerate(sorted(rows)[:most])]
    return sorted(out)


def texts_with_phrases(seed, n=120):
    rnd = random.Random(seed)
    vocab = [*"abcdefgh", "ÉTÉ", "日本", "x y"]
    for i in range(n):
        lang = rnd.choice(["de", "de", "en", None, "und"])
        parts = [rnd.choice(["new york city", "a b c d", "a b", rnd.choice(vocab), "hot pair " + rnd.choice(vocab)]) for _ in range(rnd.choice([0, 1, 8, 60]))]
        yield lang, rnd.choice([" ", "  ", "\t"]).join(p + rnd.choice(["", "", "", ".", ",", "\r\n"]) for p in parts)


@pytest.mark.parametrize("block, segment, bits, pair_bits", [(1_000_000, 1 << 21, 1 << 15, 40), (50, 40, 1 << 15, 40), (7, 10, 64, 3)])
def test_collocations_equal_brute_force(spark, monkeypatch, block, segment, bits, pair_bits):
    """Whatever the blocks, and with bitmaps and hashes that let nearly everything through."""
    monkeypatch.setattr(C, "BLOCK", block), monkeypatch.setattr(C, "SEGMENT", segment), monkeypatch.setattr(C, "PAIR_BITS", pair_bits)
    rows = [*texts_with_phrases(block), (None, None), ("en", ""), ("en", " .,\n")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, w1 string").repartition(3)
    got = C.collocations(df, least=5, most=40, bitmap_bits=bits).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 5, 40)
    assert len({r.lang for r in got}) == 3


def test_collocations_of_an_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_blocks_begin_each_window_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(C, "BLOCK", 5), monkeypatch.setattr(C, "SEGMENT", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "y"], "data": [b"a b c d e f g h i", b"p q. r"]})
    begun = [words[i] for block in C._blocks(iter([batch]), 3) for _, words, ids, skip in block for i in ids[: len(ids) - skip] if i]
    assert sorted(begun) == [c.encode() for c in "abcdefghipqr"]


def test_heavy_keys_are_spread(spark):
    left = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    right = left.select("k").distinct().withColumn("v", F.col("k") * 2)
    assert [r.k for r in common.heavy_keys(left, ["k"]).collect()] == [-1]
    got = common.join_spread(left, right, ["k"], by=["id"])
    assert got.count() == 30_000 and got.filter("v <> 2 * k").count() == 0
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with common.bounded_batches(spark, 3):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "3"
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
