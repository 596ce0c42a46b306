"""SimHash fingerprints, vantage-point trees and components against brute force."""
import random

import numpy as np
import pytest
import xxhash

from leadloom.llm import simhash as S
from leadloom.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def brute_components(links, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(rnd.randrange(5000, 5400), rnd.randrange(5000, 5400)) for _ in range(150)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components(links, {x for e in links if e[0] != e[1] for x in e})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_of_odd_texts():
    long = " ".join(f"w{i % 977}" for i in range(3_000))
    for t in [None, "", " \t\n", "One", "one TWO", "a b c", "é É x Y z", "w x y z", long, "x" * 10_000 + " y z q"]:
        want = brute_fingerprint(t)
        assert int.from_bytes(S.simhash((t or "").encode()), "big") == want, t
    old, S.BLOCK_BYTES = S.BLOCK_BYTES, 100
    try:
        assert int.from_bytes(S.simhash(long.encode()), "big") == brute_fingerprint(long)
    finally:
        S.BLOCK_BYTES = old


@pytest.mark.parametrize("leaf_rows, leaf_most", [(20, 200_000), (200, 16), (10_000, 200_000)])
def test_links_connect_what_brute_force_links(spark, leaf_rows, leaf_most):
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) for _ in range(300)}
    for v in list(values)[:100]:
        for _ in range(6):
            w = v
            for _ in range(rnd.randint(1, 5)):
                w ^= 1 << rnd.randrange(64)
            values.add(w)
    values |= {0, 7, 1 << 63}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(signed(v), v.to_bytes(8, "big"), v.to_bytes(8, "big")) for v in values]
    nodes = spark.createDataFrame(rows, "node long, route binary, check binary").repartition(4)
    links = [(r.a, r.b) for r in S.near_links(nodes, 8, 1, 3, leaf_rows=leaf_rows, leaf_most=leaf_most).collect()]
    ids = [signed(v) for v in values]
    v = np.array(list(values), np.uint64)
    close = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    want = brute_components([(ids[i], ids[j]) for i, j in zip(*np.nonzero(close)) if i < j], ids)
    assert brute_components(links, ids) == want
    # a link joins two nodes of one component, not always two within three bits: leaves report spanning forests
    assert links


def test_near_groups(spark):
    base = " ".join(f"word{i * 7 % 101}" for i in range(300))
    texts = [(5, base), (9, base + " more"), (3, base), (1, None), (2, ""), (None, base), (None, "alone text of its own kind"), (8, "short one"), (8, "short one"), (11, "\n")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, component_id string").repartition(3)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.near_groups(docs).collect()]
    fps = {i: brute_fingerprint(t) for i, (_, t) in enumerate(texts)}
    links = [(i, j) for i in fps for j in fps if i < j and bin(fps[i] ^ fps[j]).count("1") <= 3]
    top = brute_components(links, list(fps))
    want = []
    for i, (d, t) in enumerate(texts):
        ids = [texts[j][0] for j in fps if top[j] == top[i] and texts[j][0] is not None]
        want.append((d, f"{fps[i]:016x}", min(ids) if ids else None))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert S.near_groups(docs.limit(0)).count() == 0


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rnd, base, kind, share):
    """A copy of a list of words whose five-word similarity to it is about `share` (appended, removed, replaced, scattered)."""
    n, new = len(base), lambda k: [f"n{rnd.getrandbits(40)}" for _ in range(k)]
    at = rnd.randrange(n // 4, n // 2)
    if kind == "appended":
        return base + new(round(n / share) - n)
    if kind == "removed":
        return base[:at] + base[at + round(n * (1 - share)) :]
    if kind == "replaced":
        k = round(n * (1 - share) / (1 + share)) - 4
        return base[:at] + new(k) + base[at + k :]
    out = list(base)
    for i in rnd.sample(range(n), round(n * (1 - share) / (1 + share) / 5)):
        out[i] = new(1)[0]
    return out


def test_similar_groups_link_edits_of_every_kind_and_only_those(spark):
    rnd, texts = random.Random(9), []
    for kind in ("appended", "removed", "replaced", "scattered"):
        for share in (0.72, 0.76, 0.79, 0.83, 0.9):
            for _ in range(12):
                base = [f"w{rnd.getrandbits(40)}" for _ in range(rnd.randrange(150, 400))]
                texts += [" ".join(base), " ".join(edited(rnd, base, kind, share))]
    links = [(i, i + 1) for i in range(0, len(texts), 2) if jaccard(texts[i], texts[i + 1]) >= 0.8]
    assert 60 < len(links) < 180
    want = brute_components(links, range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs).collect()}
    assert got == want


def test_similar_groups_take_fingerprint_links(spark, monkeypatch):
    # without any band, copies that differ in a few words of many meet by their fingerprints
    monkeypatch.setattr(S, "band_keys", lambda hashes, count: np.zeros(0, np.int64))
    rnd = random.Random(4)
    base = [[f"w{rnd.getrandbits(40)}" for _ in range(3000)] for _ in range(3)]
    texts = [" ".join(b) for b in base] + [" ".join([*b, "more"]) for b in base] + ["", " "]
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2, 6: 6, 7: 6}


def test_similar_roots_equal_brute_force():
    rnd = random.Random(4)
    for spread in (4, 12, 30):
        pool = [[rnd.getrandbits(64) for _ in range(60)] for _ in range(3)]
        sets = []
        for _ in range(150):
            own = list(rnd.choice(pool)) if rnd.random() < 0.6 or not sets else list(rnd.choice(sets))
            for _ in range(rnd.randrange(spread)):
                own[rnd.randrange(len(own))] = rnd.getrandbits(64)
            sets.append(np.unique(np.array(own, np.uint64)))
        links = [(i, j) for i in range(150) for j in range(i) if 5 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 4 * len(set(sets[i].tolist()) | set(sets[j].tolist()))]
        want = brute_components(links, range(150))
        assert S.similar_roots(sets, 0.8).tolist() == [want[i] for i in range(150)]
