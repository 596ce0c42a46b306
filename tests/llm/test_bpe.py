"""Encoding with reused chunks against the tokenizers library."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leadloom.llm import bpe as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def texts():
    rnd = random.Random(8)
    words = ["the", "über", "naïve", "don't", "we'll", "x1y2", "漢字", "😀", "...", " ", "a", "Ende.", "[1]", "\r\n", "\t", " ", "1234567"]
    make = lambda n: "".join(rnd.choice(words) + rnd.choice(["", " ", " ", " ", "  ", "\n", "\n\n"]) for _ in range(n))
    passages = [make(400) for _ in range(6)]
    out = [None, "", " ", "  \n ", "<|endoftext|>", "a <|endoftext|>  <|endoftext|>b", "<|endoftext", "x" * 30_000, " " * 30_000 + "x", "😀" * 500]
    for _ in range(60):
        out.append(make(rnd.randrange(50)) + rnd.choice(passages) + make(rnd.randrange(80)) + rnd.choice(["", "<|endoftext|>"]) + rnd.choice(passages) + make(rnd.randrange(9)))
    return out


def test_chunks_cover_texts_and_follow_content():
    rnd = np.random.default_rng(1)
    data = bytes(rnd.integers(97, 122, 60_000, np.uint8))
    cuts = list(B.chunks(data))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    moved = {(b"some words before" + data)[a:b] for a, b in B.chunks(b"some words before" + data)}
    assert sum(data[a:b] in moved for a, b in cuts) > 0.9 * len(cuts)
    for t in ("é" * 9_000, "漢" * 5_000):
        assert "".join(t.encode()[a:b].decode() for a, b in B.chunks(t.encode())) == t


def test_equal_to_the_library_and_chunks_are_used(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(None, "no id at all", ""), (12, "same id, other text " * 40, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = B.encode_documents(docs, PATH, PATTERN)
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by_id.values())) == len(rows)
    for i, t, _ in rows:
        want = ids_of(t)
        digest = hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        r = next(r for r in by_id[i] if r.ids_sha256 == digest)
        assert (r.n_tokens, list(r.ids)) == (len(want), want)
        assert r.decoded_sha256 == hashlib.sha256(PLAIN.decode(want, skip_special_tokens=False).encode()).hexdigest() == hashlib.sha256((t or "").encode()).hexdigest()
    data = docs.selectExpr("doc_id", "cast(coalesce(text, '') as binary) as data")
    known = B.known_chunks(data, PATH, PATTERN)
    used = sum(t is not None and t.encode()[a:b] in known for _, t, _ in rows for a, b in B.chunks((t or "").encode()))
    assert len(known) > 3 and used > 40
    back = {r.doc_id: r.text for r in B.decode_ids(got.filter("doc_id <> 12"), PATH, PATTERN).collect()}
    assert back == {i: t or "" for i, t, _ in rows if i not in (None, 12)}
    assert B.encode_documents(docs.limit(0), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_any_known_chunk_leaves_the_ids_as_they_are(seed):
    own, rnd = B.codec(PATH, PATTERN), random.Random(seed)
    for t in texts()[10:30]:
        data = t.encode()
        known = {data[a:b]: got for a, b in B.chunks(data) if rnd.random() < 0.6 and b"<|" not in data[a:b] and (got := own.inner(data[a:b]))}
        assert own.encode(data, known).tolist() == ids_of(t)
