"""Byte-level BPE over whole texts, with content-defined chunks that are encoded once.

A rolling hash over the last 32 bytes cuts texts into chunks that begin and end at the same places wherever
the passage stands. A first scan counts chunk hashes over the corpus; the chunks whose reuse saves most
(bounded in number and size, so that they can be broadcast) are encoded once and kept with their ids. A second
scan encodes the documents: the inner part of a known chunk is taken over, everything else, the joins
included, is encoded in place.

Joins are exact. The byte-level pattern never lets a token run from a character that is not white space into
white space, whatever stands around, so text splits there and nowhere else is it split: the inner part of a
chunk runs from its first such place to its last, and a join is encoded again from the last place before it to
the first place after it. Chunks that are not broadcast are encoded with the text around them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadloom.llm.common import small_batches, stored

#: Mean bits, least and most bytes of a chunk; chunks that are kept encoded at most (16 MB of text).
CHUNK_BITS, CHUNK_LEAST, CHUNK_MOST, KEPT = 10, 256, 4_096, 4_096
#: A long text is encoded in pieces of about so many bytes.
PIECE = 1 << 18

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 5) for i in range(256)], np.uint32)
#: A place where no token can stand on both sides.
_PLACE = re.compile(rb"(?<=[\x21-\x7e])(?=[\x20\x09-\x0d])")
#: A piece with a longer run of one kind goes to the tokenizers library, whose pattern engine needs no stack.
_RUN = re.compile(rb"\s{20000}|[^\s]{20000}")


def chunks(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, stop) of the content-defined chunks of UTF-8 bytes; they end between characters."""
    start = base = 0
    while base < len(data):
        begin = max(0, base - 32)
        part = np.frombuffer(data, np.uint8, min(len(data), base + (1 << 22)) - begin, begin)
        h = _GEAR[part]
        for m in (1, 2, 4, 8, 16):
            h[m:] = h[m:] + (h[:-m] << np.uint32(m))
        for at in np.flatnonzero(h[base - begin :] >> np.uint32(32 - CHUNK_BITS) == 0) + (base + 1):
            at = int(at)
            while at < len(data) and data[at] & 0xC0 == 0x80:
                at += 1
            while at - start > CHUNK_MOST:
                stop = start + CHUNK_MOST
                while data[stop] & 0xC0 == 0x80:
                    stop += 1
                yield start, stop
                start = stop
            if at - start >= CHUNK_LEAST:
                yield start, at
                start = at
        base = begin + len(part)
    while start < len(data):
        stop = min(len(data), start + CHUNK_MOST)
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop += 1
        yield start, stop
        start = stop


def _byte_characters() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE tokenizer file, encoding without special tokens added.

    The merges are applied by the tiktoken library where the file's ids are the order of its merges, else by
    the tokenizers library."""

    def __init__(self, path: str, pattern: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        self.special = {t["content"].encode(): t["id"] for t in added}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_characters()
        level = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        ordered = all(vocab["".join(p)] == 256 + i for i, p in enumerate(pairs))
        simple = level and ordered and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.fast = None
        if simple:
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t.encode() not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={k.decode(): v for k, v in self.special.items()})
            self.split = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")") if self.special else None

    def plain(self, data: bytes) -> list[int]:
        """Ids of a part that holds no special token."""
        if not data:
            return []
        if self.fast is None or _RUN.search(data):
            return self.tokenizer.encode(data.decode(), add_special_tokens=False).ids
        return self.fast.encode_ordinary(data.decode())

    def long_plain(self, data: bytes, out: list) -> None:
        """As `plain`, in pieces that end at safe places."""
        at = 0
        while len(data) - at > 2 * PIECE and (m := _PLACE.search(data, at + PIECE)):
            out.append(np.array(self.plain(data[at : m.start()]), "<u4"))
            at = m.start()
        out.append(np.array(self.plain(data[at:]), "<u4"))

    def encode(self, data: bytes, known: dict[bytes, tuple[int, int, np.ndarray]]) -> np.ndarray:
        """Ids of a whole text; `known` has the inner part of chunks and its ids."""
        if self.fast is None:
            return np.array(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids, "<u4")
        out: list[np.ndarray] = []
        for part in self.split.split(data) if self.split else [data]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4"))
                continue
            done = 0
            if known:
                for start, stop in chunks(part):
                    if hit := known.get(part[start:stop]):
                        self.long_plain(part[done : start + hit[0]], out)
                        out.append(hit[2])
                        done = start + hit[1]
            self.long_plain(part[done:], out)
        return np.concatenate(out) if out else np.empty(0, "<u4")

    def inner(self, chunk: bytes) -> tuple[int, int, np.ndarray] | None:
        """(from, to, ids) of the part of a chunk that reads the same in every context."""
        places = [m.start() for m in _PLACE.finditer(chunk)]
        if len(places) < 2 or any(s in chunk for s in self.special):
            return None
        return places[0], places[-1], np.array(self.plain(chunk[places[0] : places[-1]]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        if self.fast is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        data = self.fast.decode_bytes(ids.tolist())
        try:
            data.decode()
        except UnicodeDecodeError:  # ids that no text encodes to
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        return data


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def frequent_chunks(docs: DataFrame, kept: int = KEPT) -> DataFrame:
    """(hash, n, doc_id, start, size) of the chunks whose reuse saves most bytes, `kept` at most. The place is
    one of the chunk's occurrences. Hashes are counted over all rows, summed per batch before the shuffle."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hash", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            n, where = Counter(), {}
            for i, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = cell.as_py()
                for a, b in chunks(data):
                    h = xxhash.xxh3_64_intdigest(data[a:b]) - (1 << 63)
                    n[h] += 1
                    if h not in where or where[h][0] is None:
                        where[h] = (i, a, b - a)
            rows = [(h, k, *where[h]) for h, k in n.items()]
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))) if rows else {c: [] for c in schema.names}, schema=schema)

    rows = docs.select("doc_id", "data").mapInArrow(counted, "hash long, n long, doc_id long, start long, size long")
    summed = rows.groupBy("hash").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "size")).alias("at")).filter("n > 1")
    saved = (F.col("n") - 1) * F.col("at.size")
    return summed.orderBy(saved.desc(), "hash").limit(kept).select("hash", "n", "at.doc_id", "at.start", "at.size")


def known_chunks(docs: DataFrame, path: str, pattern: str, kept: int = KEPT) -> dict[bytes, tuple[int, int, np.ndarray]]:
    """Frequent chunks, each encoded once; `kept` rows of at most CHUNK_MOST bytes come to the driver."""
    top = F.broadcast(stored(frequent_chunks(docs, kept), "chunks"))
    cut = F.substring("data", (F.col("start") + 1).cast("int"), F.col("size").cast("int"))
    texts = docs.join(top, "doc_id").select("hash", cut.alias("chunk"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("ids", pa.binary())])
        own = codec(path, pattern)
        for batch in batches:
            rows = []
            for h, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # ids of documents may repeat: only the text that was counted is taken
                if xxhash.xxh3_64_intdigest(chunk) - (1 << 63) == h and (got := own.inner(chunk)):
                    rows.append((chunk, got[0], got[1], got[2].tobytes()))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows))), schema=schema)

    made = texts.mapInArrow(encoded, "chunk binary, first int, last int, ids binary").distinct()
    return {bytes(r.chunk): (r.first, r.last, np.frombuffer(bytes(r.ids), "<u4")) for r in made.toLocalIterator()}


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT, with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (array<long>, if asked for), ids_sha256, decoded_sha256.

    Null text counts as empty (no ids); null and repeated ids keep their rows; an empty table gives an empty
    one; other columns are left out. Ids are those of the tokenizers library without added special tokens; a
    special token's text in a document is that token.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))
    told = docs.sparkSession.sparkContext.broadcast(known_chunks(rows, path, pattern, kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, ids_out, digest, decoded = [], [], [], []
            for cell in batch.column(1):
                ids = own.encode(cell.as_py(), told.value)
                n.append(len(ids))
                if with_ids:
                    ids_out.append(ids.astype(np.int64))
                digest.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(ids_out, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if with_ids else ""))


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of each row's `ids`; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(np.array(x or [], "<u4")).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
