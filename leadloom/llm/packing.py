"""Best-fit packing with conflicts: no two pieces of one source or one duplicate cluster share a bin.

Documents are dealt by a hash of their id into shards of about `shard_rows` rows, each packed alone: at most
the last bins of a shard stay open. In a shard longer pieces come first. Open bins are ordered by what is left
in them; the search starts at the tightest that would fit and goes on to the next larger one until the bin's
source and cluster bitmaps have neither bit of the piece. Texts do not travel, only lengths and keys.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a bin holds, documents of a shard.
CAPACITY, SHARD_ROWS = 2_048, 8_192

OUT = "doc_id long, piece int, start long, length int, shard long, bin long, position int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("shard", pa.int64()), ("bin", pa.int64()), ("position", pa.int32())])


def words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


class Shard:
    """Open bins of a shard by what is left in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.of: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.some = 0  # bit r is set if a bin with r left is open

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and position of a piece; `source` and `cluster` are bit masks."""
        at = length
        rest = self.some >> at
        while rest:
            at += (rest & -rest).bit_length() - 1
            for b in self.of[at]:
                if not self.sources[b] & source and not self.clusters[b] & cluster:
                    del self.of[at][b]
                    if not self.of[at]:
                        self.some &= ~(1 << at)
                    return self._put(b, length, source, cluster)
            at += 1
            rest = self.some >> at
        self.left.append(self.capacity), self.sources.append(0), self.clusters.append(0)
        return self._put(len(self.left) - 1, length, source, cluster)

    def _put(self, b: int, length: int, source: int, cluster: int) -> tuple[int, int]:
        position = self.capacity - self.left[b]
        self.left[b] -= length
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if self.left[b]:
            self.of[self.left[b]][b] = None
            self.some |= 1 << self.left[b]
        return b, position


def pack_shard(ids: list, lengths: list[int], sources: list, clusters: list, capacity: int) -> Iterator[tuple]:
    """(id, piece, start, length, bin, position) of all pieces. A document longer than a bin is cut into full
    bins and a rest; an empty one is a piece of length zero. Null sources and clusters conflict with nothing."""
    pieces = []
    shard = Shard(capacity)
    for i, n in enumerate(lengths):
        full = n // capacity
        for p in range(full):
            b, at = shard.place(capacity, 0, 0)
            yield ids[i], p, p * capacity, capacity, b, at
        if n % capacity or not n:
            pieces.append((-(n % capacity), ids[i] is None, ids[i] or 0, full, i))
    code = {s: 1 << j for j, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    often = Counter(c for c in clusters if c is not None)
    group = {c: 1 << j for j, c in enumerate(c for c, k in often.items() if k > 1)}  # others conflict with nothing
    for minus, _, _, full, i in sorted(pieces):
        b, at = shard.place(-minus, code.get(sources[i], 0), group.get(clusters[i], 0))
        yield ids[i], full, full * capacity, -minus, b, at


def pack(docs: DataFrame, length: Column, source: Column, cluster: Column, id_col: str = "doc_id", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces of all rows: doc_id, piece, start and length in the document, shard, bin (of the shard), position.

    `length` null counts as zero, `source` and `cluster` null conflict with nothing. Null ids are dealt by the
    row's number; repeated rows are documents each. An empty table gives an empty one. A bin is (shard, bin).
    """
    items = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0).cast("long")).alias("n"), source.cast("string").alias("source"), F.xxhash64(cluster).alias("cluster"), cluster.isNull().alias("alone")
    )
    shards = max(1, math.ceil(docs.count() / shard_rows))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(shards)).cast("long"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def close() -> Iterator[pa.RecordBatch]:
            ids, n, source, cluster = ([x for r in rows for x in r[c]] for c in range(4))
            out = list(pack_shard(ids, n, source, cluster, capacity))
            for i in range(0, len(out), 50_000):
                doc, piece, start, size, b, at = zip(*out[i : i + 50_000])
                yield pa.RecordBatch.from_pydict({"doc_id": doc, "piece": piece, "start": start, "length": size, "shard": [now] * len(doc), "bin": b, "position": at}, schema=_SCHEMA)

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
            for i, j in zip(cuts, [*cuts[1:], len(shard)]):
                if shard[i] != now:
                    if rows:
                        yield from close()
                    now, rows = int(shard[i]), []
                part = batch.slice(i, j - i)
                alone = part.column("alone").to_pylist()
                cluster = [None if a else c for a, c in zip(alone, part.column("cluster").to_pylist())]
                rows.append((part.column("doc_id").to_pylist(), part.column("n").to_pylist(), part.column("source").to_pylist(), cluster))
        if rows:
            yield from close()

    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "n", "source", "cluster").mapInArrow(packed, OUT)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Documents by their words, with `source` as source and equal texts as duplicate clusters."""
    return pack(docs, words_of(F.col("text")), F.col("source"), F.md5(F.col("text").cast("binary")), capacity=capacity, shard_rows=shard_rows)


def bin_texts(packed: DataFrame, docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(shard, bin, text): the pieces of each bin joined in order; a bin has at most its capacity in words.
    Ids of `docs` must be unique."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), " ")
    met = packed.join(docs.select("doc_id", words.alias("words")), "doc_id")
    piece = F.array_join(F.slice("words", F.col("start").cast("int") + 1, F.col("length")), " ")
    met = met.select("shard", "bin", F.struct("position", "doc_id", piece.alias("text")).alias("p"))
    return met.groupBy("shard", "bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]), separator).alias("text"))
