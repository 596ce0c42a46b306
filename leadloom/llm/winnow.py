"""Benchmark decontamination by winnowing.

Of every window of `WINDOW - K + 1` consecutive word k-grams the ones of least hash are fingerprints, in
documents and benchmark alike, so that any shared run of `WINDOW` words shares a fingerprint. Fingerprints of
documents pass a bitmap of fixed size of the benchmark's, what is left meets the benchmark's by hash, and each
meeting is extended word by word, as far as the windows around the fingerprint reach. Items shorter than a
window are one k-gram of their own length each, as winnowing with windows of one k-gram.

Texts are scanned once; what is shuffled are fingerprints that the bitmap let pass, with the words around them.
A fuller bitmap lets more pass and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import bitmap_of, bounded_batches, hex_sha256, join_spread, stored

#: Words of a window, words of a fingerprint, bits of the bitmap (8 MB).
WINDOW, K, BITMAP_BITS = 10, 5, 1 << 26
#: Bytes of a long text that are split at once; words that are fingerprinted together.
SEGMENT, BLOCK = 1 << 21, 200_000
#: A-Z lower-cased; what is no word byte becomes a blank. Bytes of characters beyond ASCII are word bytes.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

_FIELDS = [("row", pa.int64()), ("id", pa.string()), ("n_words", pa.int64()), ("size", pa.int32()), ("hash", pa.int64()), ("pos", pa.int64()),
           ("before", pa.list_(pa.string())), ("words", pa.string()), ("after", pa.list_(pa.string()))]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "row long, id string, n_words long, size int, hash long, pos long, before array<string>, words string, after array<string>"


class WordHashes(dict):
    """64-bit hash of a word; kept for words seen before, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def word_pieces(text: bytes, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """(position of its first word, words) of pieces of the text; each repeats the last `overlap` words before it."""
    text = text.translate(_BYTES)
    begin, first, tail = 0, 0, []
    while True:
        end = text.find(b" ", begin + SEGMENT) if len(text) - begin > SEGMENT else -1
        words = tail + (text[begin:] if end < 0 else text[begin:end]).split()
        yield first, words
        if end < 0:
            return
        tail = words[-overlap:]
        first += len(words) - len(tail)
        begin = end


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on."""
    n = len(h) - size + 1
    g = np.full(max(n, 0), size, np.uint64)
    for j in range(size if n > 0 else 0):
        g = (g ^ h[j : j + n]) * _ODD[j]
        g ^= g >> np.uint64(29)
    return g * _ODD[-1] ^ (g >> np.uint64(32))


def fingerprints(h: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are least in some window inside a piece (all of equal hash)."""
    if len(h) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g, span = gram_hashes(h, K), WINDOW - K + 1
    n = len(h) - WINDOW + 1
    least = g[:n].copy()
    for j in range(1, span):
        np.minimum(least, g[j : j + n], out=least)
    whole = piece[:n] == piece[WINDOW - 1 :]
    chosen = np.zeros(len(g), bool)
    for j in range(span):
        chosen[j : j + n] |= whole & (g[j : j + n] == least)
    at = np.flatnonzero(chosen)
    return at, g[at]


def _marks(bits: Callable | None, sizes: list[int]) -> Callable:
    """For each text one row with its number of words, and one per fingerprint. With `bits` (documents), those
    that it holds, and all k-grams of the lengths `sizes`; without (benchmark), short texts as one k-gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        held = None if bits is None else np.frombuffer(bits(), np.uint8)
        for batch in batches:
            rows, ids = batch.column("row").to_pylist(), batch.column("id").to_pylist()
            heads: list[tuple] = []
            words: list[bytes] = []
            pieces: list[tuple] = []  # row, position of the first word, begin and end in `words`

            def flush() -> Iterator[pa.RecordBatch]:
                out = heads + list(_block(words, pieces, known, held, sizes))
                heads.clear(), words.clear(), pieces.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

            for row, name, cell in zip(rows, ids, batch.column("data")):
                n = 0
                for first, own in word_pieces(cell.as_py(), WINDOW - 1):
                    n = first + len(own)
                    pieces.append((row, name, first, len(words), len(words) + len(own)))
                    words += own
                    if len(words) > BLOCK:
                        yield from flush()
                heads.append((row, name, n, *[None] * 6))
            yield from flush()

    return run


def _block(words: list[bytes], pieces: list[tuple], known: WordHashes, held: np.ndarray | None, sizes: list[int]) -> Iterator[tuple]:
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    begins, ends = np.array([p[3] for p in pieces], np.int64), np.array([p[4] for p in pieces], np.int64)
    piece = np.repeat(np.arange(len(pieces)), ends - begins)
    found = [(0, *fingerprints(h, piece))]
    for m in sizes:
        g = gram_hashes(h, m)
        at = np.flatnonzero(piece[: len(g)] == piece[m - 1 :]) if len(g) else np.empty(0, np.int64)
        if held is None:  # a short item is one k-gram: its piece has no other words
            at = at[(ends - begins)[piece[at]] == m] if len(at) else at
        found.append((m, at, g[at]))
    text = lambda cells: [w.decode() for w in cells]
    for m, at, g in found:
        if held is not None and len(at):
            slot = g & np.uint64(len(held) * 8 - 1)
            passed = (held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at, g = at[passed], g[passed]
        reach, size = (0, m) if m else (WINDOW - K, K)
        for i, value in zip(at.tolist(), g.view(np.int64).tolist()):
            row, name, first, begin, end = pieces[piece[i]]
            before, after = words[max(begin, i - reach) : i], words[i + size : min(end, i + size + reach)]
            yield row, name, None, size if m else WINDOW, value, first + i - begin, text(before[::-1]), b" ".join(words[i : i + size]).decode(), text(after)


def _scanned(df: DataFrame, id_col: str, text_col: str, bits: Callable | None, sizes: list[int]) -> DataFrame:
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))
    with bounded_batches(df.sparkSession):
        return stored(rows.mapInArrow(_marks(bits, sizes), _DDL), "marks")


def _shared(a: str, b: str) -> Column:
    """How many leading elements of two arrays are equal."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a).cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit (words inside a window of an item), n_items, items
    (array<string>, sorted), contaminated (n_hit > 0).

    Null and empty texts have no words. Repeated rows and null ids of documents keep their rows; items that
    share an id count once, items without an id count towards n_hit only. An empty table of documents gives an
    empty one, an empty benchmark hits nothing; other columns are left out.
    """
    spark = docs.sparkSession
    items = _scanned(benchmark, item_col, item_text_col, None, list(range(1, WINDOW)))
    grams = items.filter("size is not null")
    # what items share word by word is one context
    contexts = stored(grams.groupBy("size", "hash", "before", "words", "after").agg(F.min("row").alias("first"), F.min("pos").alias("at")).withColumn("context", F.monotonically_increasing_id()).drop("first", "at"), "contexts")
    names = stored(grams.filter("id is not null").join(contexts, ["size", "hash", "before", "words", "after"]).select("context", "id").distinct(), "items")
    sizes = [r["size"] for r in contexts.filter(F.col("size") < WINDOW).select("size").distinct().collect()]  # nine at most
    told = spark.sparkContext.broadcast(bitmap_of(contexts, "hash", bitmap_bits))
    scan = _scanned(docs, id_col, text_col, lambda: told.value, sorted(sizes))
    marks = scan.filter("size is not null").select("row", "size", "hash", "pos", "before", "words", "after")
    theirs = contexts.select("size", "hash", F.col("before").alias("b2"), F.col("words").alias("w2"), F.col("after").alias("a2"), "context")
    met = join_spread(marks, theirs, ["size", "hash"], by=["row", "pos"]).filter("words = w2")
    met = met.withColumns({"back": _shared("before", "b2"), "on": _shared("after", "a2")})
    long = F.col("size") == WINDOW
    hits = met.filter(~long | (F.col("back") + K + F.col("on") >= WINDOW)).select(
        "row", "context", (F.col("pos") - F.col("back")).alias("begin"), (F.col("pos") + F.when(long, F.lit(K) + F.col("on")).otherwise(F.col("size"))).alias("end"))
    hits = stored(hits, "hits")
    reached = F.max("end").over(Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest(F.col("begin"), F.coalesce("reached", F.lit(0).cast("long"))))
    covered = hits.groupBy("row", "begin").agg(F.max("end").alias("end")).withColumn("reached", reached).groupBy("row").agg(F.sum(fresh).alias("hit"))
    pairs = stored(hits.select("row", "context").distinct(), "pairs")
    whose = join_spread(pairs, names, ["context"], by=["row"]).select("row", "id").distinct()
    listed = whose.groupBy("row").agg(F.array_sort(F.collect_list("id")).alias("listed"))
    out = scan.filter("n_words is not null").select("row", F.col("id").alias("doc_id"), "n_words").join(covered, "row", "left").join(listed, "row", "left")
    return out.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("listed"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("listed", F.array().cast("array<string>")).alias("items"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """As `contamination`, with the SHA-256 of the comma-joined items in place of the items."""
    found = contamination(docs, benchmark, **options)
    return found.select("doc_id", "n_words", "n_hit", "n_items", hex_sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")
