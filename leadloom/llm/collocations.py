"""Phrase collocations by top-order marginalisation.

From every word on, the window of `LONGEST` words (padded where its piece ends) is counted once; no shorter
n-gram is ever exploded. ROLLUP sums the counts of the windows to those of their prefixes, which are all shorter
phrases: each occurrence of a phrase is the prefix of exactly one window.

Only phrases whose words and neighbouring pairs all reach the least frequency can be wanted. A first scan counts
words, and pairs by a 40-bit hash (so that a count is never too low); a window ends where a word or a pair is
rarer. Tasks look this up in bitmaps of fixed size: fuller ones let more through and change no result. Equal
windows of a block are counted before they are shuffled; they meet by their first pair, a common one in several
parts. Where a triple turns out rare, its windows are cut to the pair before ROLLUP.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import bitmap_of, bounded_batches, join_spread, stored

LONGEST, LEAST, MOST, COVER = 4, 30, 2_000, 80
BITMAP_BITS = 1 << 26
#: Words of the texts that a task counts together; distinct words that it holds; bytes of a long text split at once.
BLOCK, WORDS, SEGMENT = 2_000_000, 500_000, 1 << 21
#: Rows of an Arrow batch that leaves a task; bits of a pair's hash.
ROWS_OUT, PAIR_BITS = 50_000, 40
#: Tasks among which the windows of one first pair are dealt, by their third word.
PAIR_PARTS = 8
#: A-Z lower-cased; marks and line ends become a line end, tabs a blank.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_END = b"\n"
_ODD = np.random.default_rng(6).integers(1 << 62, 1 << 63, LONGEST, dtype=np.uint64) | np.uint64(1)


class Vocabulary(dict):
    """Numbers of the words of one block in order of appearance: 0 ends a piece, 1 is what blanks leave."""

    def __init__(self) -> None:
        super().__init__({_END: 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, cells: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.__getitem__, cells), np.int32, len(cells))
        return ids[ids != 1]


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words and piece ends of the text, in parts of bounded size."""
    text = text.translate(_BYTES).replace(_END, b" \n ")
    begin = 0
    while begin >= 0:
        end = text.find(b" ", begin + SEGMENT) if len(text) - begin > SEGMENT else -1
        yield (text[begin:] if end < 0 else text[begin:end]).split(b" ")
        begin = end


def _blocks(batches: Iterator[pa.RecordBatch], ahead: int) -> Iterator[list[tuple[str, list[bytes], np.ndarray, int]]]:
    """Blocks of (language, its words, their numbers in order of the texts, how many of the last begin no window
    here): where a text goes on in the next block, its last `ahead` words stand in both and begin their windows in
    the second. Words are held as numbers, so that a block may be large."""
    held: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
    size = 0

    def cut(open_lang: str | None) -> list[tuple[str, list[bytes], np.ndarray, int]]:
        out, carry = [], []
        for lang, (words, parts) in held.items():
            told, ids = list(words), np.concatenate(parts)
            own = [told[i] for i in ids[-ahead:]] if ahead and lang == open_lang else []
            out.append((lang, told, ids, len(own)))
            carry = carry or own
        held.clear()
        if carry:
            words = Vocabulary()
            held[open_lang] = words, [words.numbers(carry)]
        return out

    for batch in batches:
        for lang, cell in zip(batch.column("lang").to_pylist(), batch.column("data")):
            for part in tokens(cell.as_py()):
                if size >= BLOCK or sum(len(words) for words, _ in held.values()) > WORDS:
                    yield cut(lang)
                    size = 0
                if lang not in held:
                    held[lang] = Vocabulary(), []
                words, parts = held[lang]
                parts.append(words.numbers(part))
                size += len(parts[-1])
            parts.append(np.zeros(1, np.int32))
    if held:
        yield cut(None)


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array([b"", *words[1:]], pa.binary()).cast(pa.string())


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    own = lang.encode() + _END
    return np.fromiter((xxhash.xxh64_intdigest(own + w, 42) for w in words), np.uint64, len(words))  # as Spark's xxhash64


def _pairs(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = hashes[a] * _ODD[0] + hashes[b] * _ODD[1]
    return ((h ^ h >> np.uint64(31)) * _ODD[2] >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of words (lang, word) and of hashed pairs (pair), with their counts in a block."""
    for block in _blocks(batches, 1):
        for lang, words, ids, skip in block:
            counts = np.bincount(ids[: len(ids) - skip], minlength=len(words))
            at = np.flatnonzero(counts[2:]) + 2
            none = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(at), pa.string()), "word": _strings(words).take(pa.array(at)), "pair": none(len(at), pa.int64()), "n": pa.array(counts[at], pa.int64())})
            a, b = ids[:-1], ids[1:]
            both = (a > 0) & (b > 0)
            pair, n = np.unique(_pairs(_hashes(lang, words), a[both], b[both]), return_counts=True)
            for i in range(0, len(pair), 4 * ROWS_OUT):
                part = slice(i, i + 4 * ROWS_OUT)
                size = len(pair[part])
                yield pa.RecordBatch.from_pydict({"lang": none(size, pa.string()), "word": none(size, pa.string()), "pair": pa.array(pair[part]), "n": pa.array(n[part].astype(np.int64))})


def word_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(F.concat(lang, F.lit("\n"), word))


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted_windows(bits: Callable) -> Callable:
    """Distinct windows of a block of frequent words and pairs, with their counts; a window is its words joined.
    `meet` deals them: bits of the hash of the first pair, and one of PAIR_PARTS by the third word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_held, pairs_held = (np.frombuffer(b, np.uint8) for b in bits())
        for block in _blocks(batches, LONGEST - 1):
            for lang, told, ids, skip in block:
                hashes = _hashes(lang, told)
                common = _held(words_held, hashes)
                common[:2] = False
                ids[~common[ids]] = 0  # a rarer word ends a window as the end of the piece does
                lead = [np.r_[ids[k:], np.zeros(k, np.int32)] for k in range(LONGEST)]
                linked = (lead[0] > 0) & (lead[1] > 0)
                linked[linked] = _held(pairs_held, _pairs(hashes, lead[0][linked], lead[1][linked]))
                linked = np.r_[linked, np.zeros(LONGEST, bool)]
                for k in range(1, LONGEST):  # the word k is in the window if the words before it are and its pair is frequent
                    lead[k][~linked[k - 1 : k - 1 + len(ids)] | (lead[k - 1] == 0)] = 0
                begin = np.flatnonzero(lead[1][: len(ids) - skip])
                if not len(begin):
                    continue
                a, b, c, d = (x[begin].astype(np.int64) for x in lead)
                high, low = a << 32 | b, c << 32 | d
                order = np.lexsort((low, high))
                high, low = high[order], low[order]
                new = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
                n = np.diff(np.r_[new, len(high)])
                strings = _strings(told)
                parts = hashes % np.uint64(PAIR_PARTS)
                for i in range(0, len(new), ROWS_OUT):
                    x, y = high[new[i : i + ROWS_OUT]], low[new[i : i + ROWS_OUT]]
                    cells = [strings.take(pa.array(z)) for z in (x >> 32, x & 0xFFFFFFFF, y >> 32, y & 0xFFFFFFFF)]
                    joined = pc.ascii_rtrim(pc.binary_join_element_wise(*cells, " "), characters=" ")
                    meet = (_pairs(hashes, x >> 32, x & 0xFFFFFFFF) >> 20) * PAIR_PARTS + parts[y >> 32].astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"meet": pa.array(meet.astype(np.int32)), "lang": pa.array([lang] * len(x), pa.string()), "words": joined, "n": pa.array(n[i : i + ROWS_OUT].astype(np.int64))})

    return run


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, bitmap_bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to `LONGEST` words with f >= `least`; (lang, n) with all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))
    with bounded_batches(spark):
        each = rows.mapInArrow(_counted_words, "lang string, word string, pair long, n long")
        counts = each.groupBy("lang", "word", "pair").agg(F.sum("n").alias("f"))
        counts = stored(counts.filter(F.col("pair").isNull() | (F.col("f") >= least)), "counts")
        words = counts.filter("pair is null")
        totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        common = words.filter(F.col("f") >= least)
        hashed = common.select(word_hash(F.col("lang"), F.col("word")).alias("h"))
        told = spark.sparkContext.broadcast((bitmap_of(hashed, "h", bitmap_bits), bitmap_of(counts.filter("pair is not null"), "pair", bitmap_bits)))
        windows = rows.mapInArrow(_counted_windows(lambda: told.value), "meet int, lang string, words string, n long").repartition("meet")
        # all windows of a triple are in this task: those of a rare one count for its first pair only
        head = lambda k: F.substring_index("words", " ", k)
        whole = windows.groupBy("meet", "lang", "words").agg(F.sum("n").alias("n")).withColumn("head", head(3))
        whole = whole.withColumn("n3", F.sum("n").over(Window.partitionBy("meet", "lang", "head")))
        top = whole.withColumn("words", F.when(F.col("n3") < least, head(2)).otherwise(F.col("words")))
        lead = F.split("words", " ")
        top = top.select("lang", *[F.coalesce(F.get(lead, F.lit(k)), F.lit("")).alias(f"w{k + 1}") for k in range(LONGEST)], "n")
        rolled = spark.sql("""
            SELECT lang, w1, w2, w3, w4, CASE grouping_id() WHEN 3 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS size, sum(n) AS f
            FROM {top} GROUP BY lang, w1, w2, ROLLUP (w3, w4)
            HAVING sum(n) >= {least} AND coalesce(w3, ' ') <> '' AND coalesce(w4, ' ') <> ''""", top=top, least=least)
        phrases = rolled.select("lang", F.concat_ws(" ", "w1", "w2", "w3", "w4").alias("phrase"), "size", "f")
        single = common.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")
        return stored(phrases.unionByName(single), "phrases"), totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = MOST, cover: int = COVER, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases of 2 to 4 words.

    a, l, r are the frequencies of the phrase and of the two parts of its lowest-scoring cut, n all words of the
    language, score floor(2000000 a / (l + r)). Phrases that stand inside a longer one with at least `cover` %
    of their frequency are dropped. Null texts have no words, a null lang is `und`; repeated rows count each;
    ties go by frequency, then by the phrase's bytes. An empty table gives an empty one; other columns are left out.
    """
    counts, totals = phrase_counts(docs, lang_col, text_col, least, **options)
    found = counts.filter("size > 1").withColumnRenamed("f", "a")
    words = found.withColumn("w", F.split("phrase", " "))
    cuts = words.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = join_spread(cuts, part("first", "l"), ["lang", "first"], by=["phrase", "k"])
    both = join_spread(both, part("rest", "r"), ["lang", "rest"], by=["phrase", "k"])
    # a, l and r have up to 18 digits: products in whole numbers of 38
    score = F.expr("CAST(CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))) AS LONG)")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inside = words.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.expr(f"CAST(longer AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {int(cover)}")
    own = lowest.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = own.select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
