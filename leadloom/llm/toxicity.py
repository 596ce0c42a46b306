"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features are the distinct words, their five-letter stems (word forms that a small sample has not seen), word
pairs and pairs with one word between.

The model is fitted on a bounded sample of labelled rows (about `sample_rows` of each class, by a share of the
range of their ids' hashes; texts enter whole). Each pass visits the sample in a fixed order with
per-coordinate learning rates; L1 keeps most weights at exactly zero, so that what is broadcast is the list of
the others, bounded by 2 ** BITS. Scoring runs over whole texts in the tasks that read them, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import fresh, own_columns, small_batches
from leadloom.llm.simhash import word_blocks

#: Hashed feature space; rows of each class that the fit may take; passes over them.
BITS, SAMPLE_ROWS, PASSES = 18, 6_000, 4
#: Learning rates and penalties; the rarer class weighs as the square root of the classes' ratio says.
ALPHA, BETA, L1, L2, BALANCE = 1.0, 1.0, 12.0, 1.0, 0.5
STEM = 5
#: A row is for learning if crc32 of its id as text is not divisible by FOLDS.
FOLDS = 5

_EDGE = b" .,;:!?\"'()[]{}<>-*_#"
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


class Words(dict):
    """Hashes of a word without marks at its ends and of its stem; kept for words seen before, up to a bound."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        bare = word.strip(_EDGE)
        stem = bare.decode("utf-8", "replace")[:STEM].encode()
        self[word] = pair = (xxhash.xxh64_intdigest(bare, 11), xxhash.xxh64_intdigest(stem, 12))
        return pair


def features(text: bytes, words: Words) -> np.ndarray:
    """Distinct slots of the text's words, stems, word pairs and pairs with one word between."""
    found, carry = [], np.empty(0, np.uint64)
    shift = np.uint64(64 - BITS)
    for block in word_blocks(text):
        both = np.array([words[w] for w in block], np.uint64).reshape(-1, 2)
        h = np.concatenate([carry, both[:, 0]])
        found.append(np.unique(both.ravel() * _ODD[0] >> shift))
        for gap in (1, 2):
            if len(h) > gap:
                found.append(np.unique((h[:-gap] * _ODD[gap] + h[gap:] * _ODD[0]) * _ODD[3 - gap] >> shift))
        carry = h[-2:]
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.empty(0, np.int64)


@dataclass
class Model:
    """Weights that are not zero, by slot, and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.slots] = self.weights
        return out


def _probability(margin: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0)))


def fit_rows(rows: list[tuple[np.ndarray, int]], passes: int = PASSES) -> Model:
    """FTRL-proximal over (slots, label) rows in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weights(slots: np.ndarray) -> np.ndarray:
        zs = z[slots]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[slots])) / ALPHA + L2))

    ones = sum(y for _, y in rows)
    zeros = len(rows) - ones
    for _ in range(passes):
        for slots, y in rows:
            w = weights(slots)
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            error = _probability(bias + w.sum()) - y
            if ones and zeros:
                error *= (len(rows) / (2.0 * (ones if y else zeros))) ** BALANCE
            g = error
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            z[slots] += g - sigma * w
            n[slots] += g * g
            sigma = (np.sqrt(bias_n + error * error) - np.sqrt(bias_n)) / ALPHA
            bias_z += error - sigma * bias
            bias_n += error * error
    every = np.arange(1 << BITS)
    w = weights(every)
    kept = np.flatnonzero(w)
    return Model(kept, w[kept], float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold; null ids and labels take no part. Features are made
    where the rows are read; the sampled ones meet in one task, which is bounded by the sample."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)").filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64("id", F.lit(17))
    # a share of the hash range that holds about sample_rows rows of the class
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: int(min(1.0, sample_rows / max(1, sizes.get(y, 0))) * (1 << 31)) for y in (0, 1)}
    sample = F.broadcast(known.filter(F.pmod(order, F.lit(1 << 31)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0])))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = texts.join(sample, "id").select("id", "y", "text", order.alias("at"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            yield pd.DataFrame({"at": b["at"], "id": b["id"], "y": b["y"], "slots": [features(t, words).tolist() for t in b["text"]]})

    made = rows.mapInPandas(featured, "at long, id long, y int, slots array<int>")

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(at, i, y, np.asarray(s, np.int64)) for b in batches for at, i, y, s in zip(b["at"], b["id"], b["y"], b["slots"])]
        got.sort(key=lambda r: (r[0], r[1], r[2], len(r[3])))
        model = fit_rows([(s, int(y)) for _, _, y, s in got])
        yield pd.DataFrame({"slots": [model.slots.tolist()], "weights": [model.weights.tolist()], "intercept": [model.intercept]})

    row = made.repartition(1).mapInPandas(learned, "slots array<int>, weights array<double>, intercept double").first()
    if row is None:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0)
    return Model(np.array(row.slots, np.int64), np.array(row.weights), row.intercept)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Probability of label 1 of every text; null counts as empty."""
    told = docs.sparkSession.sparkContext.broadcast((model.slots, model.weights, model.intercept))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*told.value)
        w, words = own.dense(), Words()
        for texts in batches:
            out = []
            for t in texts:
                slots = features(t, words)
                out.append(_probability(own.intercept + w[slots].sum()))
            yield pd.Series(out, dtype="float64")

    return run(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts get the score of no features. A null id is not held out and never learned from.
    Without labels of both classes the scores are what the intercept says, 0.5 without any. Repeated rows are
    each scored; an empty table gives an empty one; other columns are left out.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, **options)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of `docs` that score below 0.5, all columns; those but id and text may have any name."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, **options)
    own = fresh(docs, "_score")[0]
    return docs.withColumn(own, score(docs, model, text_col)).filter(F.col(own) < 0.5).select(own_columns(docs))
