"""Exact top-k search by distributed histogram selection.

Vectors are integers floor(256 x). Blocks of candidates score all queries, which stream past them in blocks of
their own; no score is kept. Each round tasks count the scores of every query in equal bins of the query's
current interval, from the top down to where the task itself has enough; the sums over all tasks tell the bin
that holds the k-th score, which is the next interval. After a few rounds the interval is one number, the exact
k-th score. A last scan keeps what is above it and as many at it as are missing, smaller ids first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import stored

#: Candidates that score together, queries that pass them at once, bins of a round.
CANDIDATES, QUERIES, BINS = 4_096, 512, 512


def whole_numbers(embedding: Column, scale: int = 256) -> Column:
    """array<long> floor(scale * x) with x as double; null if the vector is null or holds a null or non-finite component."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(cells: pa.Array, width: int) -> np.ndarray:
    flat = cells.flatten().to_numpy().astype(np.float64)
    sizes = np.diff(cells.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))  # shorter vectors count as padded with zeros
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else []] = flat
    return out


def _against(routed: DataFrame, width: int, exact: bool, each: Callable, schema: str) -> DataFrame:
    """`each(query columns, scores, candidate ids)` for all blocks; rows come sorted by (part, candidates first)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, own = None, [], []
        for batch in batches:
            p, asks = batch.column("part").to_numpy(), batch.column("asks").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (asks[1:] != asks[:-1])]) if len(p) else []
            for i, j in zip(cuts, [*cuts[1:], len(p)]):
                if p[i] != part:
                    part, ids, own = p[i], [], []
                rows = batch.slice(i, j - i)
                m = _matrix(rows.column("v"), width)
                if not asks[i]:
                    ids.append(rows.column("id").to_numpy()), own.append(m)
                    continue
                if not own:
                    continue
                if len(own) > 1:
                    ids, own = [np.concatenate(ids)], [np.concatenate(own)]
                for a in range(0, len(m), QUERIES):
                    q = rows.slice(a, QUERIES)
                    if exact:
                        scores = np.rint(m[a : a + QUERIES] @ own[0].T).astype(np.int64)
                    else:  # beyond the whole numbers of a double
                        scores = m[a : a + QUERIES].astype(np.int64) @ own[0].astype(np.int64).T
                    yield from each(q, scores, ids[0])

    return routed.mapInArrow(run, schema)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", bins: int = BINS, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every row for which `queries`
    holds, against all other rows; all of them if there are fewer; ties go to the smaller vec_id.

    Vectors that are null or hold a null or non-finite component take no part, nor do null ids; vectors of
    other lengths count as padded with zeros. A query's own id is left out, repeats of it too; other repeated
    rows are candidates each. An empty table, or one without queries, gives an empty one; other columns are
    left out. Scores must fit a long.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col)).alias("v"), queries.alias("q")).filter("id is not null and v is not null")
    rows = stored(rows, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.sqrt(square))).first()
    if not n or not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = math.ceil(longest * longest) + 1  # no score is beyond it
    parts = max(1, math.ceil(n / candidates))
    asking = stored(rows.filter("q").select("id", "v").dropDuplicates(["id"]), "asking")
    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.lit(0).cast("byte").alias("asks"), "id", "v")
    # the state of a query: its interval [low, low + span), and how many scores are above it
    state = asking.select("id", F.lit(-bound).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))
    exact = bound < 1 << 53
    span = 2 * bound + 1

    def routed(state: DataFrame) -> DataFrame:
        asks = asking.join(state, "id").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).cast("byte").alias("asks"), "id", "v", "low", "above")
        every = own.withColumns({"low": F.lit(0).cast("long"), "above": F.lit(0).cast("long")}).unionByName(asks)
        return every.repartition(parts, "part").sortWithinPartitions("part", "asks", "id")

    while span > 1:
        step = math.ceil(span / bins)

        def counted(q: pa.RecordBatch, scores: np.ndarray, ids: np.ndarray, step: int = step, span: int = span) -> Iterator[pa.RecordBatch]:
            qid, low = q.column("id").to_numpy(), q.column("low").to_numpy()
            over = scores - low[:, None]
            bin_of = np.where(over < 0, -1, np.where(over < span, over // step, bins))  # bins: above the interval, counted before
            bin_of[qid[:, None] == ids[None, :]] = -1
            hist = np.bincount((bin_of + 1 + np.arange(len(qid))[:, None] * (bins + 2)).ravel(), minlength=len(qid) * (bins + 2)).reshape(-1, bins + 2)[:, 1:-1]
            higher = hist[:, ::-1].cumsum(axis=1)[:, ::-1] - hist  # in higher bins of this task
            row, at = np.nonzero((hist > 0) & (higher < k))
            yield pa.RecordBatch.from_pydict({"id": qid[row], "bin": at, "n": hist[row, at]}, schema=pa.schema([("id", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())]))

        bins_of = _against(routed(state), width, exact, counted, "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        # at most `bins` rows of a query: the running sum from the top tells the bin of the k-th score
        w = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        run = bins_of.join(state, "id").withColumn("before", F.col("above") + F.coalesce(F.sum("n").over(w), F.lit(0)))
        hit = run.filter((F.col("before") < k) & (F.col("before") + F.col("n") >= k)).select("id", (F.col("low") + F.col("bin") * step).alias("new_low"), F.col("before").alias("new_above"))
        nxt = state.join(hit, "id", "left")
        # fewer than k scores in all: everything from the bottom counts
        state = stored(nxt.select("id", F.coalesce("new_low", "low").alias("low"), F.coalesce("new_above", "above").alias("above")), "state")
        span = step

    def chosen(q: pa.RecordBatch, scores: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        qid, low = q.column("id").to_numpy(), q.column("low").to_numpy()
        ok = (scores >= low[:, None]) & (qid[:, None] != ids[None, :])
        row, at = np.nonzero(ok)
        score, vec = scores[row, at], ids[at]
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        start = np.r_[True, row[1:] != row[:-1]][: len(row)]
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(start, np.arange(len(row)), 0)) if len(row) else row
        first = place < k  # a task's own k best hold its share of the ties
        yield pa.RecordBatch.from_pydict({"query_id": qid[row[first]], "vec_id": vec[first], "score": score[first]})

    found = _against(routed(state), width, exact, chosen, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
