"""Vector code compression: product codebooks trained by ball k-means in whole numbers.

A codebook entry and the parts assigned to it are a ball. Its radius bounds which entries can be nearer to any
of its parts (neighbours: entries within two radii). A part nearer to its entry than half the way to the nearest
neighbour is in the stable core and skips the round; any other lies in an annular ring between two half ways
and is compared with the neighbours inside that ring only. All distances are squared whole numbers, so that the
result equals that of full comparison, ties included.

Codebooks are of fixed size and live on the driver; vectors, codes and distances are a table of each round. Sums,
counts and radii of the balls are one aggregation with partial sums in each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import bounded_batches, join_spread, stored
from leadloom.llm.topk import whole_numbers

SCALE, PARTS, ENTRIES, ROUNDS = 1_024, 4, 256, 4
#: Vectors of one Arrow batch.
BATCH = 16_384


@dataclass
class Balls:
    """Neighbours of every entry of one codebook, nearest first, with squared distances between the entries."""

    neighbours: list[np.ndarray]
    distances: list[np.ndarray]


def balls(book: np.ndarray, radii: np.ndarray) -> Balls:
    """`radii`: an upper bound of the distance of an entry's parts to it; below zero for an entry without parts."""
    between = squared(book, book)
    near, far = [], []
    for e, r in enumerate(radii):
        own = np.flatnonzero(between[e] <= 4 * r * r * (1 + 1e-9) + 1) if r >= 0 else np.empty(0, np.int64)
        own = own[own != e]
        own = own[np.argsort(between[e][own], kind="stable")]
        near.append(own)
        far.append(between[e][own])
    return Balls(near, far)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `x` to all entries; exact for the whole numbers that `checked` lets pass."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, ties to the lower index, and squared distance, from all entries."""
    d = squared(x, book)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


def moved(x: np.ndarray, code: np.ndarray, book: np.ndarray, near: Balls) -> tuple[np.ndarray, np.ndarray]:
    """As `nearest`, from the entry that each part had before and the entries of its ring."""
    own = ((x - book[code]) ** 2).sum(1)
    best, least = code.copy(), own.copy()
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order], prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(order)]):
        rows, e = order[i:j], code[order[i]]
        # ring: how many neighbours are within twice the distance of the part (an equal one may win by its index)
        ring = np.searchsorted(near.distances[e], 4 * own[rows], side="right")
        rows, ring = rows[ring > 0], ring[ring > 0]  # the others are in the stable core
        width = 1
        while len(rows):
            inside = ring <= width  # rings are taken together up to powers of two
            if inside.any():
                ids = near.neighbours[e][:width]
                d = squared(x[rows[inside]], book[ids]).astype(own.dtype)
                beyond = np.arange(len(ids))[None, :] >= ring[inside][:, None]
                far = np.where(beyond, np.iinfo(np.int64).max if d.dtype.kind == "i" else np.inf, d)
                low = far.min(1)
                which = np.where(far == low[:, None], ids[None, :], len(book)).min(1)
                now = rows[inside]
                wins = (low < least[now]) | ((low == least[now]) & (which < best[now]))
                best[now[wins]], least[now[wins]] = which[wins], low[wins]
                rows, ring = rows[~inside], ring[~inside]
            width *= 2
    return best, least


def checked(most: int, width: int) -> type:
    """The number type in which squared distances of components up to `most` are exact."""
    bound = 16 * max(1, width) * max(1, most) ** 2
    if bound < 1 << 53:
        return np.float64
    if bound < 1 << 63:
        return np.int64
    raise ValueError("components are too large for squared distances in 64 bits")


def _assigned(books: np.ndarray, near: list[Balls] | None, kind: type) -> Callable:
    parts, _, width = books.shape
    own = [b.astype(kind) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column("v").flatten().to_numpy().reshape(n, parts, width).astype(kind)
            before = None if near is None else batch.column("code").flatten().to_numpy().reshape(n, parts)
            code, dist = np.empty((n, parts), np.int32), np.empty((n, parts), np.int64)
            for p in range(parts):
                part = np.ascontiguousarray(x[:, p])
                code[:, p], dist[:, p] = nearest(part, own[p]) if near is None else moved(part, before[:, p], own[p], near[p])
            cells = pa.array(range(0, n * parts + 1, parts), pa.int32())
            columns = [batch.column(c) for c in ("vec_id", "label", "v")]
            columns += [pa.ListArray.from_arrays(cells, pa.array(code.ravel())), pa.ListArray.from_arrays(cells, pa.array(dist.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "code", "dist"])

    return run


def _updated(table: DataFrame, books: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Entries moved to the floor of the mean of their parts, and a bound of the radius of each ball about them."""
    parts, entries, width = books.shape
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(
        p.alias("p"), F.get("code", p).alias("e"), F.get("dist", p).alias("d"), F.slice("v", p * width + 1, F.lit(width)).alias("x")))
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)]
    rows = table.select(F.inline(pieces)).groupBy("p", "e").agg(F.count("*").alias("n"), F.max("d").alias("d"), *sums).collect()  # parts x entries at most
    new, radii = books.copy(), [np.full(entries, -1.0) for _ in range(parts)]
    for r in rows:
        new[r.p, r.e] = [r[f"s{i}"] // r.n for i in range(width)]
        shift = float(((new[r.p, r.e] - books[r.p, r.e]).astype(float) ** 2).sum())
        radii[r.p][r.e] = r.d ** 0.5 + shift ** 0.5
    return new, radii


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (array<int>, one entry index per part), error (squared distances summed), label_error (error
    summed over equal labels, nulls together), codebooks_sha256.

    Vectors that are null or hold a null or non-finite component are dropped. Shorter vectors count as padded
    with zeros to the longest, and the longest to a multiple of `parts`. Codebooks start as the parts of the
    `entries` smallest ids (null ids last, equal ids by their components); with fewer vectors they are smaller.
    Repeated rows and ids are vectors each. An empty table gives an empty one; other columns are left out.
    Components whose squared distances pass 64 bits raise an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole_numbers(F.col(vector_col), scale).alias("v")).filter("v is not null")
    most = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    longest, largest = rows.agg(F.max(F.size("v")), F.max(most)).first()
    if longest is None:
        return spark.createDataFrame([], "vec_id long, code array<int>, error long, label_error long, codebooks_sha256 string")
    width = -(-longest // parts)
    kind = checked(largest, width)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("v")))
    table = stored(rows.withColumn("v", padded), "vectors")
    first = table.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    near = None
    with bounded_batches(spark, BATCH, "32m"):
        for turn in range(rounds + 1):
            names = ["vec_id", "label", "v"] + (["code"] if turn else [])
            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields if f.name in names[:3])
            made = table.select(*names).mapInArrow(_assigned(books, near, kind), f"{kinds}, code array<int>, dist array<long>")
            if turn == rounds:
                final = stored(made.select("vec_id", "label", "code", F.aggregate("dist", F.lit(0).cast("long"), lambda a, x: a + x).alias("error")), "codes")
                break
            table = stored(made, "assigned")
            books, radii = _updated(table, books)
            near = [balls(b.astype(kind), r) for b, r in zip(books, radii)]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # a null label is a key as any other inside a struct
    keyed = final.withColumn("key", F.struct("label"))
    totals = keyed.groupBy("key").agg(F.sum("error").alias("label_error"))
    joined = join_spread(keyed, totals, ["key"], by=["vec_id", "code"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def hex_code(code: Column) -> Column:
    """Two lowercase hex digits per index."""
    return F.array_join(F.transform(code, lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
