"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of `edges` (columns a, b: long); root is the smallest node reachable.

    Each round joins every node's larger neighbours to its smallest neighbour, then its smaller ones
    (large star, small star), until each component is a star. Neighbours are reduced to their minimum
    before they are shuffled, so a hub costs one row per task; the rounds grow with the logarithm of a
    component's size. Each round is a table in the shared folder.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "edges")
    before = _signature(pairs)
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = _signature(pairs)
        if now == before:
            roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
    raise ValueError("components did not settle")
