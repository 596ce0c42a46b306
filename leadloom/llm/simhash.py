"""SimHash near-dedup with vantage-point trees.

Fingerprints are compared by Hamming distance. A vantage-point tree splits them by their distance to chosen
points; a fingerprint lives in one leaf and visits every other leaf whose region its search ball overlaps
(triangle bound), so each leaf finds its exact pairs alone. The trees split 32-bit blocks of the fingerprint:
if two fingerprints of k blocks differ in at most r bits, some block differs in at most r // k, and a small
radius keeps few fingerprints on the boundary of a split (in 32 bits and radius 1 about a quarter, in 64 bits
and radius 3 about two thirds). The trees are fitted on a bounded sample; every fingerprint goes through them.
Leaves that hold too many rows are split by a salt and visited once per part. Inside a leaf the same splitting
goes on in memory down to small blocks. A leaf reports a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import binary_array, fresh, small_batches, stored
from leadloom.llm.components import components
from leadloom.llm.exact_dedup import BITMAP_BITS, _maybe_in

#: The contract's fingerprint: words per shingle, seed of XXH64, largest distance of a link.
WORDS, SEED, MAX_DISTANCE = 3, 42, 3
#: The trees are fitted on about so many fingerprints (a share of the hash range), for leaves of about so many rows.
SAMPLE_ROWS, LEAF_ROWS = 16_384, 2_000
#: A leaf with more rows is split by a salt.
LEAF_MOST = 200_000
#: Bytes of a text that are cut into words at once.
BLOCK_BYTES = 1 << 22
#: Comparisons that are made in one numpy step.
CELLS = 1 << 21

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_PLACE = (np.arange(8) * 256).astype(np.int64)
#: ones[byte value, bit] for big-endian order of bits
_ONES = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) words of a text, in blocks of bounded size."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + BLOCK_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, repeats included, in blocks; a shorter text is one shingle, an empty one none."""
    carry: list[bytes] = []
    seen = False
    for block in word_blocks(text):
        block = carry + block
        if len(block) >= words:
            seen = True
            grams = map(b" ".join, zip(*[block[i:] for i in range(words)]))
            yield np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, len(block) - words + 1)
            carry = block[len(block) - words + 1 :] if words > 1 else []
        else:
            carry = block
    if carry and not seen:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), seed)], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """An independent 64-bit hash number k of hashes; number 0 is the hash itself."""
    if not k:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhash(text: bytes, words: int = WORDS, seed: int = SEED, lanes: int = 1, distinct: bool = False) -> bytes:
    """64 * `lanes` bits, big endian: a bit is one if it is set in over half the shingle hashes.

    With `distinct`, a shingle counts once. A text without words has all bits zero."""
    counts, n = np.zeros((lanes, 64), np.int64), 0
    parts = shingle_hashes(text, words, seed)
    if distinct:
        parts = [np.unique(np.concatenate(p))] if (p := list(parts)) else []
    for h in parts:
        n += len(h)
        for k in range(lanes):
            cells = _mixed(h, k).astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + _PLACE
            per_byte = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
            counts[k] += (per_byte @ _ONES).ravel()
    return np.packbits(2 * counts > n, axis=1).tobytes()


def fingerprint(text: Column, words: int = WORDS, seed: int = SEED, lanes: int = 1, distinct: bool = False) -> Column:
    """Binary column of 8 * `lanes` bytes; null text counts as empty."""
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words, seed, lanes, distinct) for t in texts])

    return run(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass
class Tree:
    """A vantage-point tree over 32-bit values. Child i >= 0 is a node, ~i a leaf."""

    vantage: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    leaves: int

    @classmethod
    def fit(cls, values: np.ndarray, reach: int, leaves: int) -> Tree:
        """Split the largest part until there are `leaves` parts; points and radii are chosen for a small boundary."""
        vantage, radius, inside, outside = [], [], [], []
        count = 0

        def grow(part: np.ndarray, want: int) -> int:
            nonlocal count
            best = None
            if want > 1 and len(part) > 1:
                for v in part[:: max(1, len(part) // 8)][:8]:
                    hist = np.bincount(np.bitwise_count(part ^ v), minlength=33 + reach)
                    below = np.cumsum(hist) / len(part)
                    for mu in range(32):
                        if 0.25 <= below[mu] <= 0.75:
                            edge = hist[max(0, mu - reach + 1) : mu + reach + 1].sum() / len(part)
                            score = edge + abs(below[mu] - 0.5) / 2
                            if best is None or score < best[0]:
                                best = (score, v, mu)
            if best is None:
                count += 1
                return ~(count - 1)
            near = np.bitwise_count(part ^ best[1]) <= best[2]
            at = len(vantage)
            vantage.append(best[1]), radius.append(best[2]), inside.append(0), outside.append(0)
            share = round(want * near.mean())
            inside[at] = grow(part[near], max(1, share))
            outside[at] = grow(part[~near], max(1, want - share))
            return at

        grow(np.unique(values), leaves)
        return cls(np.array(vantage, np.uint32), np.array(radius, np.int64), np.array(inside, np.int64), np.array(outside, np.int64), count)

    def route(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) of all leaves that the ball of each value overlaps; one of them is the home."""
        rows, at, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
        if not len(self.vantage):
            return rows, at, home
        done: list[tuple] = []
        while len(rows):
            d = np.bitwise_count(values[rows] ^ self.vantage[at]).astype(np.int64)
            mu = self.radius[at]
            left, right = d - reach <= mu, d + reach > mu
            rows, nxt, home = (
                np.concatenate([rows[left], rows[right]]),
                np.concatenate([self.inside[at[left]], self.outside[at[right]]]),
                np.concatenate([(home & (d <= mu))[left], (home & (d > mu))[right]]),
            )
            end = nxt < 0
            done.append((rows[end], ~nxt[end], home[end]))
            rows, at, home = rows[~end], nxt[~end], home[~end]
        return tuple(np.concatenate(x) for x in zip(*done))


def _blocks(data: pa.Array, width: int) -> np.ndarray:
    """(n, width / 4) uint32 of a binary column of equally long cells."""
    raw = b"".join(x.as_py() for x in data)
    return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, width // 4)


class _Forest:
    """Union-find over the rows of a leaf, on whole arrays."""

    def __init__(self, n: int) -> None:
        self.top = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.top[a], self.top[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.top, np.maximum(a, b), np.minimum(a, b))
            while (self.top[self.top] != self.top).any():
                self.top = self.top[self.top]


def leaf_pairs(own: np.ndarray, ask: np.ndarray, own_rows: np.ndarray, ask_rows: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (ask row, own row) of values at most `reach` apart: the tree goes on in memory, then blocks are compared."""
    todo = [(own_rows, ask_rows, 0)]
    while todo:
        o, a, depth = todo.pop()
        if not len(o) or not len(a):
            continue
        if len(o) > 256 and len(o) * len(a) > CELLS // 8 and depth < 40:
            point = own[o[len(o) // 2]]
            do, da = np.bitwise_count(own[o] ^ point).astype(np.int64), np.bitwise_count(ask[a] ^ point).astype(np.int64)
            mu = int(np.partition(do, len(do) // 2)[len(do) // 2])
            mu -= mu == do.max()
            near = do <= mu
            if near.any() and not near.all():
                todo += [(o[near], a[da - reach <= mu], depth + 1), (o[~near], a[da + reach > mu], depth + 1)]
                continue
        step = max(1, CELLS // len(o))
        for i in range(0, len(a), step):
            part = a[i : i + step]
            q, k = np.nonzero(np.bitwise_count(ask[part][:, None] ^ own[o][None, :]) <= reach)
            yield part[q], o[k]


def near_links(nodes: DataFrame, route_bytes: int, reach: int, far: int, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, leaf_most: int = LEAF_MOST) -> DataFrame:
    """Links (a, b) between nodes, enough to connect all that are linked.

    `nodes`: columns node (long, unique), route (binary of `route_bytes`) and check (binary of one length).
    Two nodes are linked if some 32-bit block of `route` differs in at most `reach` bits and `check` in at
    most `far`. `nodes` should be a stored table: it is read three times.
    """
    spark = nodes.sparkSession
    blocks = route_bytes // 4
    count = nodes.count()
    # a share of the hash range that holds about sample_rows nodes
    share = int(min(1.0, sample_rows / max(1, count)) * (1 << 31))
    sample = nodes.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 31)) < share).select("route").collect()
    values = np.frombuffer(b"".join(bytes(r.route) for r in sample), ">u4").astype(np.uint32).reshape(-1, blocks)
    leaves = int(min(max(1, math.ceil(count / leaf_rows)), sample_rows // 4))
    trees = [Tree.fit(values[:, b], reach, leaves) for b in range(blocks)]
    first = np.cumsum([0, *[t.leaves for t in trees]])
    told = spark.sparkContext.broadcast(trees)  # bounded by the sample

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(first[-1], np.int64)
        for batch in batches:
            x = _blocks(batch.column(0), route_bytes)
            for b, tree in enumerate(told.value):
                _, leaf, home = tree.route(x[:, b], 0)
                total += np.bincount(leaf[home] + first[b], minlength=len(total))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"leaf": at, "n": total[at]})

    held = nodes.select("route").mapInArrow(counted, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).filter(F.col("n") > leaf_most).collect()
    parts = np.ones(first[-1], np.int64)  # salts of each leaf
    for leaf, n in held:
        parts[leaf] = -(-n // leaf_most)
    told_parts = spark.sparkContext.broadcast(parts)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("leaf", pa.int64()), ("part", pa.int64()), ("asks", pa.int8()), ("node", pa.int64()), ("route", pa.binary()), ("check", pa.binary())])
        for batch in batches:
            x, node = _blocks(batch.column(1), route_bytes), batch.column(0).to_numpy()
            salt = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for b, tree in enumerate(told.value):
                row, leaf, home = tree.route(x[:, b], reach)
                of = np.zeros(len(x), np.int64)
                of[row[home]] = leaf[home]
                keep = leaf >= of[row]  # a pair of leaves meets in the later one
                row, leaf, home = row[keep], leaf[keep] + first[b], home[keep]
                m = told_parts.value[leaf]
                own = (salt[row] % m.astype(np.uint64)).astype(np.int64)
                row, leaf, home, own, m = (np.repeat(v, m) for v in (row, leaf, home, own, m))
                starts = np.r_[True, (row[1:] != row[:-1]) | (leaf[1:] != leaf[:-1])][: len(row)]
                part = np.arange(len(row)) - np.maximum.accumulate(np.where(starts, np.arange(len(row)), 0))
                keep = ~home | (part >= own)
                row, leaf, home, own, part = row[keep], leaf[keep], home[keep], own[keep], part[keep]
                asks = ~(home & (part == own))
                take = pa.array(row)
                for i in range(0, len(row), 50_000):
                    s = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf[s]), pa.array(part[s]), pa.array(asks[s].astype(np.int8)), pa.array(node[row[s]]), batch.column(1).take(take[s]), batch.column(2).take(take[s])], schema=schema
                    )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, forest = None, None, None
        pending: list = []

        def check(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= far

        def closed():
            if forest is not None:
                at = np.nonzero(forest.top != np.arange(len(forest.top)))[0]
                if len(at):
                    yield pa.RecordBatch.from_pydict({"a": own[0][at], "b": own[0][forest.top[at]]})

        def opened():
            node, route, chk = (np.concatenate(x) for x in zip(*pending))
            f = _Forest(len(node))
            b = int(np.searchsorted(first, shard[0], "right") - 1)
            every = np.arange(len(node))
            for q, o in leaf_pairs(route[:, b], route[:, b], every, every, reach):
                up = q > o
                q, o = q[up], o[up]
                ok = check(chk[q], chk[o])
                f.join(q[ok], o[ok])
            return (node, route, chk, b), f

        for batch in batches:
            leaf, part, asks, node = (batch.column(i).to_numpy() for i in range(4))
            route, chk = _blocks(batch.column(4), route_bytes), _blocks(batch.column(5), len(batch.column(5)[0].as_py()) if len(leaf) else 4)
            cuts = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])]) if len(leaf) else []
            for i, j in zip(cuts, [*cuts[1:], len(leaf)]):
                if shard != (leaf[i], part[i]):
                    if pending:
                        own, forest = opened()
                        pending = []
                    yield from closed()
                    shard, own, forest = (leaf[i], part[i]), None, None
                if not asks[i]:
                    pending.append((node[i:j], route[i:j], chk[i:j]))
                    continue
                if pending:
                    own, forest = opened()
                    pending = []
                if own is None:
                    continue
                firsts_q, firsts_o = [], []
                for q, o in leaf_pairs(own[1][:, own[3]], route[i:j][:, own[3]], np.arange(len(own[0])), np.arange(j - i), reach):
                    ok = check(chk[i:j][q], own[2][o])
                    q, o = q[ok], o[ok]
                    if not len(q):
                        continue
                    order = np.argsort(q, kind="stable")
                    q, o = q[order], o[order]
                    start = np.r_[True, q[1:] != q[:-1]]
                    firsts_q.append(q[start]), firsts_o.append(o[start])
                    forest.join(o, o[start][np.cumsum(start) - 1])
                if firsts_q:
                    q, o = np.concatenate(firsts_q), np.concatenate(firsts_o)
                    yield pa.RecordBatch.from_pydict({"a": node[i:j][q], "b": own[0][o]})
        if pending:
            own, forest = opened()
        yield from closed()

    spread = nodes.mapInArrow(routed, "leaf long, part long, asks tinyint, node long, route binary, check binary")
    sorted_in = spread.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "asks", "node")
    return sorted_in.mapInArrow(linked, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other. A null id takes no part in the
    smallest; a component of null ids has component_id null. Repeated rows share fingerprint and component.
    An empty table gives an empty one; other columns are left out.
    """
    small_batches(docs.sparkSession)
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hex(fingerprint(F.col(text_col).cast("string"))).alias("h")), "fingerprints")
    # a fingerprint as a long: the upper digits shifted beside the lower ones
    half = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("long")
    keyed = rows.select("doc_id", F.lower("h").alias("fingerprint"), F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("node"), F.unhex("h").alias("route"), F.unhex("h").alias("check"))
    return _named(keyed, 8, max_distance // 2, max_distance).select("doc_id", "fingerprint", "component_id")


def _named(keyed: DataFrame, route_bytes: int, reach: int, far: int) -> DataFrame:
    """`keyed` (doc_id, node, route, check, ...) with component_id. Rows of one node meet before they are linked."""
    least = keyed.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("route").alias("route"), F.first("check").alias("check"))
    nodes = stored(least, "nodes")
    roots = components(near_links(nodes.select("node", "route", "check"), route_bytes, reach, far))
    return _of_roots(keyed, nodes, roots)


def _of_roots(keyed: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """`keyed` (node, ...) with the least id of all nodes (node, least) that have the same root."""
    tops = nodes.select("node", "least").join(roots, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    of = nodes.select("node", "least").join(roots.join(tops, "root").select("node", "component_id"), "node", "left")
    named = of.select("node", F.coalesce("component_id", "least").alias("component_id"))
    return keyed.join(named, "node")


#: Similarity stages: words of a shingle, least Jaccard similarity, MinHash values of a candidate key (a band), and
#: the share of pairs at the least similarity that may miss each other in all bands (fewer of the pairs above it).
SIMILAR_WORDS, SIMILARITY, BAND_ROWS, MISSED = 5, 0.8, 6, 0.001


def bands_for(similarity: float) -> int:
    """Bands that all but `MISSED` of the pairs with this similarity share at least one of."""
    return math.ceil(math.log(MISSED) / math.log(1 - min(similarity, 1 - 1e-9) ** BAND_ROWS))


def band_keys(hashes: np.ndarray, count: int) -> np.ndarray:
    """`count` 64-bit keys of a set of hashes, none of an empty one. Two sets share key k with their Jaccard
    similarity to the power of BAND_ROWS, whatever the difference looks like."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    n = np.arange(count * BAND_ROWS, dtype=np.uint64)
    flip, times = _mixed(n, 1)[:, None], (_mixed(n, 2) | np.uint64(1))[:, None]
    step = max(1, CELLS // len(n) // 8)
    least = np.min([((hashes[None, i : i + step] ^ flip) * times).min(axis=1) for i in range(0, len(hashes), step)], axis=0)
    keys = _mixed(np.arange(count, dtype=np.uint64), 3)
    for row in least.reshape(count, BAND_ROWS).T:
        keys = _mixed(keys ^ row, 4)
    return keys.view(np.int64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def similar_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The component of each set (its smallest member's place) over all pairs with a Jaccard similarity of
    `similarity` or more, compared exactly.

    A set that is similar to a hub joins its star, another becomes a hub. Distances 1 - Jaccard obey the triangle
    inequality, so members of two stars are compared only where the distances to the hubs leave it open.
    """
    top, least = list(range(len(sets))), 1 - similarity + 1e-9

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def union(i: int, j: int) -> None:
        i, j = root(i), root(j)
        top[max(i, j)] = min(i, j)

    if not sets:
        return np.zeros(0, np.int64)
    size = np.array([len(x) for x in sets])
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    tokens = np.split(place, np.cumsum(size)[:-1])
    mark = np.zeros(len(every), np.int64)

    def distances(i: int, of: np.ndarray, joined: np.ndarray, starts: np.ndarray) -> np.ndarray:
        mark[tokens[i]] = 1
        both = np.add.reduceat(mark[joined], starts)
        mark[tokens[i]] = 0
        return 1 - both / (size[i] + size[of] - both)

    def packed(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return of, np.concatenate([tokens[i] for i in of]), np.r_[0, np.cumsum(size[of])[:-1]]

    hubs, stars, radius = [], {}, {}
    buffer, starts, used = np.zeros(1 << 12, np.int64), [], 0
    for i in range(len(sets)):
        d = distances(i, np.array(hubs), buffer[:used], np.array(starts)) if hubs else np.ones(0)
        near = np.flatnonzero(d <= least)
        for k in near:
            union(i, hubs[k])
        if len(near):
            k = near[np.argmin(d[near])]
            stars[hubs[k]].append(i)
            radius[hubs[k]] = max(radius[hubs[k]], d[k])
            continue
        while used + size[i] > len(buffer):
            buffer = np.r_[buffer, np.zeros_like(buffer)]
        buffer[used : used + size[i]] = tokens[i]
        hubs.append(i), starts.append(used)
        stars[i], radius[i], used = [i], 0.0, used + size[i]
    at = packed(np.array(hubs))
    wide = np.array([radius[h] for h in hubs])
    for p, a in enumerate(hubs):
        for q in np.flatnonzero(distances(a, *at) <= wide[p] + wide + least):
            b = hubs[q]
            if q <= p or root(a) == root(b) or len(stars[a]) + len(stars[b]) == 2:
                continue
            pair = packed(np.array([a, b]))
            left = [x for x in stars[a] if distances(x, *pair)[1] <= least + radius[b]]
            right = [y for y in stars[b] if distances(y, *pair)[0] <= least + radius[a]]
            if left and right:
                right = packed(np.array(right))
                if any((distances(x, *right) <= least).any() for x in left):
                    union(a, b)
    return np.array([root(i) for i in range(len(sets))])


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id and component_id, over links of `similarity` or more.

    Candidates are documents whose SimHash fingerprints are linked as in `near_groups`, and documents that share a band
    of MinHash values of their distinct word shingles (at the least similarity fingerprints differ in more bits than a
    link may); their components are named by the links and by stars of bands, without pairs. The texts of candidates (and others that share a bit of a bitmap)
    then meet by component, where links are decided by the shingle sets themselves. What one task holds is the
    largest component of candidates, 8 bytes a shingle. Nulls and repeats as in `near_groups`; rows of equal
    shingle sets are one node.
    """
    small_batches(docs.sparkSession)
    count = bands_for(similarity)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), text.cast("binary").alias("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(2)]
            keys = [band_keys(x, count) for x in sets]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            prints = pa.array([simhash(t.as_py(), WORDS, SEED, 1, False) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), bands, prints], ["doc_id", "content", "node", "bands", "print"])

    rows = stored(texts.mapInArrow(sketched, "doc_id long, content long, node long, bands array<long>, print binary"), "sketches")
    one = [F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "content", "bands", "print")).alias("one")]
    nodes = stored(rows.groupBy("node").agg(*one).select("node", "least", F.col("one.doc_id").alias("doc_id"), "one.content", "one.bands", "one.print"), "nodes")
    # nodes of one fingerprint are a star, fingerprints are linked by their trees
    prints = stored(nodes.groupBy("print").agg(F.min("node").alias("b")), "prints")
    same = nodes.join(prints, "print").filter("node <> b").select(F.col("node").alias("a"), "b")
    linked = near_links(prints.select(F.col("b").alias("node"), F.col("print").alias("route"), F.col("print").alias("check")), 8, MAX_DISTANCE // 2, MAX_DISTANCE)
    keys = nodes.select("node", F.explode("bands").alias("band"))
    hubs = keys.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    starred = keys.join(hubs, "band").filter("node <> b").select(F.col("node").alias("a"), "b")
    near = components(starred.unionByName(same).unionByName(linked).distinct())
    wanted = stored(nodes.join(near, "node").select("content", F.col("doc_id").alias("_id"), "node", F.col("root").alias("candidates")), "candidates")
    met = _maybe_in(texts, wanted, BITMAP_BITS).join(wanted, "content").filter(F.col("doc_id").eqNullSafe(F.col("_id")))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, node, sets = None, [], []

        def closed():
            of = np.array(node, np.int64)[similar_roots(sets, similarity)] if node else np.zeros(0, np.int64)
            return pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "root": pa.array(of, pa.int64())})

        for batch in batches:
            for g, n, t in zip(*(batch.column(i) for i in range(3))):
                g, n = g.as_py(), n.as_py()
                if g != group:
                    yield closed()
                    group, node, sets = g, [], []
                if not node or node[-1] != n:  # rows that repeat id and text
                    node.append(n), sets.append(shingle_set(t.as_py(), words))
        yield closed()

    sorted_in = met.select("candidates", "node", "text").repartition("candidates").sortWithinPartitions("candidates", "node")
    roots = stored(sorted_in.mapInArrow(rooted, "node long, root long"), "similar")
    return _of_roots(rows.select("doc_id", "node"), nodes, roots).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the rows whose id is not the smallest of its group, all columns. Rows without an id stay.
    Other columns may have any name and pass as they are."""
    own = fresh(docs, "_gone")[0]
    gone = similar_groups(docs, id_col, text_col, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone[own], "left_anti")
