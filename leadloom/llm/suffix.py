"""Repeated byte strings of a corpus, by suffix sorting of the places where repeats can be.

A byte goes if a string of `least` bytes that covers it also starts earlier. Equal strings of that length hold
the same smallest k-gram (by hash) at the same place, so every string belongs to one anchor, and equal strings
to anchors of one hash. A document yields an anchor about every 35 bytes, with the run of string starts it
stands for and a digest of the bytes they span. Anchors meet by hash, sorted, so a task holds one at a time:

* equal digests are whole copies: all but the earliest are covered, and nothing more is read for them (copies
  in one batch are folded before the shuffle);
* a hash with one digest is done;
* where digests differ, one context of each is fetched, and the contexts of a hash are sorted by their
  suffixes. The text sorted is that of 16-byte symbols, cut at the same distance from the anchor in every
  context, so that it is short. Strings of `least` bytes that are equal share the whole symbols inside them;
  suffixes with that many symbols in common stand together in the suffix array, and their strings are
  compared byte by byte. All but the earliest start are covered.

The suffix array is built by linear grouping: suffixes are grouped by their Lyndon prefix; groups are processed
in descending order, each moving the previous smaller suffixes of its members behind their old groups; then
the order is emitted from the groups along the same pointers, without ranks being renamed again. A hash with
so many contexts that one task should not sort them is resolved by grouping its strings themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import small_batches, stored

#: Bytes of a string that counts as a repeat, of the k-gram that anchors it.
LEAST, GRAM = 100, 32
#: Contexts of one hash that are sorted together; more are grouped string by string. Bytes of a sorted block, of a symbol.
TOGETHER, BLOCK, SYMBOL = 20_000, 1 << 16, 16
#: An anchor's record packs its distance from the first string start above the number of starts.
PACK = 1 << 12
#: Bytes of a document that are hashed at once.
SEGMENT = 1 << 19

_BYTES = np.array([xxhash.xxh64_intdigest(bytes([i]), 9) for i in range(256)], np.uint64)
_ODD = 0x9E3779B97F4A7C15
_LATE = (1 << 63) - 1


def suffix_array(s: Sequence[int], symbols: int = 256) -> list[int]:
    """Starts of all suffixes in lexicographic order, by linear grouping; symbols are 0 .. `symbols` - 1."""
    n = len(s)
    if not n:
        return []
    # groups in a list from low to high; first by one symbol
    members: list[dict[int, None]] = [{} for _ in range(symbols)]
    group = list(s)
    for i, c in enumerate(s):
        members[c][i] = None
    below, above = list(range(-1, symbols - 1)), list(range(1, symbols + 1))
    above[-1] = -1
    before = [-1] * n  # previous smaller suffix
    done = bytearray(n)

    def behind(old: int, moved: list[int]) -> None:
        """Move suffixes of a group into a new one right above it."""
        own = members[old]
        if len(moved) == len(own):
            return  # all of the group: its place stays
        new, up = len(members), above[old]
        members.append(dict.fromkeys(moved))
        for j in moved:
            del own[j]
            group[j] = new
        below.append(old)
        above.append(up)
        above[old] = new
        if up >= 0:
            below[up] = new

    g = symbols - 1
    while g >= 0:
        own = members[g]
        if len(own) == 1:
            (i,) = own
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            done[i] = 1
            if j >= 0:
                behind(group[j], [j])
        elif own:
            # ascending, so that pointers inside the group are there
            pointed: dict[int, int] = {}
            for i in sorted(own):
                j = i - 1
                while j >= 0 and done[j]:
                    j = before[j]
                before[i] = j
                done[i] = 1
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by: dict[int, dict[int, list[int]]] = {}
            for j, k in pointed.items():
                by.setdefault(k, {}).setdefault(group[j], []).append(j)
            for k in sorted(by, reverse=True):  # more repeats behind fewer
                for old, moved in by[k].items():
                    behind(old, moved)
        g = below[g]
    at, free, g = 0, [0] * len(members), 0
    while g >= 0:
        free[g] = at
        at += len(members[g])
        g = above[g]
    out, placed = [0] * n, bytearray(n)
    j = n - 1
    while j >= 0:
        out[free[group[j]]] = j
        free[group[j]] += 1
        placed[j] = 1
        j = before[j]
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            out[free[group[j]]] = j
            free[group[j]] += 1
            placed[j] = 1
            j = before[j]
    return out


def anchors(data: bytes, least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, start, packed) per segment: n starts of strings from `start` on share the anchor with this hash,
    which is `far` bytes behind `start`; packed is far * PACK + n."""
    window = least - gram + 1
    for base in range(0, max(0, len(data) - least + 1), SEGMENT):
        part = np.frombuffer(data, np.uint8, min(len(data) - base, SEGMENT + least - 1), base)
        h, m, mul = _BYTES[part], 1, _ODD
        while m < gram:  # hash of m bytes from each place on, doubled
            h = h[:-m] * np.uint64(mul) + h[m:]
            m, mul = 2 * m, mul * mul & (2**64 - 1)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        size, width = 1, window
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        yield h[at[first]].view(np.int64), first + base, np.diff(np.r_[first, len(at)]) + (at[first] - first) * PACK


def covered_starts(contexts: list[tuple[tuple, int, bytes, int]], least: int = LEAST, symbol: int = SYMBOL) -> Iterator[tuple[int, int]]:
    """(context, offset) of all strings of the contexts that also start earlier in one of them.

    A context is (document, start in it, bytes, distance of its anchor); documents and starts say what is
    earlier. Equal strings have their anchor at the same place."""
    symbol = max(1, min(symbol, least // 4))
    shared = (least - symbol + 1) // symbol  # whole symbols inside any string
    parts, of, at, left = [], [], [], []
    for c, (_, _, data, far) in enumerate(contexts):
        first = far % symbol
        k = (len(data) - first) // symbol
        parts.append(data[first : first + k * symbol])
        of += [c] * k
        at += range(first, first + k * symbol, symbol)
        left += range(k, 0, -1)
    kinds, text = np.unique(np.frombuffer(b"".join(parts), f"S{symbol}"), return_inverse=True)
    text = text.tolist()

    def compared(same: list[int]) -> Iterator[tuple[int, int]]:
        met: dict[bytes, list[tuple]] = {}
        for i in same:
            doc, start, data, _ = contexts[of[i]]
            for a in range(max(0, at[i] - symbol + 1), min(at[i], len(data) - least) + 1):
                met.setdefault(data[a : a + least], []).append((doc, start + a, of[i], a))
        for places in met.values():
            if len(places) > 1:
                first = min(places)[:2]
                yield from (p[2:] for p in places if p[:2] != first)

    same: list[int] = []
    last = None
    for i in suffix_array(text, len(kinds)):
        if left[i] < shared:
            continue
        string = text[i : i + shared]
        if string != last:
            if len(same) > 1:
                yield from compared(same)
            same, last = [], string
        same.append(i)
    if len(same) > 1:
        yield from compared(same)


def _merged(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of bytes that strings at sorted starts cover."""
    cut = np.flatnonzero(np.r_[True, np.diff(starts) > least]) if len(starts) else []
    ends = np.r_[starts[cut[1:] - 1], starts[-1]] + least if len(starts) else []
    return list(zip(starts[cut].tolist() if len(starts) else [], np.asarray(ends).tolist()))


_RECORD = "hash long, digest long, doc long, text_key long, start long, n long"
_FOUND = "hash long, doc long, text_key long, start long, n long"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "byte": pa.int8(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in ddl.split(","))])


def _batch(ddl: str, *columns) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _records(least: int, gram: int):
    """Anchors of the documents of a batch; copies inside the batch become intervals (n < 0: of -n bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, key, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = cell.as_py()
                for h, start, n in anchors(data, least, gram):
                    digest = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), (start + n % PACK + (least - 1)).tolist())), np.uint64, len(start)).view(np.int64)
                    parts.append((h, digest, np.full(len(h), doc), np.full(len(h), key), start, n))
            if not parts:
                continue
            h, g, d, t, s, n = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((s, t, d, g, h))
            h, g, d, t, s, n = (x[order] for x in (h, g, d, t, s, n))
            first = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            yield _batch(_RECORD, h[first], g[first], d[first], t[first], s[first], n[first])
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            copy = ~first & ((d != d[lead]) | (t != t[lead]) | (s != s[lead]))
            if copy.any():
                order = np.lexsort((s[copy], t[copy], d[copy]))
                d, t, s, n = (x[copy][order] for x in (d, t, s, n))
                stop = s + n % PACK + (least - 1)
                new = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > stop[:-1])]
                cut = np.flatnonzero(new)
                end = np.maximum.reduceat(stop, cut)
                spread = (d[cut].astype(np.uint64) * np.uint64(_ODD)).view(np.int64)
                yield _batch(_RECORD, spread, np.zeros(len(cut), np.int64), d[cut], t[cut], s[cut], s[cut] - end)

    return run


def _resolved(least: int):
    """Sorted anchors: copies of a digest become intervals, contexts are asked for where digests of a hash differ."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, asked = None, False  # first record of the digest at hand; whether contexts of its hash are asked for
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            ready = cols[5] < 0
            if ready.any():
                yield _batch(_FOUND, *(cols[i][ready] for i in (0, 2, 3, 4, 5)))
            h, g, d, t, s, n = (c[~ready] for c in cols)
            if not len(h):
                continue
            carried = lead is not None
            if carried:
                h, g, d, t, s, n = (np.r_[np.array([x]), c] for x, c in zip(lead, (h, g, d, t, s, n)))
            head = np.r_[True, h[1:] != h[:-1]]
            first = np.r_[True, head[1:] | (g[1:] != g[:-1])]
            at = np.flatnonzero(first)[np.cumsum(first) - 1]
            copy = ~first & ((d != d[at]) | (t != t[at]) | (s != s[at]))
            if copy.any():
                yield _batch(_FOUND, h[copy], d[copy], t[copy], s[copy], -(n[copy] % PACK + (least - 1)))
            reps = np.flatnonzero(first)
            run_of = np.cumsum(head)[reps] - 1
            many = np.bincount(run_of)[run_of] > 1
            if asked:
                many[run_of == 0] = True
            ask = reps[many]
            if asked:
                ask = ask[1:]  # the carried record was asked for
            if len(ask):
                yield _batch(_FOUND, h[ask], d[ask], t[ask], s[ask], n[ask])
            lead, asked = tuple(int(c[reps[-1]]) for c in (h, g, d, t, s, n)), bool(many[-1])

    return run


def _contexts(least: int):
    """Bytes of the contexts of a document; those of large groups as digests of each string."""
    ddl = "whole byte, k1 long, k2 long, doc long, text_key long, start long, far long, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, key, cell, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                data = cell.as_py()
                for a in asks:
                    far, n = divmod(a["n"], PACK)
                    if a["large"]:
                        for i in range(a["start"], a["start"] + n):
                            x = xxhash.xxh3_128_intdigest(data[i : i + least])
                            rows.append((0, (x >> 64) - (1 << 63), (x & (2**64 - 1)) - (1 << 63), doc, key, i, 0, b""))
                    else:
                        rows.append((1, a["hash"], 0, doc, key, a["start"], far, data[a["start"] : a["start"] + n + least - 1]))
                if len(rows) > 20_000:
                    yield _batch(ddl, *zip(*rows))
                    rows = []
            if rows:
                yield _batch(ddl, *zip(*rows))

    return run, ddl


def _sorted_out(least: int, block: int):
    """Contexts sorted by hash, in blocks of whole hashes: intervals that the suffix array finds covered."""
    def solve(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        contexts = [((doc, key), start, data, far) for _, doc, key, start, far, data in group]
        hit: dict[int, list[int]] = {}
        for c, off in covered_starts(contexts, least):
            hit.setdefault(c, []).append(contexts[c][1] + off)
        rows = [(0, *contexts[c][0], a, a - b) for c, starts in hit.items() for a, b in _merged(np.sort(np.array(starts)), least)]
        if rows:
            yield _batch(_FOUND, *zip(*rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > block and row[0] != done[-1][0]:
                    yield from solve(done)
                    done, size = [], 0
                done.append(row)
                size += len(row[5])
        if done:
            yield from solve(done)

    return run


def repeated_intervals(rows: DataFrame, least: int = LEAST, gram: int = GRAM, together: int = TOGETHER, block: int = BLOCK) -> DataFrame:
    """(doc, text_key, start, stop) of bytes that strings with an earlier start cover; intervals may overlap.

    `rows`: doc (long, the order of documents), text_key (long), data (binary). Rows of equal doc and text_key
    are one document."""
    found = rows.mapInArrow(_records(least, gram), _RECORD)
    met = found.repartition("hash").sortWithinPartitions("hash", "digest", "doc", "text_key", "start").mapInArrow(_resolved(least), _FOUND)
    met = stored(met, "anchors")
    asked = met.filter("n > 0")
    large = asked.groupBy("hash").agg((F.count("*") > together).alias("large"))
    asks = asked.join(large, "hash").groupBy("doc", "text_key").agg(F.collect_list(F.struct("hash", "start", "n", "large")).alias("asks"))  # bounded by the document's length
    fetch, ddl = _contexts(least)
    contexts = stored(rows.join(asks.hint("shuffle_hash"), ["doc", "text_key"]).select("doc", "text_key", "data", "asks").mapInArrow(fetch, ddl.replace("byte,", "tinyint,")), "contexts")
    small = contexts.filter("whole = 1").select("k1", "doc", "text_key", "start", "far", "bytes").distinct()
    by_suffix = small.repartition("k1").sortWithinPartitions("k1", "doc", "text_key", "start").mapInArrow(_sorted_out(least, block), _FOUND)
    strings = contexts.filter("whole = 0").select("k1", "k2", F.struct("doc", "text_key", "start").alias("at"))
    earliest = strings.groupBy("k1", "k2").agg(F.min("at").alias("first"), F.count("*").alias("times")).filter("times > 1")
    by_string = strings.join(earliest, ["k1", "k2"]).filter("at <> first").select("at.doc", "at.text_key", "at.start", F.lit(-least).cast("long").alias("n"))
    every = met.filter("n < 0").select("doc", "text_key", "start", "n").unionByName(by_suffix.select("doc", "text_key", "start", "n")).unionByName(by_string)
    return every.select("doc", "text_key", "start", (F.col("start") - F.col("n")).alias("stop"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, **options) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining bytes `kept`.

    Texts are UTF-8 bytes, null is empty. Documents are in order of their ids; null ids come last, rows with
    the same id by a hash of their texts; rows that repeat id and text are one document and share its result.
    An empty table gives an empty one; other columns are left out. What is left need not be valid UTF-8.
    """
    small_batches(docs.sparkSession)
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LATE)).alias("doc"), F.xxhash64(data).alias("text_key"), data.alias("data"))
    least = options.get("least", LEAST)
    found = repeated_intervals(rows.select("doc", "text_key", "data"), **options)
    grouped = found.groupBy("doc", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))  # bounded by the document's length
    met = rows.join(grouped.hint("shuffle_hash"), ["doc", "text_key"], "left").select("doc_id", "data", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for cell, gone in zip(batch.column(1), batch.column(2).to_pylist()):
                text, kept, at, removed, spans, end = cell.as_py(), [], 0, 0, 0, -1
                for a, b in sorted((x["start"], x["stop"]) for x in gone or []):
                    spans += a > end
                    kept.append(text[at:a]) if a > at else None
                    removed += max(0, b - max(a, at))
                    at, end = max(at, b), max(end, b)
                left = b"".join([*kept, text[at:]])
                out.append((len(text), removed, spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
            n, removed, spans, sha, left = zip(*out) if out else ([],) * 5
            columns = {"doc_id": batch.column(0), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            if with_text:
                columns["kept"] = pa.array(left, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    assert least >= 2
    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
