"""URL filters: a cascade of Bloom filters with exact membership over the corpus's keys, without joins.

The keys of a URL are its host suffixes with the path prefixes that rules may have. Level one holds the listed
keys; level two the corpus keys that pass level one without being listed; level three the listed keys that
pass level two; and so on until a level lets nothing wrong through. The answer is exact for every key of the
corpus. The first level is sized for as many false positives as there are listed keys, later ones for half, so
all levels together take about 1.44 log2(keys / listed) + 6 bits per listed key: the bits are literals in the
plan, bounded by the rule list. Everything is DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import stored


@dataclass(frozen=True)
class UrlRule:
    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def candidate_keys(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Keys of a URL that a rule could have, by the shapes (labels, path length) that rules have."""
    labels = F.split(host, r"\.", -1)
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    keys = []
    for n, length in shapes:
        suffix = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
        fits = (F.size(labels) >= n) & (F.length(path) >= length) & (F.length(host) > 0)
        keys.append(F.when(fits, F.concat(suffix, F.substring(path, 1, length))))
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]

    def slot(self, key: Column, i: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt * 64 + i), key), F.lit(self.bits).cast("long"))

    def holds(self, key: Column, salt: int) -> Column:
        words, out = F.array(*[F.lit(w).cast("long") for w in self.words]), F.lit(True)
        for i in range(self.hashes):
            at = self.slot(key, i, salt)
            out = out & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return out


def _level(keys: DataFrame, n: int, miss: float, salt: int) -> Level:
    """Bits of the keys in column `key`; as many words as the level has come to the driver."""
    hashes = max(1, round(math.log2(1 / miss)))
    empty = Level(64 * max(1, math.ceil(n * hashes * 1.4427 / 64)), hashes, ())
    slots = keys.select(F.explode(F.array(*[empty.slot(F.col("key"), i, salt) for i in range(hashes)])).alias("at"))
    words = slots.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("set"))
    out = [0] * (empty.bits // 64)
    for word, value in words.toLocalIterator():
        out[word] = value
    return Level(empty.bits, hashes, tuple(out))


class Cascade:
    """Exact membership of `listed` keys among the keys of `universe` (DataFrames with a column `key`)."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> Cascade:
        inside = listed.select("key").distinct()
        outside = universe.select("key").distinct().join(inside, "key", "left_anti")
        n, total = inside.count(), outside.count()
        if not n:
            return cls([])
        levels: list[Level] = []
        miss = min(0.5, n / max(n, total))
        while n and len(levels) < most_levels:
            salt = len(levels)
            levels.append(_level(inside, n, miss, salt))
            inside, outside = outside.filter(levels[-1].holds(F.col("key"), salt)), inside
            n, miss = inside.count(), 0.5
        if n:
            raise ValueError("the cascade did not close")
        return cls(levels)

    def member(self, key: Column) -> Column:
        if not self.levels:
            return F.lit(False)
        out = F.when(~self.levels[0].holds(key, 0), False)
        for i, level in enumerate(self.levels[1:], 1):
            out = out.when(~level.holds(key, i), i % 2 == 1)
        return out.otherwise(len(self.levels) % 2 == 1)


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest key wins (at equal
    length the one with the longer host). Null urls and such without `://` have empty host and path and get
    `default`; repeated rows are each judged; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    keys = candidate_keys(F.col("host"), F.col("path"), rules)
    universe = stored(rows.select(F.explode(keys).alias("key")).distinct(), "url-keys")
    cascades = {}
    for action in sorted({r.action for r in rules}):
        listed = spark.createDataFrame([(r.key,) for r in rules if r.action == action], "key string")
        cascades[action] = Cascade.build(listed, universe)

    def weighed(key: Column) -> Column:
        action = F.lit(None).cast("string")
        for name, cascade in cascades.items():
            action = F.when(cascade.member(key), name).otherwise(action)
        return F.struct(F.length(key).alias("long"), F.instr(key, "/").alias("host_end"), key.alias("key"), action.alias("action"))

    fits = F.filter(F.transform(F.col("keys"), weighed), lambda x: x["action"].isNotNull())
    best = rows.withColumn("keys", keys).withColumn("best", F.array_max(fits))
    return best.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
