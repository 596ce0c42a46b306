"""Tables that a stream builds up: keyed deltas, folded by order, under versions.

A batch adds one part per table; a version names the parts that are in force and is written last, as one row.
Readers take the latest version and so see all tables of a batch or none of them; parts are never overwritten,
so a reader that has begun keeps what it saw. A batch number that is already in force is not added again. One
writer at a time is assumed: the stream itself, which also compacts.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = "version long, batch long, parts map<string,array<string>>"


@dataclass
class DeltaStore:
    """Versioned tables below one folder."""

    spark: SparkSession
    path: str

    def version(self) -> tuple[int, int, dict[str, list[str]]]:
        """(number, batch, parts by table) in force; (0, -1, {}) before the first."""
        try:
            rows = self.spark.read.schema(_VERSION).json(f"{self.path}/_versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, -1, {}
        last = rows.orderBy(F.desc("version")).limit(1).collect()
        return (last[0]["version"], last[0]["batch"], dict(last[0]["parts"])) if last else (0, -1, {})

    def commit(self, batch: int | None, add: Mapping[str, DataFrame] | None = None, replace: Mapping[str, DataFrame] | None = None) -> bool:
        """Add parts to tables and replace the parts of others, in one step. False if the batch is in force."""
        number, done, parts = self.version()
        if batch is not None and batch <= done:
            return False
        for tables, old in ((add or {}, parts), (replace or {}, {})):
            for name, df in tables.items():
                part = f"{name}/{number + 1}-{uuid.uuid4().hex}"
                df.write.parquet(f"{self.path}/{part}")
                parts[name] = [*old.get(name, []), part]
        row = self.spark.createDataFrame([(number + 1, done if batch is None else batch, parts)], _VERSION)
        row.coalesce(1).write.mode("append").json(f"{self.path}/_versions")
        return True

    def has(self, name: str) -> bool:
        return name in self.version()[2]

    def read(self, name: str) -> DataFrame:
        """The parts of a table in force now; later versions do not change the frame."""
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in self.version()[2][name]])


@dataclass(frozen=True)
class Fold:
    """How the rows of a key become one: per column the value of the first or the last row, of those where the
    column is filled or of all. A folded column holds the order of its winner, so that folds of folds are folds,
    in whatever order the batches come."""

    keys: Sequence[str]
    first: Sequence[str] = ()
    first_filled: Sequence[str] = ()
    last: Sequence[str] = ()
    last_filled: Sequence[str] = ()
    sources: Mapping[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.first, *self.first_filled, *self.last, *self.last_filled]

    def _pick(self, name: str) -> type(F.min_by):
        return F.min_by if name in self.first or name in self.first_filled else F.max_by

    def rows(self, df: DataFrame, order: Column, where: Mapping[str, Column] | None = None) -> DataFrame:
        """One folded row per key; `where` limits the rows that count for a column."""
        cells = []
        for name in self.columns:
            value = F.col(self.sources.get(name, name))
            counts = (where or {}).get(name, value.isNotNull() if name in (*self.first_filled, *self.last_filled) else None)
            at = order if counts is None else F.when(counts, order)
            cells.append(self._pick(name)(F.struct(order.alias("o"), value.alias("v")), at).alias(name))
        return df.groupBy(*self.keys).agg(*cells)

    def folded(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys).agg(*[self._pick(c)(F.col(c), F.col(c)["o"]).alias(c) for c in self.columns])

    def values(self, parts: DataFrame) -> DataFrame:
        return self.folded(parts).select(*self.keys, *[F.col(c)["v"].alias(c) for c in self.columns])


def compact(store: DeltaStore, folds: Mapping[str, Fold], most_parts: int = 1) -> None:
    """Fold the tables with more than `most_parts` parts to one part each, in one new version."""
    parts = store.version()[2]
    long = {n: f.folded(store.read(n)) for n, f in folds.items() if len(parts.get(n, [])) > most_parts}
    if long:
        store.commit(None, replace=long)
