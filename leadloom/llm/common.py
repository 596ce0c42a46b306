"""Helpers shared by the operators: fresh tables in the shared folder, document columns, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import ensure_checkpoint_dir

#: Whole texts travel to Python in batches of so many rows, so that a batch of long texts stays small.
ROWS_PER_BATCH = 1_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written below the shared checkpoint folder and read again: cuts the lineage and
    survives lost executors, because every executor reads the same files."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of one Arrow batch of texts (a session setting; results do not depend on it)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id (long) and text (null becomes empty); all other columns are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with underscores before it until no column of `df` has it: for columns beside a caller's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of `df`, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def arrow_rows(fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: pa.Schema) -> Callable:
    """A mapInArrow function from one that yields column dicts per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return run


def binary_array(data: bytes, width: int) -> pa.Array:
    """An Arrow binary column of equally long cells, without copying cell by cell."""
    n = len(data) // width
    offsets = pa.array(range(0, n * width + 1, width), pa.int32()) if n else pa.array([0], pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(data)])


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH, size: str = "16m") -> Iterator[None]:
    """Arrow batches of so many rows and bytes at most for what is written inside; the settings are put back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, now in wanted.items():
        spark.conf.set(key, now)
    try:
        yield
    finally:
        for key, old in before.items():
            spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def heavy_keys(df: DataFrame, keys: list[str], share: int = 1_024, least: int = 2_000) -> DataFrame:
    """Keys with over 1 / `share` of the rows of `df` (and over `least` of them): fewer than `share` rows, whatever the input."""
    counts = stored(df.groupBy(*keys).agg(F.count("*").alias("_n")), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return counts.filter(F.col("_n") > max(total / share, least)).select(*keys)


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """`left` joined with `right` on `keys`; rows of a heavy key of `left` are dealt by their columns `by` over
    `salts` partitions, where the rows of `right` with that key stand once each."""
    marked = F.broadcast(stored(heavy_keys(left, keys), "heavy").withColumn("_heavy", F.lit(True)))  # below 1 024 rows
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    every = F.when(F.col("_heavy"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = left.join(marked, keys, "left").withColumn("_salt", salt).drop("_heavy")
    met = right.join(marked, keys, "left").withColumn("_salt", F.explode(every)).drop("_heavy")
    return dealt.join(met, [*keys, "_salt"], how).drop("_salt")


def bitmap_of(df: DataFrame, hashes: str, bits: int) -> bytes:
    """The low bits of the longs in column `hashes` as a bitmap of `bits` bits (a power of two), whatever the
    number of rows: bit i stands in byte i // 8."""
    one = 1 << 15  # bits of one of Spark's bitmaps
    slot = F.pmod(F.col(hashes), F.lit(bits).cast("long"))
    maps = df.groupBy(F.floor(slot / one).alias("at")).agg(F.bitmap_construct_agg(slot % one).alias("bits"))
    out = bytearray(bits // 8)
    for row in maps.toLocalIterator():
        at = row["at"] * one // 8
        part = row["bits"][: len(out) - at]
        out[at : at + len(part)] = part
    return bytes(out)
