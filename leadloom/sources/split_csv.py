"""CSV files with quoted line breaks, read by many tasks.

Lines are read as text, so that a file is split like any other. Whether a line begins inside a quoted field depends
on all lines before it, but only as one of two states: each line is a function of the state it begins with (it
keeps it, turns it or sets it), and functions of lines compose to functions of chunks. A window inside every chunk of
some thousand lines and a small one over the chunks of a file give each line its state; a record of one line is
complete as it stands, only the lines of longer ones meet. A window keeps its whole group in memory: chunks are lines
of one block of a file, and much shorter than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.session import stored

# Lines of a chunk; changes no result.
LINES_PER_CHUNK = 4_096
CHUNK = ["chunk", "at"]
OPTIONS = {"header": "true", "escape": '"', "quote": '"'}
# A quoted field, and what is inside one until its end; possessive, so that long fields need no backtracking.
_INSIDE = r'(?:[^"]++|"")*+'
_FIELD = rf'(?:^|,)"{_INSIDE}"(?=,|\r?$)'


def _opens(line: Column) -> Column:
    """Does a line that begins outside of quotes end inside? A quote counts only where a field begins."""
    rest = F.regexp_replace(line, _FIELD, ",")
    return F.rlike(rest, F.lit(rf'(?:^|,)"{_INSIDE}$'))


def _stays(line: Column) -> Column:
    """Does a line that begins inside of quotes end inside?"""
    end = rf'^{_INSIDE}"(?=,|\r?$)'
    return F.when(F.rlike(line, F.lit(end)), _opens(F.regexp_replace(line, end, ""))).otherwise(F.lit(True))


def _state(entry: Column, last_set: Column, turns: Column) -> Column:
    """State after some lines, from the last one that set it and the number of turns."""
    odd = lambda n: n % 2 == 1
    return F.when(last_set.isNotNull(), last_set["state"] != odd(turns - last_set["turns"])).otherwise(entry != odd(turns))


def _composed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add `turns` and `last_set` of the rows before; rows have `opens` and `stays`."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.col("opens") & ~F.col("stays"), 1).otherwise(0)
    counted = df.withColumn("turns", F.coalesce(F.sum(turn).over(before), F.lit(0)))
    sets = F.when(F.col("opens") == F.col("stays"), F.struct(F.col("opens").alias("state"), "turns"))
    return counted.withColumn("_sets", sets).withColumn("last_set", F.last("_sets", ignorenulls=True).over(before))


def _entered_either_way(lines: DataFrame) -> DataFrame:
    """Add to the lines of every chunk, for a chunk entered outside of quotes (0) and inside (1): does the line begin
    inside, and how many records have begun in the chunk up to it?"""
    rows = _composed(lines, CHUNK, ["line"])
    rows = rows.withColumns({f"inside{i}": _state(F.lit(bool(i)), F.col("last_set"), F.col("turns")) for i in (0, 1)})
    so_far = Window.partitionBy(*CHUNK).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({f"starts{i}": F.sum(F.when(F.col(f"inside{i}"), 0).otherwise(1)).over(so_far) for i in (0, 1)})


def csv_records(spark: SparkSession, path: str, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """(file, record, text): the records of every file in order, from 1; the header is one of them."""
    value = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
        "value", _opens(value).alias("opens"), _stays(value).alias("stays"),
    )
    # stored once: blocks and numbers depend on how the files are split at that moment
    lines = stored(lines, "lines")
    # a block by the number of its first line, so that windows carry no path
    blocks = stored(lines.groupBy("file", "block").agg(F.min("line").alias("at")), "blocks")
    lines = lines.join(blocks, ["file", "block"]).select("at", F.expr(f"line div {lines_per_chunk}").alias("chunk"), "line", "value", "opens", "stays")
    after = lambda state: F.when(state, F.col("stays")).otherwise(F.col("opens"))
    ends = {f"ends{i}": after(F.col(f"inside{i}")) for i in (0, 1)}
    chunks = _entered_either_way(lines).withColumns(ends).groupBy(*CHUNK).agg(
        F.max("starts0").alias("starts0"), F.max("starts1").alias("starts1"),
        F.bool_or(F.col("inside0") | F.col("ends0")).alias("several0"), F.bool_or(F.col("inside1") | F.col("ends1")).alias("several1"),
        F.max_by("ends0", "line").alias("opens"), F.max_by("ends1", "line").alias("stays"),
    )
    entered = _composed(chunks.join(blocks, "at"), ["file"], ["block", "chunk"]).withColumn("entry", _state(F.lit(False), F.col("last_set"), F.col("turns")))
    by_entry = lambda name: F.when(F.col("entry"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    earlier = Window.partitionBy("file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    entered = stored(entered.select(*CHUNK, "entry", by_entry("several").alias("several"), F.coalesce(F.sum(by_entry("starts")).over(earlier), F.lit(0)).alias("records")), "chunks")

    def placed(some: DataFrame) -> DataFrame:
        rows = _entered_either_way(some).join(entered, CHUNK)
        rows = rows.select("at", "line", "value", "opens", "stays", by_entry("inside").alias("inside"), (F.col("records") + by_entry("starts")).alias("record"))
        return rows.join(blocks, "at")

    # only lines of records that have several meet; chunks without such records are left out before
    alone = ~F.col("inside") & ~after(F.col("inside"))
    several = placed(lines.join(entered.filter("several").select(*CHUNK), CHUNK, "left_semi")).filter(~alone)
    met = several.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("lines"))
    joined = met.select("file", "record", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("text"))
    return joined.unionByName(placed(lines).filter(alone).select("file", "record", value.alias("text")))


def read_csv_split(spark: SparkSession, path: str) -> DataFrame:
    """Text columns by the header of the first file, and `source_file`.

    UTF-8 with or without byte-order mark; lines end with \\n or \\r\\n, which quoted fields keep. A quote opens a
    field only at its beginning; a field that is never closed takes the rest of its file. Empty lines have no row.
    """
    columns = spark.read.options(multiLine=True, **OPTIONS).csv(path).columns
    records = csv_records(spark, path).filter(F.col("record") > 1).withColumn("text", F.regexp_replace("text", r"\r$", "")).filter(F.col("text") != "")
    names = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    row = F.from_csv("text", names, {**OPTIONS, "multiLine": "true"})
    return records.select(row.alias("r"), F.element_at(F.split("file", "/"), -1).alias("source_file")).select("r.*", "source_file")
