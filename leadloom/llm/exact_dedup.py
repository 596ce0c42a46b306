"""Exact dedup: 128-bit content hash, one stable row per group, bytes compared inside groups.

Hashes meet first, as 16-byte keys that are counted before they are shuffled. Bytes are compared only for
rows whose hash may be in a group: the hashes of groups are folded into bitmaps of fixed size that are
broadcast, so that texts of unique documents stay where they are. A fuller bitmap lets more rows through
and changes no result. Rows that share a hash but not the bytes form groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import fresh, hex_sha256, id_and_text, own_columns, stored

#: Bits of all bitmaps of group hashes together, whatever the input; Spark's bitmaps have 2 ** 15 bits each.
BITMAP_BITS, ONE_BITMAP = 1 << 23, 1 << 15


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def _maybe_in(rows: DataFrame, groups: DataFrame, bits: int) -> DataFrame:
    """Rows whose `content` may be that of a group: all that are, and others that share their bit. The table
    that is broadcast has bits / ONE_BITMAP rows of 4 KB at most."""
    slot = _slot(F.col("content"), bits)
    maps = groups.groupBy(F.floor(slot / ONE_BITMAP).alias("_map")).agg(F.bitmap_construct_agg(slot % ONE_BITMAP).alias("_bits"))
    met = rows.withColumn("_slot", slot).join(F.broadcast(maps), F.floor(F.col("_slot") / ONE_BITMAP) == F.col("_map"))
    at = F.col("_slot") % ONE_BITMAP
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(rows.columns)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, content: Callable[[Column], Column] = md5_128, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    `largest` keeps the row with the largest id, else the smallest. Null text counts as empty. Ids may be null
    or repeat: null ids lose to others, a group of null ids has keep_id null; of rows that repeat the kept id,
    one is kept. An empty table gives an empty one; other columns are left out.
    """
    text = id_and_text(docs, id_col, text_col).withColumn("content", content(F.col("text"))).withColumn("text_sha256", hex_sha256(F.col("text")))
    # hashes of all rows, stored once with a number that settles rows that repeat id and text: a number given
    # while the table is read again would depend on how its files are dealt then
    light = stored(text.drop("text").withColumn("row", F.monotonically_increasing_id()), "hashes")
    best = F.max(F.struct("doc_id", "row", "text_sha256")) if largest else F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_sha256"))
    kept = [F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("best.text_sha256").alias("keep_sha")]
    groups = light.groupBy("content").agg(F.count("*").alias("n"), best.alias("best")).filter("n > 1")
    shared = stored(groups.select("content", "n", *kept), "groups")
    members = _maybe_in(text, shared, bitmap_bits).join(shared, "content").select("content", "text", (F.col("text_sha256") == F.col("keep_sha")).alias("named"))
    # copies are folded where they are read: what meets is each text of a group once per task
    texts = members.groupBy("content", "text").agg(F.max("named").alias("named"))
    kept_text = texts.filter("named").groupBy("content").agg(F.min("text").alias("kept_text"))
    # texts that share the hash of others without being equal: none but for a collision
    collided = stored(texts.join(kept_text, "content").filter("text <> kept_text").select("content").distinct(), "collisions")
    apart = light.join(collided, "content", "left_semi").groupBy("content", "text_sha256").agg(F.count("*").alias("n2"), best.alias("best"))
    apart = apart.select("content", "text_sha256", "n2", F.col("best.doc_id").alias("keep2"), F.col("best.row").alias("row2"))
    sized = light.join(shared.drop("keep_sha"), "content", "left").join(apart, ["content", "text_sha256"], "left")
    first = lambda own, other, alone: F.when(F.col("n2").isNotNull(), F.col(own)).when(F.col("n").isNotNull(), F.col(other)).otherwise(F.col(alone))
    size = F.coalesce("n2", "n", F.lit(1).cast("long"))
    return sized.select("doc_id", first("keep2", "keep_id", "doc_id").alias("keep_id"), size.alias("group_size"), (first("row2", "keep_row", "row") == F.col("row")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The kept rows of `docs`, all columns: the decision of `exact_groups` meets its row by id and digest of
    the text. Of rows that repeat both, one stays. Other columns may have any name and pass as they are."""
    late, (key, sha) = F.lit(-(1 << 63)), fresh(docs, "_key", "_sha")
    found = exact_groups(docs, id_col, text_col, **options).filter("kept").select(F.coalesce("doc_id", late).alias(key), F.col("text_sha256").alias(sha))
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), late), sha: hex_sha256(F.coalesce(F.col(text_col), F.lit("")))})
    return keyed.join(found, [key, sha], "left_semi").dropDuplicates([key, sha]).select(own_columns(docs))
