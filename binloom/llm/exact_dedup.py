"""Exact deduplication: a two-pass Bloom filter finds the rows that may repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm.common import attach, filled
from binloom.session import cut_lineage

#: Bits of one filter block, as one bitmap of Spark holds.
BLOCK_BITS = 32768
#: A filter of up to so many bytes is broadcast; a larger one is joined by its blocks.
BROADCAST_BYTES = 64 << 20


def _bit(bitmap, position):
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (position % 8).cast("int"))) > 0


def _placed(rows: DataFrame, blocks: int) -> DataFrame:
    """Block and two places in it for the column ``_hash``."""
    place = lambda seed: F.pmod(F.xxhash64("_hash", F.lit(seed)), F.lit(BLOCK_BITS))
    return rows.select("*", F.pmod(F.xxhash64("_hash"), F.lit(blocks)).alias("block"), place(1).alias("p1"), place(2).alias("p2"))


def cell_filter(hashes: DataFrame, total: int, least: int = 1, bits_per_row: int = 16) -> tuple[DataFrame, int]:
    """Bloom filter (block, bitmap) of the cells that ``least`` or more hashes fall into.

    Column ``_hash`` is read. Returns the filter and its number of blocks; it is marked for
    broadcast where it has at most ``BROADCAST_BYTES``.
    """
    blocks = max(1, -(-total * bits_per_row // BLOCK_BITS))
    cells = _placed(hashes, blocks).select(F.explode(F.array(*(F.col("block") * BLOCK_BITS + F.col(p) for p in ("p1", "p2")))).alias("cell"))
    bitmaps = (
        cells.groupBy("cell")
        .count()
        .where(F.col("count") >= least)
        .groupBy(F.floor(F.col("cell") / BLOCK_BITS).alias("block"))
        .agg(F.bitmap_construct_agg(F.col("cell") % BLOCK_BITS).alias("bitmap"))
    )
    return (F.broadcast(bitmaps) if blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES else bitmaps), blocks


def in_filter(rows: DataFrame, bitmaps: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``_in``: whether both cells of ``_hash`` are in the filter."""
    found = _placed(rows, blocks).join(bitmaps, "block", "left")
    bitmap = F.col("bitmap")
    inside = F.coalesce(_bit(bitmap, F.col("p1")) & _bit(bitmap, F.col("p2")), F.lit(False))
    return found.withColumn("_in", inside).drop("block", "p1", "p2", "bitmap")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16
) -> DataFrame:
    """Group equal texts; of each group the row with the largest id stays.

    Returns one row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    Texts are equal when their SHA-256 is. Null texts equal the empty text. Rows that share
    one id are kept or dropped together; a null id stays only where its group has no other.
    An empty table gives no rows. Other columns are ignored.

    Pass one counts two filter cells per text hash and keeps the cells hit more than once, a
    bitmap per block of the filter. Pass two sends only rows whose cells are both in it to
    the grouping; all others are single and pass straight through. Groups reduce to a row
    each before the join back, and the hottest of them are joined by broadcast.
    """
    digest = F.sha2(filled(text_col).cast("binary"), 256)
    slim = cut_lineage(docs.select(F.col(id_col).alias("_id"), F.unhex(digest).alias("_digest")))
    total = slim.count()
    hashed = slim.withColumn("_hash", F.xxhash64("_digest"))
    flagged = in_filter(hashed, *cell_filter(hashed, total, 2, bits_per_row)).select("_id", "_digest", F.col("_in").alias("_may"))
    rows = flagged.where("_may").drop("_may")
    groups = rows.groupBy("_digest").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    repeated = attach(rows, groups, "_digest", "group_size", total)
    single = flagged.where(~F.col("_may")).select(
        "_digest", "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    return repeated.unionByName(single).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``ids``; null ids stay.

    Rows that a Bloom filter of the ids does not know pass straight through; only the others
    are shuffled to meet the exact list.
    """
    ids = cut_lineage(ids.toDF("_gone").where("_gone IS NOT NULL").distinct())
    bitmaps, blocks = cell_filter(ids.select(F.xxhash64("_gone").alias("_hash")), ids.count())
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), docs[id_col].alias("_id"))
    marked = in_filter(rows.withColumn("_hash", F.xxhash64("_id")), bitmaps, blocks)
    left = marked.where("_in").join(ids, F.col("_id") == F.col("_gone"), "left_anti")
    return marked.where("NOT _in").unionByName(left).select("_row.*")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return without(docs, exact_duplicates(docs, id_col, text_col).where("NOT kept").select(id_col), id_col)
