"""Shapes of the interval data model derived from the star-schema tables.

Every adapter reads whole tables; the shapes grow with them: one chromosome per supplier
or per customer, one bin per ship week, one region per order, one point per order line.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.operators import features, intervals, stitch
from binloom.params import MARKS, STAGES
from binloom.session import cut_lineage

EPOCH = "1995-01-01"
SEGMENT_LEN = 3
# Primes: shares of such widths hardly ever end on half of the last digit compared, where roundings differ.
WIDE_BINS = (83, 149)

# Order-line predicates that play the role of the eight marks, in mark order.
MARK_RULES = (
    "l_quantity >= 38",
    "l_tax >= 0.06",
    "l_orderkey is not null",
    "l_returnflag = 'R'",
    "l_discount >= 0.05",
    "l_returnflag = 'A'",
    "l_linenumber <= 2",
    "l_extendedprice >= 30000",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit(EPOCH).cast("date")).cast("long")


def stage_of(column: str):
    return F.element_at(F.array(*map(F.lit, STAGES)), (F.col(column) % 3 + 1).cast("int"))


def marked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as (chrom, stage, bin) with their 0/1 marks."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")).alias("chrom"),
        stage_of("l_orderkey").alias("stage"),
        F.floor(days("l_shipdate") / 7).cast("long").alias("bin"),
        *[F.expr(f"cast({rule} as int)").alias(m) for m, rule in zip(MARKS, MARK_RULES)],
    )


def _per_bin(cells: DataFrame) -> DataFrame:
    """One row per (chrom, stage, bin) with the largest value of every mark.

    The marks travel as one number, a bit for every 1 and one for every value that is not
    null, so a row of the grouping stays small however many marks there are.
    """
    n = len(MARKS)
    flags = [F.when(F.col(m) == 1, 1 << k | 1 << (n + k)).when(F.col(m).isNotNull(), 1 << (n + k)).otherwise(0) for k, m in enumerate(MARKS)]
    packed = cells.select("chrom", "stage", "bin", reduce(Column.bitwiseOR, flags).alias("_bits"))
    bit = lambda k: F.shiftright("_bits", k).bitwiseAND(1)
    return packed.groupBy("chrom", "stage", "bin").agg(F.bit_or("_bits").alias("_bits")).select(
        "chrom", "stage", "bin", *[F.when(bit(n + k) == 1, bit(k)).alias(m) for k, m in enumerate(MARKS)]
    )


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chromosomes of the tiling; its bins begin at 0."""
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("chr"), F.col("s_suppkey").cast("string")).alias("chrom"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bins`` that order lines fall in, without forming the others."""
    found = _per_bin(marked_cells(spark, sf_dir))
    tiled = _axes(spark, sf_dir).filter("chrom IS NOT NULL").distinct().withColumn("_tiled", F.lit(0))
    zero = F.when(F.col("bin") >= 0, F.col("_tiled"))
    return found.join(tiled, "chrom", "left").select("chrom", "stage", "bin", *[F.coalesce(m, zero).alias(m) for m in MARKS])


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete tiling (chrom, stage, bin) with one 0/1 column per mark."""
    lines = marked_cells(spark, sf_dir)
    last = lines.agg(F.max("bin")).scalar()
    # Suppliers are a small file: spread, or one task would hold the whole grid.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    grid = (
        _axes(spark, sf_dir)
        .repartition(parts)
        .withColumn("stage", F.explode(F.array(*map(F.lit, STAGES))))
        .withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .select("chrom", "stage", "bin", *[F.lit(0).alias(m) for m in MARKS])
    )
    return _per_bin(lines.unionByName(grid))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed bins; zero bins are implied, so the sparse cells suffice."""
    return cut_lineage(stitch.pack_bins(marked_cells(spark, sf_dir)))


def segments(spark: SparkSession, sf_dir: str, min_len: int = 2) -> DataFrame:
    """Segments, written once: the merge and every count scan them repeatedly."""
    return cut_lineage(stitch.stitch_segments(marked_cells(spark, sf_dir), min_len=min_len))


def long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that take part in the merge, named chrom:start:end."""
    return segments(spark, sf_dir, SEGMENT_LEN).withColumn(
        "name", F.concat_ws(":", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
    )


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.merge_stages(long_segments(spark, sf_dir), STAGES)
    return found.withColumn(
        "peak", F.concat_ws(":", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
    )


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split regions keyed by ``roi``."""
    pieces = intervals.split_long(merged(spark, sf_dir).select("chrom", "start", "end", "peak"))
    return cut_lineage(pieces.select("chrom", "start", "end", F.col("peak").alias("roi")))


def roi_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature matrix of the split regions, written once."""
    return cut_lineage(features.region_features(rois(spark, sf_dir), words(spark, sf_dir)))


def roi_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.region_masks(rois(spark, sf_dir), words(spark, sf_dir))


def wide_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chromosome whole and in tiles of ``WIDE_BINS``, beyond what one mask of bits holds."""
    last = marked_cells(spark, sf_dir).agg(F.max("bin")).scalar()
    chroms = table(spark, sf_dir, "supplier").select(F.concat(F.lit("chr"), F.col("s_suppkey").cast("string")).alias("chrom"))
    tiles = chroms.withColumn("last", last).withColumn("width", F.explode(F.array(*map(F.lit, WIDE_BINS), F.col("last") + 1)))
    tiles = tiles.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / F.col("width")).cast("long"))))
    start = F.col("tile") * F.col("width")
    return cut_lineage(
        tiles.select(
            "chrom", (start * 200).alias("start"), (F.least(start + F.col("width"), F.col("last") + 1) * 200).alias("end"),
            F.concat_ws(":", "chrom", "width", "tile").alias("roi"),
        )
    )


def regions(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ("*",)) -> DataFrame:
    """One region per order: from the order day to its last ship day; only ``columns`` are read and written."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("last_ship")
    )
    return cut_lineage(
        table(spark, sf_dir, "orders")
        .join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_orderkey").alias("rid"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("chrom"),
            days("o_orderdate").alias("start"),
            days("last_ship").alias("end"),
            stage_of("o_orderkey").alias("stage"),
            F.col("o_orderpriority").alias("cluster"),
        )
        .filter("end > start")
        .select(*columns)
    )


def points(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ("*",)) -> DataFrame:
    """One stranded point per order line; its gene is the part. Only ``columns`` are read, shuffled and written."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return cut_lineage(
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("chrom"),
            days("l_shipdate").alias("pos"),
            F.col("l_partkey").alias("gene"),
            F.when(F.col("l_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"),
            F.col("l_orderkey"),
            F.col("l_linenumber"),
            F.col("l_quantity"),
        )
        .select(*columns)
    )
