"""Packing of 0/1 tracks into bit words and stitching of positive bins into segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions import bits
from binloom.functions.columns import ratio
from binloom.operators.intervals import merge_intervals
from binloom.params import DEFAULTS, MARKS, STAGES, STITCH_MARK


def pack_bins(
    bins: DataFrame, marks: Sequence[str] = MARKS, stages: Sequence[str] = STAGES
) -> DataFrame:
    """One row per (chrom, 32-bin word) with a bit mask per mark and stage.

    ``bins`` is long: ``chrom, bin, stage`` and one 0/1 column per mark. Zero bins add
    nothing, so sparse and dense tables give the same masks. The aggregation is a bitwise
    OR, so map tasks combine neighbouring bins before the shuffle.
    """
    place = F.pmod(F.col("bin"), F.lit(bits.WORD)).cast("int")
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    masks = []
    for mark in marks:
        for stage in stages:
            set_bit = F.when((F.col("stage") == stage) & (F.col(mark) == 1), F.col("_bit"))
            masks.append(F.coalesce(F.bit_or(set_bit), F.lit(0).cast("long")).alias(f"{mark}_{stage}"))
    return (
        bins.withColumn("_bit", flag)
        .groupBy("chrom", F.floor(F.col("bin") / bits.WORD).cast("long").alias("word"))
        .agg(*masks)
    )


def stitch_bits(
    words: DataFrame, min_len: int = DEFAULTS.min_len, keys: Sequence[str] = ("stage", "chrom"),
    bin_size: int = DEFAULTS.bin_size, width: int = DEFAULTS.scan_width,
) -> DataFrame:
    """Runs of set bits over the words of each key as segments ``start, end, len``.

    Runs inside a word come from its bits; runs that meet at a word border are merged.
    """
    first = bits.set_positions(bits.run_start_bits(F.col("mask")))
    last = bits.set_positions(bits.run_end_bits(F.col("mask")))
    runs = (
        words.filter("mask <> 0")
        .select(
            *keys,
            (F.col("word") * bits.WORD).alias("_base"),
            F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("_run"),
        )
        .select(
            *keys,
            (F.col("_base") + F.col("_run.first")).alias("start"),
            (F.col("_base") + F.col("_run.last") + 1).alias("end"),
        )
    )
    merged = merge_intervals(runs, keys, 0, width)
    length = F.col("end") - F.col("start")
    return merged.filter(length >= min_len).select(
        *keys,
        (F.col("start") * bin_size).alias("start"),
        (F.col("end") * bin_size).alias("end"),
        length.alias("len"),
    )


def stitch_segments(
    bins: DataFrame,
    mark: str = STITCH_MARK,
    min_len: int = DEFAULTS.min_len,
    bin_size: int = DEFAULTS.bin_size,
    width: int = DEFAULTS.scan_width,
) -> DataFrame:
    """Segments of consecutive positive bins of one mark, per stage and chromosome."""
    place = F.pmod(F.col("bin"), F.lit(bits.WORD)).cast("int")
    words = (
        bins.filter(F.col(mark) == 1)
        .groupBy("stage", "chrom", F.floor(F.col("bin") / bits.WORD).cast("long").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("mask"))
    )
    return stitch_bits(words, min_len, bin_size=bin_size, width=width)


def isolated_bins(bins: DataFrame, mark: str = STITCH_MARK, **kwargs) -> DataFrame:
    """Positive bins without a positive neighbour."""
    return stitch_segments(bins, mark, 1, **kwargs).filter("len = 1")


def length_cutoffs(
    segments: DataFrame, low: int = DEFAULTS.min_len, high: int = DEFAULTS.max_cutoff
) -> DataFrame:
    """Number and share of segments at least ``k`` bins long, per stage, for every cutoff."""
    lengths = segments.groupBy("stage", F.least("len", F.lit(high)).alias("len")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = lengths.groupBy("stage").agg(F.sum("n").alias("total"))
    reached = lengths.filter(F.col("len") >= low).select(
        "stage", F.explode(F.sequence(F.lit(low), F.col("len").cast("int"))).alias("cutoff_bins"), "n"
    )
    domain = totals.select(
        "stage",
        F.explode(F.sequence(F.lit(low), F.lit(high))).alias("cutoff_bins"),
        F.lit(0).cast("long").alias("n"),
    )
    return (
        reached.unionByName(domain)
        .groupBy("stage", "cutoff_bins")
        .agg(F.sum("n").alias("n_segments"))
        .join(totals, "stage")
        .select(
            "stage",
            F.col("cutoff_bins").cast("long").alias("cutoff_bins"),
            "n_segments",
            ratio(F.col("n_segments"), F.col("total")).alias("fraction"),
        )
    )


def input_summary(bins: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """Windows, marks and positive share of every mark, per stage, in long form."""
    sums = [F.sum(F.col(m).cast("long")).alias(m) for m in marks]
    wide = bins.groupBy("stage").agg(F.count(F.lit(1)).alias("n_windows"), *sums)
    return wide.unpivot(["stage", "n_windows"], list(marks), "mark", "n_positive").withColumn(
        "fraction", ratio(F.col("n_positive"), F.col("n_windows"))
    )
