"""Features of regions of any width, from packed words that are never joined into one mask.

A region meets its words one by one. Every feature is a sum or a maximum over words, so map
tasks combine the words of a region before the shuffle and no region is gathered. What a word
has to know of its neighbours is one number per mask: how many set bins lead up to it. That
comes from a running maximum over the last zero bins and is found once for all regions.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.functions import bits
from binloom.functions.columns import ceil_to_grid, floor_to_grid, ratio
from binloom.operators.features import SPATIAL, mask_name, with_mean_jaccard
from binloom.operators.scan import Running, running
from binloom.params import DEFAULTS, MARKS, PATTERNS, STAGES

#: Words of one chunk of the running maximum.
CHUNK_WORDS = 4096
_ALL = (1 << bits.WORD) - 1


def run_name(mask: str) -> str:
    return f"run_{mask}"


def with_runs_before(words: DataFrame, names: Sequence[str], width: int = CHUNK_WORDS) -> DataFrame:
    """``words`` with ``run_<mask>``: the number of set bins that end right before the word.

    ``words`` has one row per (chrom, word); a word without a row is zero. Only words with a
    set bin are returned.
    """
    empty = words.select("chrom", (F.col("word") - 1).alias("word"), *[F.lit(0).cast("long").alias(n) for n in names])
    rows = words.select("chrom", "word", *names).unionByName(empty)
    rows = rows.groupBy("chrom", "word").agg(*[F.max(n).alias(n) for n in names])
    begin = F.col("word") * bits.WORD

    def last_zero(name: str) -> Column:
        zeros = F.bitwise_not(F.col(name)).bitwiseAND(F.lit(_ALL))
        return F.when(zeros != 0, begin + F.length(F.bin(zeros)) - 1)

    rows = rows.select("*", *[last_zero(n).alias(f"_zero_{n}") for n in names])
    specs = [Running(f"_last_{n}", "max", f"_zero_{n}", inclusive=False) for n in names]
    found = running(rows, ["chrom"], "word", specs, width)
    some = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return found.where(some != 0).select(
        "chrom", "word", *names, *[(begin - 1 - F.col(f"_last_{n}")).alias(run_name(n)) for n in names]
    )


def _placed(regions: DataFrame, key: str, bin_size: int, chroms: DataFrame | None) -> DataFrame:
    """A row per region and word it touches; ``_lo`` and ``_hi`` bound its bins in the word."""
    if chroms is not None:
        known = chroms.select("chrom").distinct().withColumn("_known", F.lit(True))
        unknown = F.raise_error(F.format_string("region %s lies on an unknown chromosome", F.col(key).cast("string")))
        regions = regions.join(known, "chrom", "left").withColumn(
            "chrom", F.when(F.col("_known"), F.col("chrom")).otherwise(unknown.cast("string"))
        )
    first = floor_to_grid(F.col("start"), bin_size).cast("long")
    stop = ceil_to_grid(F.col("end"), bin_size).cast("long")
    rows = regions.select(key, "chrom", first.alias("_first"), stop.alias("_stop")).where("_stop > _first")
    at = lambda c: F.floor(c / bits.WORD).cast("long")
    rows = rows.withColumn("word", F.explode(F.sequence(at(F.col("_first")), at(F.col("_stop") - 1))))
    begin = F.col("word") * bits.WORD
    return rows.select(
        key, "chrom", "word", (F.col("_stop") - F.col("_first")).alias("n_bins"), (begin - F.col("_first")).alias("_ahead"),
        (F.col("_stop") - begin <= bits.WORD).alias("_ends"), F.greatest(F.col("_first") - begin, F.lit(0)).alias("_lo"), F.least(F.col("_stop") - begin, F.lit(bits.WORD)).alias("_hi"),
    )


def region_sums(
    regions: DataFrame,
    words: DataFrame,
    key: str = "roi",
    marks: Sequence[str] = MARKS,
    stages: Sequence[str] = STAGES,
    bin_size: int = DEFAULTS.bin_size,
    chroms: DataFrame | None = None,
    width: int = CHUNK_WORDS,
) -> DataFrame:
    """Counts of every region, whatever its width, from which ``features_from_sums`` follows.

    Per mask: ``ones_``, ``place_`` (sum of the 1-based places of set bins), ``runs_``,
    ``best_`` (longest run) and ``flips_`` (changes from bin to bin). Per mark and pattern of
    stages ``pat_``, and per stage and pair of marks ``both_``. A region without bins has no
    row; one whose words are all zero has zeros. With ``chroms``, a region on a
    chromosome that is not listed raises an error.
    """
    names = [mask_name(m, s) for m in marks for s in stages]
    before = with_runs_before(words, names, width)
    rows = _placed(regions, key, bin_size, chroms).join(before, ["chrom", "word"], "left")
    inside = (bits.low_bits(F.col("_hi")) - bits.low_bits(F.col("_lo"))).alias("_in")
    rows = rows.select("*", inside)
    zero = F.lit(0).cast("long")
    follows = F.col("_ahead") > 0
    rows = rows.select(
        key, "n_bins", "_ahead", "_in",
        # The first and the last bin of the region, where the word holds them: a run that begins or ends there is no change.
        F.when(follows, zero).otherwise(F.col("_in").bitwiseAND(-F.col("_in"))).bitwiseOR(
            F.when(F.col("_ends"), bits.low_bits(F.col("_hi")) - bits.low_bits(F.col("_hi") - 1)).otherwise(zero)
        ).alias("_edge"),
        *[F.coalesce(F.col(n), zero).bitwiseAND(F.col("_in")).alias(n) for n in names],
        *[F.when(follows, F.least(F.coalesce(F.col(run_name(n)), zero), F.col("_ahead"))).otherwise(zero).alias(run_name(n)) for n in names],
    )
    sums = []
    for n in names:
        mask, led = F.col(n), F.col(run_name(n))
        shifted = F.shiftleft(mask, 1).bitwiseOR((led > 0).cast("long"))
        starts = F.bit_count(mask.bitwiseAND(F.bitwise_not(shifted)))
        ones = F.bit_count(mask)
        digits = [F.bit_count(mask.bitwiseAND(F.lit(sum(1 << i for i in range(bits.WORD) if i >> d & 1)))) * (1 << d) for d in range(5)]
        lengths = F.transform(F.split(F.bin(mask), "0"), lambda r: F.length(r))
        sums += [
            F.sum(ones).alias(f"ones_{n}"),
            F.sum(sum(digits[1:], digits[0]) + ones * (F.col("_ahead") + 1)).alias(f"place_{n}"),
            F.sum(starts).alias(f"runs_{n}"),
            F.max(F.greatest(F.array_max(lengths), F.element_at(lengths, -1) + led)).cast("long").alias(f"best_{n}"),
            F.sum(starts * 2 - F.bit_count(mask.bitwiseAND(F.col("_edge")))).alias(f"flips_{n}"),
        ]
    for mark in marks:
        for pattern in PATTERNS:
            chosen = F.col("_in")
            for stage, flag in zip(stages, pattern):
                mask = F.col(mask_name(mark, stage))
                chosen = chosen.bitwiseAND(mask if flag == "1" else F.bitwise_not(mask))
            sums.append(F.sum(F.bit_count(chosen)).alias(f"pat_{mark}_{pattern}"))
    for stage in stages:
        for a, b in combinations(marks, 2):
            shared = F.col(mask_name(a, stage)).bitwiseAND(F.col(mask_name(b, stage)))
            sums.append(F.sum(F.bit_count(shared)).alias(f"both_{a}_{b}_{stage}"))
    return rows.groupBy(key, "n_bins").agg(*sums)


def features_from_sums(
    sums: DataFrame, key: str = "roi", marks: Sequence[str] = MARKS, stages: Sequence[str] = STAGES
) -> DataFrame:
    """The features of ``features.feature_names`` from the counts of ``region_sums``."""
    bins = F.col("n_bins")
    count = lambda m, s: F.col(f"ones_{mask_name(m, s)}")
    out: dict[str, Column] = {}
    for mark in marks:
        for stage in stages:
            n = mask_name(mark, stage)
            values = (
                ratio(count(mark, stage), bins),
                F.col(f"runs_{n}").cast("double"),
                F.col(f"best_{n}").cast("double"),
                ratio(ratio(F.col(f"place_{n}"), count(mark, stage)), bins),
                ratio(F.col(f"flips_{n}"), bins - 1),
            )
            out |= {f"{n}_{stat}": value for stat, value in zip(SPATIAL, values)}
        out |= {f"{mark}_pattern_{p}": ratio(F.col(f"pat_{mark}_{p}"), bins) for p in PATTERNS}
        for a, b in zip(stages, stages[1:]):
            out[f"{mark}_delta_cov_{b}_{a}"] = ratio(count(mark, b) - count(mark, a), bins)
    for a, b in combinations(marks, 2):
        for stage in stages:
            both = F.col(f"both_{a}_{b}_{stage}")
            out[f"{a}_vs_{b}_{stage}_jaccard"] = ratio(both, count(a, stage) + count(b, stage) - both)
        steps = [[count(m, t) - count(m, s) for s, t in zip(stages, stages[1:])] for m in (a, b)]
        dot, na, nb = (sum((p * q for p, q in zip(x, y)), F.lit(0)) for x, y in (steps, (steps[0],) * 2, (steps[1],) * 2))
        cosine = F.coalesce(ratio(dot, F.sqrt(na * nb)), F.lit(0.0))
        out[f"HDC_{a}_vs_{b}_cos"] = F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))
    return with_mean_jaccard(sums.select(key, *[value.alias(name) for name, value in out.items()]), key, marks, stages)


def region_features(
    regions: DataFrame, words: DataFrame, key: str = "roi", marks: Sequence[str] = MARKS, stages: Sequence[str] = STAGES, **kwargs
) -> DataFrame:
    """Feature matrix of regions of any width over packed bins."""
    return features_from_sums(region_sums(regions, words, key, marks, stages, **kwargs), key, marks, stages)
