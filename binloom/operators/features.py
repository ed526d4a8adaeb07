"""Per-region features of binned marks over stages.

A region's bins are held as one bit mask per mark and stage, so 24 long columns replace
the bin x mark x stage array and every feature is a bit-count expression. The bin table
is packed into 32-bin words before it is joined, which makes the join rows 32 times
fewer than bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.functions import bits
from binloom.functions.columns import ceil_to_grid, floor_to_grid, ratio
from binloom.params import (
    ACTIVE_MARKS,
    DEFAULTS,
    MARKS,
    PATTERNS,
    REPRESSIVE_MARKS,
    STAGES,
)

SPATIAL = ("coverage", "nseg", "maxseg_bins", "com", "local_var")


def mask_name(mark: str, stage: str) -> str:
    return f"{mark}_{stage}"


def spatial_names(marks=MARKS, stages=STAGES) -> list[str]:
    return [f"{m}_{s}_{stat}" for m in marks for s in stages for stat in SPATIAL]


def temporal_names(marks=MARKS, stages=STAGES) -> list[str]:
    names = []
    for m in marks:
        names += [f"{m}_pattern_{p}" for p in PATTERNS]
        names += [f"{m}_delta_cov_{b}_{a}" for a, b in zip(stages, stages[1:])]
    return names


def jaccard_names(marks=MARKS, stages=STAGES) -> list[str]:
    names = []
    for s in stages:
        names += [f"{a}_vs_{b}_{s}_jaccard" for a, b in combinations(marks, 2)]
        names.append(f"mean_jaccard_{s}")
    return names


def concordance_names(marks=MARKS) -> list[str]:
    return [f"HDC_{a}_vs_{b}_cos" for a, b in combinations(marks, 2)]


def feature_names(marks=MARKS, stages=STAGES) -> list[str]:
    return (
        spatial_names(marks, stages)
        + temporal_names(marks, stages)
        + jaccard_names(marks, stages)
        + concordance_names(marks)
    )


def feature_families(columns: Sequence[str]) -> dict[str, list[str]]:
    """The six feature families among ``columns``, in fixed order."""
    rules = {
        "spatial_cov": ("coverage", "_nseg", "has_signal"),
        "spatial_shape": ("maxseg", "com", "local_var"),
        "time_pattern": ("pattern",),
        "time_diff": ("delta_cov",),
        "jaccard": ("jaccard",),
        "hsc": ("HDC",),
    }
    return {
        family: [c for c in columns if any(part in c for part in parts)]
        for family, parts in rules.items()
    }


def region_masks(
    regions: DataFrame,
    words: DataFrame,
    key: str = "roi",
    marks: Sequence[str] = MARKS,
    stages: Sequence[str] = STAGES,
    bin_size: int = DEFAULTS.bin_size,
) -> DataFrame:
    """Bit masks of every region: bins ``floor(start/bin) .. ceil(end/bin) - 1``.

    Regions come out of ``split_long``, which bounds their width; a region of more than
    62 bins raises an error rather than losing bins: ``wide.region_features`` takes any width.
    """
    names = [mask_name(m, s) for m in marks for s in stages]
    first = floor_to_grid(F.col("start"), bin_size)
    stop = ceil_to_grid(F.col("end"), bin_size)
    too_wide = F.raise_error(F.format_string("region %s spans more than 62 bins", F.col(key)))
    size = F.when(stop - first > bits.REGION_BITS, too_wide.cast("long")).otherwise(stop - first)
    placed = regions.select(key, "chrom", first.alias("_first"), size.alias("n_bins")).withColumn(
        "word",
        F.explode(
            F.sequence(
                F.floor(F.col("_first") / bits.WORD).cast("long"),
                F.floor((F.col("_first") + F.col("n_bins") - 1) / bits.WORD).cast("long"),
            )
        ),
    )
    offset = F.col("word") * bits.WORD - F.col("_first")
    inside = bits.low_bits(F.col("n_bins"))
    parts = placed.join(words, ["chrom", "word"], "left").select(
        key,
        "n_bins",
        *[bits.shifted(F.coalesce(F.col(n), F.lit(0)), offset).bitwiseAND(inside).alias(n) for n in names],
    )
    return parts.groupBy(key, "n_bins").agg(*[F.bit_or(n).alias(n) for n in names])


def _quotient(top: str, bottom: str) -> str:
    return f"try_divide(cast({top} as double), cast({bottom} as double))"


def _spatial(mark: str, stage: str) -> dict[str, str]:
    mask = f"`{mask_name(mark, stage)}`"
    count = f"bit_count({mask})"
    starts = f"{mask} & ~shiftleft({mask}, 1)"
    digits = [
        f"bit_count({mask} & {sum(1 << i for i in range(bits.REGION_BITS) if i >> d & 1)}) * {1 << d}"
        for d in range(6)
    ]
    changes = f"bit_count(({mask} ^ shiftright({mask}, 1)) & (shiftleft(1L, n_bins - 1) - 1))"
    values = (
        _quotient(count, "n_bins"),
        f"cast(bit_count({starts}) as double)",
        f"cast(array_max(transform(split(bin({mask}), '0'), r -> length(r))) as double)",
        _quotient(f"{' + '.join(digits)} + {count}", f"{count} * n_bins"),
        _quotient(changes, "n_bins - 1"),
    )
    return {f"{mark}_{stage}_{stat}": value for stat, value in zip(SPATIAL, values)}


def _temporal(mark: str, stages: Sequence[str]) -> dict[str, str]:
    masks = [f"`{mask_name(mark, s)}`" for s in stages]
    out = {}
    for pattern in PATTERNS:
        chosen = " & ".join(m if flag == "1" else f"~{m}" for m, flag in zip(masks, pattern))
        share = _quotient(f"bit_count({chosen} & (shiftleft(1L, n_bins) - 1))", "n_bins")
        out[f"{mark}_pattern_{pattern}"] = share
    for (s0, m0), (s1, m1) in zip(zip(stages, masks), zip(stages[1:], masks[1:])):
        out[f"{mark}_delta_cov_{s1}_{s0}"] = _quotient(f"bit_count({m1}) - bit_count({m0})", "n_bins")
    return out


def _jaccard(a: str, b: str, stage: str) -> str:
    left, right = f"`{mask_name(a, stage)}`", f"`{mask_name(b, stage)}`"
    return _quotient(f"bit_count({left} & {right})", f"bit_count({left} | {right})")


def _concordance(a: str, b: str, stages: Sequence[str]) -> str:
    """Cosine of the two change vectors; a mark without change gives 0."""

    def steps(mark: str) -> list[str]:
        counts = [f"bit_count(`{mask_name(mark, s)}`)" for s in stages]
        return [f"({after} - {before})" for before, after in zip(counts, counts[1:])]

    da, db = steps(a), steps(b)
    dot = " + ".join(f"{x} * {y}" for x, y in zip(da, db))
    norms = [" + ".join(f"{x} * {x}" for x in d) for d in (da, db)]
    cosine = _quotient(f"({dot})", f"sqrt(({norms[0]}) * ({norms[1]}))")
    return f"greatest(least(coalesce({cosine}, 0D), 1D), -1D)"


def features_from_masks(
    masks: DataFrame,
    key: str = "roi",
    marks: Sequence[str] = MARKS,
    stages: Sequence[str] = STAGES,
) -> DataFrame:
    """All features of ``feature_names`` as double columns next to the region key."""
    pairs = list(combinations(marks, 2))
    columns: dict[str, str] = {}
    for mark in marks:
        for stage in stages:
            columns |= _spatial(mark, stage)
        columns |= _temporal(mark, stages)
    for stage in stages:
        columns |= {f"{a}_vs_{b}_{stage}_jaccard": _jaccard(a, b, stage) for a, b in pairs}
    columns |= {f"HDC_{a}_vs_{b}_cos": _concordance(a, b, stages) for a, b in pairs}
    wide = masks.selectExpr(key, *[f"{value} AS `{name}`" for name, value in columns.items()])
    return with_mean_jaccard(wide, key, marks, stages)


def with_mean_jaccard(wide: DataFrame, key: str, marks: Sequence[str] = MARKS, stages: Sequence[str] = STAGES) -> DataFrame:
    """``wide`` with the mean over the known pairs of each stage, columns in the order of ``feature_names``."""
    pairs = list(combinations(marks, 2))
    means = []
    for stage in stages:
        known = ", ".join(f"`{a}_vs_{b}_{stage}_jaccard`" for a, b in pairs)
        known = f"filter(array({known}), v -> v is not null)"
        total = f"aggregate({known}, 0D, (s, v) -> s + v)"
        means.append(f"{_quotient(total, f'size({known})')} AS `mean_jaccard_{stage}`")
    return wide.selectExpr("*", *means).select(key, *feature_names(marks, stages))


def region_features(regions: DataFrame, words: DataFrame, key: str = "roi", **kwargs) -> DataFrame:
    """Feature matrix of the regions over packed bins."""
    return features_from_masks(region_masks(regions, words, key, **kwargs), key)


def net_change(
    masks: DataFrame, marks: Sequence[str] = MARKS, stages: Sequence[str] = STAGES, key: str = "roi"
) -> DataFrame:
    """Change vectors by net flipped bins, long: (region, mark, d_first, d_second).

    A mark absent at every stage has NULL changes.
    """
    rows = []
    for mark in marks:
        cells = [F.col(mask_name(mark, s)) for s in stages]
        absent = cells[0].bitwiseOR(cells[1]).bitwiseOR(cells[2]) == 0
        steps = []
        for before, after in zip(cells, cells[1:]):
            gained = F.bit_count(after.bitwiseAND(F.bitwise_not(before)))
            lost = F.bit_count(before.bitwiseAND(F.bitwise_not(after)))
            steps.append(F.when(~absent, ratio(gained - lost, F.col("n_bins"))))
        rows.append(
            F.struct(
                F.lit(mark).alias("mark"), steps[0].alias("d_first"), steps[1].alias("d_second")
            )
        )
    return masks.select(key, F.explode(F.array(*rows)).alias("_r")).select(key, "_r.*")


def switch_score(
    features: DataFrame, key: str = "roi", first: str = STAGES[0], last: str = STAGES[-1]
) -> DataFrame:
    """Standardised change of active minus repressive coverage between two stages."""

    def balance(stage: str) -> Column:
        active = sum(F.col(f"{m}_{stage}_coverage") for m in ACTIVE_MARKS)
        repressive = sum(F.col(f"{m}_{stage}_coverage") for m in REPRESSIVE_MARKS)
        return active - repressive

    raw = features.select(key, (balance(last) - balance(first)).alias("_raw"))
    centre = raw.agg(F.avg("_raw")).scalar()
    spread = raw.agg(F.stddev_samp("_raw")).scalar()
    return raw.select(key, ratio(F.col("_raw") - centre, spread).alias("switch_score"))


def long_features(features: DataFrame, names: Sequence[str], key: str = "roi") -> DataFrame:
    """Unpivot feature columns to (region, feature, value)."""
    return features.unpivot([key], list(names), "feature", "value")
