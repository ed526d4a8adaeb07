"""Rank based statistics from running counts over distinct values.

All of them first collapse equal values to one row with a count, then scan the distinct
values in chunks, so neither a hot group nor a hot value ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.functions.columns import ratio
from binloom.operators.scan import Running, running, with_value_chunk
from binloom.session import cut_lineage

#: Distinct values that a chunk of a scan holds, on average.
CHUNK_VALUES = 250_000


def _running(base: DataFrame, keys: Sequence[str], value: str, specs: Sequence[Running]) -> DataFrame:
    """Running values over a written table of distinct values, in chunks of bounded size."""
    chunks = max(16, -(-base.count() // CHUNK_VALUES))
    return running(with_value_chunk(base, value, chunks), keys, value, specs)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, *extra: Column) -> DataFrame:
    """Distinct non-null values per key with their number of rows ``n``."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def group_total(df: DataFrame, keys: Sequence[str], *columns: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*columns)


def attach(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-key totals; without keys the single total row becomes scalar sub-queries."""
    if keys:
        return df.join(totals, list(keys))
    return df.select("*", *[totals.select(c).scalar().alias(c) for c in totals.columns])


def rank_table(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average rank, first rank and last rank of every distinct value per key."""
    return ranks_of_counts(value_counts(df, keys, value), keys, value)


def ranks_of_counts(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rank table of distinct values with their number of rows ``n``.

    The input is read once: the counts are written before the scan takes them three times,
    and so are the ranks, which callers read more than once.
    """
    scanned = _running(cut_lineage(counts), keys, value, [Running("rank_max", "sum", "n")])
    return cut_lineage(
        scanned.select(
            *keys,
            value,
            "n",
            (F.col("rank_max") - F.col("n") + 1).alias("rank_min"),
            "rank_max",
            (F.col("rank_max") - (F.col("n") - 1) / F.lit(2.0)).alias("rank_avg"),
        )
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    ranks = rank_table(df, keys, value).select(*keys, value, F.col("rank_avg").alias(name))
    return df.join(ranks, [*keys, value], "left").select(*df.columns, name)


def cumulative_share(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Empirical distribution function at every distinct value."""
    ranks = rank_table(df, keys, value)
    totals = group_total(ranks, keys, F.sum("n").alias("total"))
    return attach(ranks, totals, keys).select(
        *keys, value, ratio(F.col("rank_max"), F.col("total")).alias("ecdf")
    )


def adjust_p(
    df: DataFrame, keys: Sequence[str], p: str = "p", method: str = "BH", name: str = "p_adjusted"
) -> DataFrame:
    """Adjusted p-values per key: ``BH`` (step-up) or ``holm`` (step-down)."""
    ranks = rank_table(df, keys, p)
    totals = group_total(ranks, keys, F.sum("n").alias("m"))
    ranked = attach(ranks, totals, keys)
    if method == "BH":
        raw = F.col(p) * F.col("m") / F.col("rank_max")
        spec = Running("_best", "min", "_raw", forward=False)
    elif method == "holm":
        raw = F.col(p) * (F.col("m") - F.col("rank_min") + 1)
        spec = Running("_best", "max", "_raw")
    else:
        raise ValueError(f"unknown method {method}")
    scanned = _running(cut_lineage(ranked.select(*keys, p, raw.alias("_raw"))), keys, p, [spec])
    adjusted = scanned.select(*keys, p, F.least(F.lit(1.0), "_best").alias(name))
    return df.join(adjusted, [*keys, p], "left").select(*df.columns, name)


def quantile_table(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per entry of ``probs``."""
    ranks = rank_table(df, keys, value)
    totals = group_total(ranks, keys, F.sum("n").alias("total"))
    ranked = attach(ranks, totals, keys)

    def value_at(index: Column) -> Column:
        return F.max(F.when(F.col("rank_min") - 1 <= index, F.col(value).cast("double")))

    columns = []
    for name, prob in probs.items():
        place = (F.col("total") - 1) * F.lit(float(prob))
        columns += [
            value_at(F.floor(place)).alias(f"_lo_{name}"),
            value_at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_w_{name}"),
        ]
    found = ranked.groupBy(*keys).agg(*columns)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}") + F.col(f"_w_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
            ).alias(n)
            for n in probs
        ],
    )


def kruskal(df: DataFrame, keys: Sequence[str], value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, and the effect size (H - k + 1) / (n - k)."""
    clean = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    cells = cut_lineage(clean.groupBy(*keys, value, group).agg(F.count(F.lit(1)).alias("_c")))
    ranks = ranks_of_counts(cells.groupBy(*keys, value).agg(F.sum("_c").alias("n")), keys, value)
    sums = (
        cells.join(ranks.select(*keys, value, "rank_avg"), [*keys, value])
        .groupBy(*keys, group)
        .agg(F.sum(F.col("_c") * F.col("rank_avg")).alias("_r"), F.sum("_c").alias("_n"))
    )
    n = F.col("n")
    parts = sums.groupBy(*keys).agg(
        F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_q"),
        F.sum("_n").alias("n"),
        F.count(F.lit(1)).alias("k"),
    )
    t = F.col("n").cast("double")
    ties = ranks.groupBy(*keys).agg(F.sum(t * t * t - t).alias("_t"))
    total = n.cast("double")
    joined = attach(parts, ties, keys)
    h = (F.col("_q") * 12 / (total * (total + 1)) - 3 * (total + 1)) / (
        1 - F.col("_t") / (total * total * total - total)
    )
    return joined.withColumn("h", h).select(
        *keys, "n", "k", "h", ratio(F.col("h") - F.col("k") + 1, n - F.col("k")).alias("eta2")
    )


def ks_distance(
    df: DataFrame, keys: Sequence[str], value: str, group: str, first: str, second: str
) -> DataFrame:
    """Largest distance between the distribution functions of two groups."""
    picked = df.filter(F.col(group).isin(first, second))
    counts = value_counts(
        picked,
        keys,
        value,
        F.sum((F.col(group) == first).cast("long")).alias("_a"),
        F.sum((F.col(group) == second).cast("long")).alias("_b"),
    )
    counts = cut_lineage(counts)
    scanned = _running(counts, keys, value, [Running("_ca", "sum", "_a"), Running("_cb", "sum", "_b")])
    totals = group_total(counts, keys, F.sum("_a").alias("n_first"), F.sum("_b").alias("n_second"))
    gap = F.abs(
        ratio(F.col("_ca"), F.col("n_first")) - ratio(F.col("_cb"), F.col("n_second"))
    )
    return (
        attach(scanned, totals, keys)
        .groupBy(*keys, "n_first", "n_second")
        .agg(F.max(gap).alias("d"))
    )


def fence_bounds(df: DataFrame, keys: Sequence[str], value: str, factor: float) -> DataFrame:
    """Lower and upper fence ``Q1 - factor*IQR`` and ``Q3 + factor*IQR``."""
    quartiles = quantile_table(df, keys, value, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    return quartiles.select(
        *keys,
        (F.col("q1") - spread * factor).alias("fence_low"),
        (F.col("q3") + spread * factor).alias("fence_high"),
    )


def inside_fence(df: DataFrame, value: str, factor: float = 5.0) -> DataFrame:
    """Rows whose value lies inside the global fence."""
    bounded = attach(df, fence_bounds(df, [], value, factor), [])
    return bounded.filter(F.col(value).between(F.col("fence_low"), F.col("fence_high"))).select(*df.columns)


def outlier_flags(df: DataFrame, keys: Sequence[str], value: str, factor: float = 1.5) -> DataFrame:
    """Rows flagged ``is_outlier`` against the fence of their group."""
    bounded = attach(df, fence_bounds(df, keys, value, factor), keys)
    inside = F.col(value).between(F.col("fence_low"), F.col("fence_high"))
    return bounded.select(*df.columns, (~inside).alias("is_outlier"))


def clip_and_scale(
    df: DataFrame, keys: Sequence[str], value: str, low: float = 0.05, high: float = 0.95
) -> DataFrame:
    """Clip to the pooled quantiles of each key and scale to [0, 1]; NULL when they agree."""
    limits = quantile_table(df, keys, value, {"_lo": low, "_hi": high})
    inside = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    scaled = ratio(inside - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return attach(df, limits, keys).select(*df.columns, scaled.alias("scaled"))
