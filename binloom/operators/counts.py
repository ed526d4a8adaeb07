"""Differential counts: negative-binomial fits of many features over few samples.

A feature's counts travel as one packed vector, so fits run in Arrow batches of many features
at a time and nothing else about a feature is shuffled. What the fits share over features
(size factors, the trend of dispersions, the spread around it) are grouped sums and exact
quantiles on Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.functions import negbin
from binloom.functions.tails import normal_two_sided
from binloom.operators.ranks import adjust_p, quantile_table
from binloom.params import DEFAULTS
from binloom.session import cut_lineage

#: Samples of one design; a packed vector holds a number for each.
MAX_SAMPLES = 4096
#: Features that one fit works on.
FIT_ROWS = 512


@dataclass(frozen=True)
class Design:
    """Samples in order, the level of each, and the levels; the first level is the reference."""

    samples: tuple
    of_sample: tuple[str, ...]
    levels: tuple[str, ...]

    @property
    def matrix(self) -> np.ndarray:
        """Intercept and an indicator for each level but the first."""
        column = np.array([self.levels.index(level) for level in self.of_sample])
        return np.column_stack([np.ones(len(column)), *((column == k).astype(float) for k in range(1, len(self.levels)))])

    def contrast(self, level: str, base: str) -> np.ndarray:
        """Weights of the coefficients in ``level`` against ``base``."""
        unit = np.eye(len(self.levels))
        unit[0] = 0.0
        return unit[self.levels.index(level)] - unit[self.levels.index(base)]


def read_design(design: DataFrame, levels: Sequence[str], sample: str = "sample", condition: str = "condition") -> Design:
    """The design of a table (sample, condition) with one row per sample, at most ``MAX_SAMPLES``."""
    rows = design.select(sample, condition).orderBy(sample).limit(MAX_SAMPLES + 1).collect()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    samples, of_sample = tuple(r[0] for r in rows), tuple(r[1] for r in rows)
    if len(set(samples)) < len(samples) or not set(of_sample) <= set(levels):
        raise ValueError("samples must differ and have a known level")
    if any(of_sample.count(level) == 0 for level in levels) or len(samples) <= len(levels):
        raise ValueError("every level needs a sample, and one level more than one")
    return Design(samples, of_sample, tuple(levels))


def packed_counts(
    counts: DataFrame, design: Design, feature: str = "feature", sample: str = "sample", value: str = "n", length: str | None = None
) -> DataFrame:
    """One row per feature: ``counts`` in sample order, absent ones 0; ``lengths`` where given.

    Repeated (feature, sample) rows add up, their lengths are averaged; samples outside the
    design are left out. A length that is absent, not finite or not positive counts as 1.
    """
    index = counts.sparkSession.createDataFrame([(s, k) for k, s in enumerate(design.samples)], f"{sample} {dict(counts.dtypes)[sample]}, _k int")
    measures = [F.sum(value).cast("double").alias("n")] + ([F.avg(length).alias("l")] if length else [])
    cells = counts.join(F.broadcast(index), sample).groupBy(feature, "_k").agg(*measures)
    names = {"counts": "n", "lengths": "l"} if length else {"counts": "n"}
    held = cells.groupBy(feature).agg(*[F.map_from_entries(F.collect_list(F.struct("_k", c))).alias(name) for name, c in names.items()])
    places = F.sequence(F.lit(0), F.lit(len(design.samples) - 1))

    def vector(name: str) -> Column:
        found = lambda k: F.col(name)[k]
        if name == "counts":
            return F.transform(places, lambda k: F.coalesce(found(k), F.lit(0.0)))
        usable = lambda k: (found(k) > 0) & (found(k) < float("inf"))
        return F.transform(places, lambda k: F.when(usable(k), found(k)).otherwise(1.0))

    return held.select(feature, *[vector(name).alias(name) for name in names])


def _each(packed: DataFrame, vector: Column) -> DataFrame:
    """Elements of a vector with the place of their sample."""
    return packed.select(F.posexplode(vector).alias("_k", "value"))


def size_factors(packed: DataFrame, design: Design) -> dict:
    """Median of ratios: per sample the median, over features with counts in all samples, of
    count by geometric mean over samples, taken as logarithms.

    With ``lengths`` the counts are first divided by length over its geometric mean.
    """
    n = len(design.samples)
    rows = packed
    if "lengths" in packed.columns:
        rows = rows.withColumn("counts", F.zip_with("counts", _scaled_lengths(n), lambda c, l: c / l))
    rows = rows.where(F.array_min("counts") > 0).select(F.transform("counts", lambda c: F.ln(c)).alias("logs"))
    centre = F.aggregate("logs", F.lit(0.0), lambda a, v: a + v) / n
    medians = quantile_table(_each(rows, F.transform("logs", lambda v: v - centre)), ["_k"], "value", {"median": 0.5})
    found = {r["_k"]: math.exp(r["median"]) for r in medians.collect()}  # a row per sample
    if len(found) < n:
        raise ValueError("no feature has counts in every sample")
    return {s: found[k] for k, s in enumerate(design.samples)}


def _scaled_lengths(n: int) -> Column:
    log_mean = F.aggregate("lengths", F.lit(0.0), lambda a, v: a + F.ln(v)) / n
    return F.transform("lengths", lambda v: v / F.exp(log_mean))


def normalised(packed: DataFrame, design: Design, factors: dict) -> DataFrame:
    """Adds ``factors`` (size factors; with lengths, factors of geometric mean 1 that hold both)
    and ``base_mean``, the mean of counts by factors."""
    n = len(design.samples)
    sizes = F.array(*[F.lit(float(factors[s])) for s in design.samples])
    if "lengths" in packed.columns:
        product = F.zip_with(_scaled_lengths(n), sizes, lambda l, s: l * s)
        log_mean = F.aggregate(product, F.lit(0.0), lambda a, v: a + F.ln(v)) / n
        sizes = F.transform(product, lambda v: v / F.exp(log_mean))
    rows = packed.withColumn("factors", sizes).drop("lengths")
    by_factor = F.zip_with("counts", "factors", lambda c, f: c / f)
    return rows.withColumn("base_mean", F.aggregate(by_factor, F.lit(0.0), lambda a, v: a + v) / n)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    """Slices of the batches with their vectors as matrices and their numbers as vectors."""
    for batch in batches:
        for begin in range(0, batch.num_rows, FIT_ROWS):
            part = batch.slice(begin, FIT_ROWS)
            held = {}
            for name, column in zip(part.schema.names, part.columns):
                if pa.types.is_list(column.type):
                    held[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                elif pa.types.is_floating(column.type):
                    held[name] = column.to_numpy(zero_copy_only=False)
            yield part, held


def _with_columns(rows: DataFrame, added: dict[str, str], fit) -> DataFrame:
    """Columns that ``fit`` computes from the vectors of many features at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _matrices(batches):
            values = fit(held)
            arrays = [pa.array(v.tolist() if v.ndim > 1 else v) for v in values]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *added])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in [*rows.dtypes, *added.items()])
    return rows.mapInArrow(work, schema)


def gene_dispersions(rows: DataFrame, design: Design) -> DataFrame:
    """Adds ``dispersion_own``: the maximum of the Cox-Reid adjusted profile likelihood.

    Features without any count are left out here; ``differential_counts`` returns them with nulls.
    """
    x = design.matrix
    fit = lambda held: [negbin.fit_dispersions(held["counts"], held["factors"], x)]
    return _with_columns(rows.where("base_mean > 0"), {"dispersion_own": "double"}, fit)


def dispersion_trend(fitted: DataFrame, rounds: int = 20) -> tuple[float, float]:
    """``(a, b)`` of the trend ``a + b / base_mean`` of own dispersions.

    A gamma model with identity link, fitted again without features that are 1e-4 or 15 times
    off it until it stays the same. Each step is one grouped sum. A fit without positive
    coefficients gives the mean dispersion as a constant.
    """
    usable = fitted.where(F.col("dispersion_own") > 100 * negbin.MIN_DISPERSION).select(
        (1.0 / F.col("base_mean")).alias("x"), F.col("dispersion_own").alias("y")
    )
    a, b = 0.1, 1.0
    for _ in range(rounds):
        old = (a, b)
        level = F.lit(old[0]) + F.lit(old[1]) * F.col("x")
        kept = usable.where((F.col("y") / level > 1e-4) & (F.col("y") / level < 15))
        for _ in range(rounds):
            weight = F.pow(F.lit(a) + F.lit(b) * F.col("x"), -2)
            terms = {"w": weight, "wx": weight * F.col("x"), "wxx": weight * F.col("x") ** 2, "wy": weight * F.col("y"), "wxy": weight * F.col("x") * F.col("y")}
            s = kept.agg(*[F.sum(term).alias(name) for name, term in terms.items()]).head()
            det = (s["w"] or 0.0) * (s["wxx"] or 0.0) - (s["wx"] or 0.0) ** 2
            if det <= 1e-12 * ((s["w"] or 0.0) * (s["wxx"] or 0.0)):
                a = b = 0.0
                break
            before = (a, b)
            a, b = (s["wxx"] * s["wy"] - s["wx"] * s["wxy"]) / det, (s["w"] * s["wxy"] - s["wx"] * s["wy"]) / det
            if min(a, b) <= 0 or max(abs(a / before[0] - 1), abs(b / before[1] - 1)) < 1e-8:
                break
        if min(a, b) <= 0:
            mean = usable.agg(F.avg("y")).head()[0]
            return (mean if mean is not None else negbin.MIN_DISPERSION), 0.0
        if math.log(a / old[0]) ** 2 + math.log(b / old[1]) ** 2 < 1e-6:
            break
    return a, b


def dispersion_spread(fitted: DataFrame, trend: tuple[float, float], design: Design) -> tuple[float, float]:
    """Variance of log dispersions around the trend, and the prior's part of it (0.25 at least).

    The variance is robust, by the median of absolute deviations; the sampling variance of a
    log dispersion at these degrees of freedom is taken off for the prior.
    """
    rest = fitted.where(F.col("dispersion_own") > 100 * negbin.MIN_DISPERSION).select(
        (F.ln("dispersion_own") - F.ln(F.lit(trend[0]) + F.lit(trend[1]) / F.col("base_mean"))).alias("value")
    )
    middle = quantile_table(rest, [], "value", {"median": 0.5}).head()
    if middle is None or middle["median"] is None:
        return 0.25, 0.25
    spread = quantile_table(rest.select(F.abs(F.col("value") - middle["median"]).alias("value")), [], "value", {"median": 0.5})
    variance = (1.4826 * spread.head()["median"]) ** 2
    freedom = len(design.samples) - len(design.levels)
    return variance, max(variance - negbin.trigamma(freedom / 2.0), 0.25)


def shrunk_dispersions(fitted: DataFrame, trend: tuple[float, float], spread: tuple[float, float], design: Design) -> DataFrame:
    """Adds ``dispersion_trend``, ``dispersion`` and ``dispersion_outlier``.

    The dispersion maximises the profile likelihood with a normal prior on its logarithm
    around the trend; a feature more than two deviations above the trend keeps its own.
    """
    x, (variance, prior) = design.matrix, spread

    def fit(held: dict[str, np.ndarray]) -> list[np.ndarray]:
        own, centre = np.log(held["dispersion_own"]), np.log(trend[0] + trend[1] / held["base_mean"])
        shrunk = negbin.fit_dispersions(held["counts"], held["factors"], x, centre, prior)
        outlier = own > centre + 2.0 * math.sqrt(variance)
        return [np.exp(centre), np.where(outlier, held["dispersion_own"], shrunk), outlier]

    return _with_columns(fitted, {"dispersion_trend": "double", "dispersion": "double", "dispersion_outlier": "boolean"}, fit)


def wald_tests(fitted: DataFrame, design: Design, contrasts: Sequence[tuple[str, str]]) -> DataFrame:
    """Per feature and contrast (level, base): ``log2_fold_change``, ``lfc_se``, ``stat``, ``p``."""
    x = design.matrix
    weights = np.array([design.contrast(*pair) for pair in contrasts])

    def fit(held: dict[str, np.ndarray]) -> list[np.ndarray]:
        alpha = held["dispersion"]
        beta, mu = negbin.fit_means(held["counts"], held["factors"], x, alpha)
        spread = np.einsum("cj,gjk,ck->gc", weights, negbin.covariances(mu, x, alpha), weights)
        return [beta @ weights.T / math.log(2.0), np.sqrt(spread) / math.log(2.0)]

    tested = _with_columns(fitted, {"_lfc": "array<double>", "_se": "array<double>"}, fit)
    names = F.array(*[F.lit(f"{level} vs {base}") for level, base in contrasts])
    rows = tested.withColumn("_c", F.explode(F.arrays_zip(names.alias("contrast"), "_lfc", "_se"))).select(
        *[c for c in fitted.columns if c not in ("counts", "factors")],
        F.col("_c.contrast").alias("contrast"),
        F.col("_c._lfc").alias("log2_fold_change"),
        F.col("_c._se").alias("lfc_se"),
    )
    rows = rows.withColumn("stat", F.col("log2_fold_change") / F.col("lfc_se"))
    return rows.withColumn("p", normal_two_sided("stat"))


def differential_counts(
    counts: DataFrame,
    design: DataFrame,
    levels: Sequence[str],
    contrasts: Sequence[tuple[str, str]],
    feature: str = "feature",
    sample: str = "sample",
    condition: str = "condition",
    value: str = "n",
    length: str | None = None,
    log2_fold: float = DEFAULTS.de_log2fc,
    alpha: float = DEFAULTS.de_padj,
) -> DataFrame:
    """Change of counts between levels, a row per feature and contrast.

    Columns: the feature, ``base_mean``, ``dispersion_own``, ``dispersion_trend``,
    ``dispersion``, ``dispersion_outlier``, ``contrast``, ``log2_fold_change``, ``lfc_se``,
    ``stat``, ``p``, ``p_adjusted`` (Benjamini-Hochberg per contrast) and ``change`` (Up, Down,
    NotSig by both cutoffs). A feature without counts has nulls but for its mean of 0.
    """
    known = read_design(design, levels, sample, condition)
    packed = cut_lineage(packed_counts(counts, known, feature, sample, value, length))
    rows = normalised(packed, known, size_factors(packed, known))
    own = cut_lineage(gene_dispersions(rows, known))
    trend = dispersion_trend(own)
    fitted = shrunk_dispersions(own, trend, dispersion_spread(own, trend, known), known)
    tested = adjust_p(cut_lineage(wald_tests(fitted, known, contrasts)), ["contrast"])
    up, down = F.col("log2_fold_change") >= log2_fold, F.col("log2_fold_change") <= -log2_fold
    sure = F.col("p_adjusted") < alpha
    tested = tested.withColumn("change", F.when(sure & up, "Up").when(sure & down, "Down").otherwise("NotSig"))
    silent = rows.where("base_mean = 0").select(
        feature, "base_mean", F.explode(F.array(*[F.lit(f"{a} vs {b}") for a, b in contrasts])).alias("contrast")
    )
    return tested.unionByName(silent, allowMissingColumns=True)
