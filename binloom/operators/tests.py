"""Hypothesis tests: sums and counts on Spark, tails on the few aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.functions import tails
from binloom.functions.columns import ratio


def two_by_two(df: DataFrame, keys: Sequence[str], row: Column, column: Column) -> DataFrame:
    """Counts a, b, c, d of two boolean conditions per key."""
    cell = lambda r, c: F.count_if((row == F.lit(r)) & (column == F.lit(c)))
    return df.groupBy(*keys).agg(
        cell(True, True).alias("a"),
        cell(True, False).alias("b"),
        cell(False, True).alias("c"),
        cell(False, False).alias("d"),
    )


def versus_rest(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """2x2 counts of every group against all other rows, from one count per group."""
    hits = df.groupBy(group).agg(F.count_if(flag).alias("a"), F.count_if(~flag).alias("b"))
    all_hits = hits.agg(F.sum("a")).scalar()
    all_rest = hits.agg(F.sum("b")).scalar()
    return hits.select(group, "a", "b", (all_hits - F.col("a")).alias("c"), (all_rest - F.col("b")).alias("d"))


def fisher(counts: DataFrame) -> DataFrame:
    """Add exact p, conditional odds ratio, limits and the sample odds ratio."""
    tested = counts.withColumn("_t", tails.fisher_test("a", "b", "c", "d"))
    sample = ratio(F.col("a") * F.col("d"), F.col("b") * F.col("c"))
    return tested.select(*counts.columns, "_t.*", sample.alias("sample_odds_ratio"))


def proportion(counts: DataFrame, hit: str, total: str, expected: Column, p_value: bool = True) -> DataFrame:
    """One-sided test that a proportion exceeds ``expected``, with continuity correction."""
    gap = F.col(hit) - F.col(total) * expected
    correction = F.least(F.lit(0.5), F.abs(gap))
    z = ratio(F.signum(gap) * (F.abs(gap) - correction), F.sqrt(F.col(total) * expected * (1 - expected)))
    out = counts.withColumn("z", z)
    return out.withColumn("p", tails.normal_upper("z")) if p_value else out


def welch(df: DataFrame, keys: Sequence[str], value: str, group: str, first: str, second: str) -> DataFrame:
    """Unequal-variance t statistic and degrees of freedom of two groups."""
    moments = []
    for name, label in (("x", first), ("y", second)):
        chosen = F.when(F.col(group) == label, F.col(value).cast("double"))
        moments += [
            F.avg(chosen).alias(f"m{name}"),
            F.var_samp(chosen).alias(f"v{name}"),
            F.count(chosen).alias(f"n{name}"),
        ]
    base = df.groupBy(*keys).agg(*moments)
    sx, sy = F.col("vx") / F.col("nx"), F.col("vy") / F.col("ny")
    freedom = ratio((sx + sy) * (sx + sy), sx * sx / (F.col("nx") - 1) + sy * sy / (F.col("ny") - 1))
    t = ratio(F.col("mx") - F.col("my"), F.sqrt(sx + sy))
    return base.filter("nx > 1 and ny > 1").select(*keys, t.alias("t"), freedom.alias("df"))


def paired(df: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Paired t statistic of two columns."""
    gap = (F.col(first) - F.col(second)).cast("double")
    base = df.groupBy(*keys).agg(F.avg(gap).alias("m"), F.stddev_samp(gap).alias("s"), F.count(gap).alias("n"))
    t = ratio(F.col("m"), F.col("s") / F.sqrt(F.col("n")))
    return base.select(*keys, t.alias("t"), (F.col("n") - 1).alias("df"))


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson r with its t statistic, and the simple regression of y on x."""
    dx, dy = F.col(x).cast("double"), F.col(y).cast("double")
    base = df.groupBy(*keys).agg(
        F.corr(dx, dy).alias("r"),
        F.regr_slope(dy, dx).alias("slope"),
        F.regr_intercept(dy, dx).alias("intercept"),
        F.count_if(dx.isNotNull() & dy.isNotNull()).alias("n"),
    )
    r = F.col("r")
    t = ratio(r * F.sqrt(F.col("n") - 2), F.sqrt(1 - r * r))
    return base.select(*keys, "n", "r", (r * r).alias("r2"), "slope", "intercept", t.alias("t"))


def fold_enrichment(counts: DataFrame, pseudo: float = 0.0) -> DataFrame:
    """Log2 ratio of the flagged share inside (a of a+b) to the share outside (c of c+d)."""
    inside = ratio(F.col("a") + pseudo, F.col("a") + F.col("b") + pseudo)
    outside = ratio(F.col("c") + pseudo, F.col("c") + F.col("d") + pseudo)
    return counts.withColumn("log2_fold", F.log2(F.nullif(ratio(inside, outside), F.lit(0.0))))


def with_t_p(tested: DataFrame, name: str = "p") -> DataFrame:
    """Two-sided p-value of columns ``t`` and ``df``."""
    return tested.withColumn(name, tails.t_two_sided("t", F.col("df").cast("double")))


def with_kruskal_p(tested: DataFrame, name: str = "p") -> DataFrame:
    return tested.withColumn(name, tails.chi2_tail("h", (F.col("k") - 1).cast("double")))


def with_ks_p(tested: DataFrame, name: str = "p") -> DataFrame:
    return tested.withColumn(name, tails.ks_tail("d", "n_first", "n_second"))
