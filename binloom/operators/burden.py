"""Per-gene change burden of linked regions and its regression on expression change."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions import tails
from binloom.functions.columns import ratio
from binloom.operators.ranks import adjust_p
from binloom.operators.tables import column_profile
from binloom.params import DEFAULTS


def gene_burden(
    links: DataFrame,
    deltas: DataFrame,
    columns: dict[str, str],
    alpha: float = DEFAULTS.burden_alpha,
    region: str = "roi",
    gene: str = "gene_id",
) -> DataFrame:
    """Gain, loss, net and mean change per gene and mark over its linked regions.

    ``columns`` maps a mark to its delta column. Gain and loss are divided by the number
    of valid changes to the power ``alpha``; a mark without valid changes gives NULL.
    """
    linked = links.select(gene, region).distinct().join(deltas, region)
    totals = [F.count(F.lit(1)).alias("n_crr")]
    for mark, column in columns.items():
        delta = F.col(column)
        totals += [
            F.count(delta).alias(f"{mark}_n_valid"),
            F.sum(F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))).alias(f"_{mark}_up"),
            F.sum(F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))).alias(f"_{mark}_down"),
            F.avg(delta).alias(f"{mark}_mean"),
        ]
    sums = linked.groupBy(gene).agg(*totals)
    out = []
    for mark in columns:
        scale = F.pow(F.col(f"{mark}_n_valid").cast("double"), F.lit(alpha))
        gain, loss = ratio(F.col(f"_{mark}_up"), scale), ratio(F.col(f"_{mark}_down"), scale)
        out += [
            F.col(f"{mark}_n_valid"),
            gain.alias(f"{mark}_gain"),
            loss.alias(f"{mark}_loss"),
            (gain - loss).alias(f"{mark}_net"),
            F.col(f"{mark}_mean"),
        ]
    return sums.select(gene, "n_crr", F.log1p(F.col("n_crr").cast("double")).alias("log_n_crr"), *out)


def expression_change(expression: DataFrame, first: str, second: str, gene: str = "gene_id") -> DataFrame:
    """Mean log2(TPM + 1) over replicates at two periods, and their difference."""

    def level(period: str):
        return F.avg(F.when(F.col("period") == period, F.log2(F.col("tpm") + 1)))

    return expression.groupBy(gene).agg(
        level(first).alias("expr_period1"), level(second).alias("expr_period2")
    ).withColumn("expr_delta", F.col("expr_period2") - F.col("expr_period1"))


def usable_predictors(
    df: DataFrame, predictors: Sequence[str], max_zero: float = DEFAULTS.max_zero_fraction
) -> list[str]:
    """Predictors with spread, at least three values and not almost all zero."""
    profile = column_profile(df, predictors).collect()  # one row per predictor
    kept = {
        p["column"]
        for p in profile
        if p["variance"] and p["n_finite"] >= 3 and p["zero_fraction"] < max_zero
    }
    if not kept:
        raise ValueError("no predictor has enough variance and non-zero values")
    return [p for p in predictors if p in kept]


def fit_ols(
    df: DataFrame, response: str, predictors: Sequence[str], standardize: bool = True, level: float = 0.95
) -> DataFrame:
    """Least squares with intercept over complete rows: coefficients, tests and model summary.

    Spark reduces the rows to means and cross products, one small row; only that row is
    solved on the driver.
    """
    names = [*predictors, response]
    rows = df.select(*[F.col(n).cast("double").alias(n) for n in names]).dropna()
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)],
        *[
            F.covar_samp(a, b).alias(f"c_{i}_{j}")
            for i, a in enumerate(names)
            for j, b in enumerate(names)
            if i <= j
        ],
    ).first()
    n, k = stats["n"], len(predictors)
    if n <= k + 2:
        raise ValueError(f"too few complete rows: {n} for {k} predictors")
    cross = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            cross[i, j] = cross[j, i] = stats[f"c_{i}_{j}"] * (n - 1)
    means = np.array([stats[f"m_{i}"] for i in range(k + 1)])
    scale = np.sqrt(np.diag(cross)[:k] / (n - 1)) if standardize else np.ones(k)
    gram = cross[:k, :k] / np.outer(scale, scale)
    moment = cross[:k, k] / scale
    centre = np.zeros(k) if standardize else means[:k]
    if np.linalg.matrix_rank(gram) < k:
        raise ValueError("predictors are linearly dependent")
    inverse = np.linalg.inv(gram)
    beta = inverse @ moment
    freedom = n - k - 1
    residual = cross[k, k] - beta @ moment
    variance = residual / freedom
    errors = np.sqrt(variance * np.diag(inverse))
    intercept = means[k] - beta @ centre
    intercept_error = float(np.sqrt(variance * (1.0 / n + centre @ inverse @ centre)))
    r2 = 1.0 - residual / cross[k, k]
    adjusted = 1.0 - (1.0 - r2) * (n - 1) / freedom
    reach = tails.student_quantile(1.0 - (1.0 - level) / 2.0, freedom)
    table = []
    for term, b, se in zip(["(Intercept)", *predictors], [intercept, *beta], [intercept_error, *errors]):
        t = float(b / se)
        table.append(
            (term, float(b), float(se), t, tails.student_two_sided(t, freedom),
             float(b - reach * se), float(b + reach * se), int(n), float(r2), float(adjusted))
        )
    schema = (
        "term string, estimate double, std_error double, statistic double, p_value double, "
        "conf_low double, conf_high double, n_gene long, r_squared double, adj_r_squared double"
    )
    return df.sparkSession.createDataFrame(table, schema)


def fit_groups(
    models: dict[tuple[str, str], DataFrame], marks: Sequence[str], max_zero: float = DEFAULTS.max_zero_fraction
) -> DataFrame:
    """Coefficients of every (group, period) model with p-values adjusted per model and overall.

    Each model regresses ``expr_delta`` on the usable net burdens and the region count.
    """
    tables = None
    for (group, period), genes in models.items():
        usable = usable_predictors(genes, [f"{m}_net" for m in marks], max_zero)
        spread = genes.agg(F.stddev_samp("log_n_crr")).first()[0]
        fitted = fit_ols(genes, "expr_delta", [*usable, "log_n_crr"] if spread else usable)
        tagged = fitted.select(F.lit(group).alias("group"), F.lit(period).alias("period"), "*")
        tables = tagged if tables is None else tables.unionByName(tagged)
    slopes = tables.filter("term <> '(Intercept)'")
    within = adjust_p(slopes, ["group", "period"], "p_value", "BH", "FDR_within_model")
    return adjust_p(within, [], "p_value", "BH", "FDR_global")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlation of every column pair, one aggregation row unpivoted."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
