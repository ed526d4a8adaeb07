"""Queries over differential counts: order lines per part, stage and group of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from binloom.functions.columns import rounded
from binloom.operators import counts
from binloom.params import STAGES
from binloom.plans import adapters as A
from binloom.plans.sql import r6, stage

QUERIES, SQL = {}, {}
REPLICATES = 3


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def line_counts(spark, sf):
    """Order lines per part and sample; a sample is a stage and a third of the suppliers."""
    lines = A.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("feature"),
        F.concat_ws("_", A.stage_of("l_orderkey"), (F.col("l_suppkey") % REPLICATES).cast("string")).alias("sample"),
        F.col("l_quantity").cast("double").alias("quantity"),
    )
    return lines.groupBy("feature", "sample").agg(F.count("*").alias("n"), F.avg("quantity").alias("size"))


def design(spark):
    rows = [(f"{s}_{k}", s) for s in STAGES for k in range(REPLICATES)]
    return spark.createDataFrame(rows, "sample string, condition string")


CONTRASTS = (("d7", "d0"), ("d15", "d0"), ("d15", "d7"))
_CELLS = f"""cell AS (SELECT l_partkey AS feature, {stage('l_orderkey')} || '_' || (l_suppkey % 3) AS sample, count(*)::DOUBLE AS n
      FROM lineitem GROUP BY 1, 2),
    names AS (SELECT a.s || '_' || b.k AS sample FROM (SELECT unnest(['d0', 'd7', 'd15']) AS s) a, (SELECT unnest(range(3)) AS k) b),
    cells AS (SELECT f.feature, names.sample, coalesce(cell.n, 0.0) AS n FROM (SELECT DISTINCT feature FROM cell) f
      CROSS JOIN names LEFT JOIN cell ON cell.feature = f.feature AND cell.sample = names.sample),
    logs AS (SELECT feature, sample, ln(n) - avg(ln(n)) OVER (PARTITION BY feature) AS v FROM cells
      WHERE feature IN (SELECT feature FROM cells GROUP BY 1 HAVING min(n) > 0)),
    sizes AS (SELECT sample, exp(median(v)) AS f FROM logs GROUP BY 1)"""


@query("count_size_factors", f"WITH {_CELLS} SELECT sample, {r6('f')} AS factor FROM sizes")
def count_size_factors(spark, sf):
    """Size factor of every sample by the median of ratios."""
    known = counts.read_design(design(spark), STAGES)
    factors = counts.size_factors(counts.packed_counts(line_counts(spark, sf), known), known)
    return spark.createDataFrame(list(factors.items()), "sample string, factor double").select("sample", rounded(F.col("factor")).alias("factor"))


@query(
    "count_base_means",
    f"WITH {_CELLS} SELECT feature, {r6('avg(n / f)')} AS base_mean, {r6('max(n / f)')} AS most FROM cells JOIN sizes USING (sample) GROUP BY 1",
)
def count_base_means(spark, sf):
    """Mean and largest normalised count of every part."""
    known = counts.read_design(design(spark), STAGES)
    packed = A.cut_lineage(counts.packed_counts(line_counts(spark, sf), known))
    rows = counts.normalised(packed, known, counts.size_factors(packed, known))
    most = F.array_max(F.zip_with("counts", "factors", lambda c, f: c / f))
    return rows.select("feature", rounded(F.col("base_mean")).alias("base_mean"), rounded(most).alias("most"))


@query("differential_counts")
def differential_counts(spark, sf):
    """Parts whose lines change between stages: dispersions, folds, Wald tests, classes."""
    return counts.differential_counts(line_counts(spark, sf), design(spark), STAGES, CONTRASTS)
