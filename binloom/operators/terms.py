"""Over-representation of annotation terms and module summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions import tails
from binloom.operators.ranks import adjust_p
from binloom.operators.tables import top_per_group
from binloom.params import DEFAULTS


def over_representation(
    genes: DataFrame,
    universe: DataFrame,
    annotation: DataFrame,
    keys: Sequence[str] = ("cluster",),
    min_size: int = DEFAULTS.go_min_size,
    max_size: int = DEFAULTS.go_max_size,
    min_genes: int = 10,
) -> DataFrame:
    """Hypergeometric test of every term in every gene list, BH-adjusted within the list.

    ``genes`` has the list keys and ``gene``, ``universe`` has ``gene`` and ``annotation``
    has ``term, gene``. Terms outside the size limits and lists with fewer than
    ``min_genes`` annotated genes are not tested.
    """
    keys = list(keys)
    known = annotation.select("term", "gene").distinct().join(universe.select("gene").distinct(), "gene", "left_semi")
    sizes = known.groupBy("term").agg(F.count(F.lit(1)).alias("term_size"))
    usable = sizes.filter(F.col("term_size").between(min_size, max_size))
    background = known.agg(F.count_distinct("gene")).scalar()
    listed = genes.select(*keys, "gene").distinct().join(known.select("gene").distinct(), "gene", "left_semi")
    drawn = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("list_size")).filter(F.col("list_size") >= min_genes)
    hits = (
        listed.join(known, "gene")
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(usable, "term")
        .join(drawn, keys)
        .withColumn("background", background)
    )
    tested = hits.withColumn("p", tails.hypergeometric_upper("n", "term_size", "background", "list_size"))
    return adjust_p(tested, keys, "p", "BH", "q")


def significant_terms(tested: DataFrame, q: float = DEFAULTS.go_q, generic: Sequence[str] = (), max_size: int | None = None) -> DataFrame:
    """Terms passing the threshold, without generic ones and those above ``max_size``."""
    kept = tested.filter((F.col("q") <= q) & (F.col("p") <= q))
    if generic:
        kept = kept.filter(~F.col("term").isin(*generic))
    return kept if max_size is None else kept.filter(F.col("term_size").isNull() | (F.col("term_size") <= max_size))


def module_representative(terms: DataFrame, module: str = "module", cluster: str = "cluster") -> DataFrame:
    """Term of each module in most clusters, then highest mean and maximum score, then name."""
    scored = terms.withColumn("_score", -F.log10("q")).groupBy(module, "term").agg(
        F.count_distinct(cluster).alias("n_clusters"), F.avg("_score").alias("mean_score"), F.max("_score").alias("max_score")
    )
    order = [F.desc("n_clusters"), F.desc("mean_score"), F.desc("max_score"), F.col("term")]
    return top_per_group(scored, [module], order)


def module_matrix(terms: DataFrame, clusters: Sequence[str], row: str = "term") -> DataFrame:
    """Best score per row and cluster, zero-filled, with the number of clusters present."""
    wide = (
        terms.withColumn("_score", -F.log10("q")).groupBy(row).pivot("cluster", list(clusters)).agg(F.max("_score"))
        .na.fill(0.0, list(clusters))
    )
    return wide.withColumn("n_present", sum((F.col(f"`{c}`") > 0).cast("long") for c in clusters))


def staircase(matrix: DataFrame, clusters: Sequence[str], row: str = "term") -> DataFrame:
    """Rows ordered by their first present cluster, then by falling best score."""
    first = F.coalesce(*[F.when(F.col(f"`{c}`") > 0, i) for i, c in enumerate(clusters)])
    best = F.greatest(*[F.col(f"`{c}`") for c in clusters])
    return matrix.withColumn("first_cluster", first).orderBy("first_cluster", F.desc(best), row)


def module_members(terms: DataFrame, module: str = "module") -> DataFrame:
    return terms.groupBy(module).agg(F.array_join(F.array_sort(F.collect_set("term")), " ; ").alias("members"))
