"""Stability and validity of clusterings over a parameter grid."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators import mfa, neighbours, ranks, validity
from binloom.operators.sampling import unit_draw
from binloom.params import DEFAULTS, Params
from binloom.session import cut_lineage


def bootstrap_ari(
    points: DataFrame,
    labels: DataFrame,
    reps: int = DEFAULTS.n_boot,
    fraction: float = DEFAULTS.boot_fraction,
    k: int = DEFAULTS.knn_k,
    resolution: float = DEFAULTS.resolution,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """Adjusted Rand index (rep, ari) of re-clustered subsamples against ``labels``.

    The subsample is re-clustered with the parameters of the labels it is compared to.
    """
    rows = []
    for rep in range(1, reps + 1):
        drawn = points.filter(unit_draw(["id"], seed + rep) < fraction)
        again = neighbours.cluster(drawn, k, resolution, seed + rep).withColumnRenamed("cluster", "again")
        found = validity.adjusted_rand(again.join(labels, "id"), "again", "cluster").first()
        rows.append((rep, found["ari"]))
    return points.sparkSession.createDataFrame(rows, "rep int, ari double")


def grid(params: Params = DEFAULTS) -> list[tuple[float, float, int]]:
    """All (variance, resolution, k) cells."""
    return list(product(params.grid_variance, params.grid_resolution, params.grid_k))


def score_cell(
    features: DataFrame,
    key: str,
    families: dict,
    eigen: DataFrame,
    coordinates: DataFrame,
    switch: DataFrame,
    cell: tuple[float, float, int],
    params: Params = DEFAULTS,
) -> dict:
    """Silhouette, eta2, CH, DB, bootstrap ARI and cluster count of one grid cell.

    All indices are those of all rows.
    """
    share, resolution, k = cell
    embedded = mfa.reduce_to(eigen, coordinates, share).select(F.col(key).alias("id"), F.col("coord").alias("vec"))
    points = cut_lineage(embedded)
    labels = cut_lineage(neighbours.cluster(points, k, resolution, params.seed))
    named = labels.withColumnRenamed("id", key)
    drawn = cut_lineage(features.join(named, key))
    distances, levels = validity.cluster_distances(drawn, key, "cluster", families)
    distances = cut_lineage(distances)
    several = len(levels) > 1
    widths = validity.silhouette_widths(distances, levels, key, "cluster") if several else None
    effect = ranks.kruskal(drawn.select(key, "cluster").join(switch, key), [], "switch_score", "cluster")
    return {
        "threshold.emb": share,
        "resolution": resolution,
        "k.param": k,
        "Silhouette": widths.agg(F.avg("width")).first()[0] if several else None,
        "eta2": effect.first()["eta2"] if several else None,
        "CH": validity.calinski_harabasz(drawn, "cluster", families).first()["calinski_harabasz"] if several else None,
        "DB": validity.davies_bouldin(validity.mean_cluster_distances(distances, levels, "cluster")) if several else None,
        "Bootstrap_ARI": bootstrap_ari(points, labels, params.n_boot, params.boot_fraction, k, resolution, params.seed)
        .agg(F.avg("ari")).first()[0],
        "n_clusters": labels.select("cluster").distinct().count(),
    }
