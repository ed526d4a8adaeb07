"""Cluster validity from the group-weighted range-normalised (Gower) distance.

That distance is a weighted sum of one-dimensional absolute differences, so the summed
distance of a row to a whole cluster follows from running counts and sums over the sorted
values of every feature. Silhouette and Davies-Bouldin are exact without forming pairs, and
Calinski-Harabasz takes sums of squares on the same weighted features.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions.columns import ratio
from binloom.operators.scan import Running, running, with_value_chunk


def feature_weights(df: DataFrame, families: dict[str, Sequence[str]]) -> dict[str, float]:
    """Weight of each feature: equal share per family, divided by the feature's range."""
    names = [c for members in families.values() for c in members]
    limits = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in names]).first()  # one row
    used = {name: members for name, members in families.items() if members}
    return {
        c: (1.0 / (len(used) * len(members) * limits[c]) if limits[c] else 0.0)
        for members in used.values()
        for c in members
    }


def cluster_distances(
    df: DataFrame, key: str, label: str, families: dict[str, Sequence[str]]
) -> tuple[DataFrame, list]:
    """Summed distance of every row to every cluster, columns ``to_<i>``, and the labels in order."""
    labels = [row[0] for row in df.select(label).distinct().orderBy(label).collect()]  # few clusters
    weights = feature_weights(df, families)
    names = list(weights)
    long = df.unpivot([key, label], names, "feature", "x").withColumn("x", F.col("x").cast("double"))
    counted = long.groupBy("feature", "x").agg(
        *[F.count_if(F.col(label) == v).alias(f"n_{i}") for i, v in enumerate(labels)]
    )
    sums = counted.select("*", *[(F.col("x") * F.col(f"n_{i}")).alias(f"s_{i}") for i in range(len(labels))])
    parts = [f"{p}_{i}" for i in range(len(labels)) for p in "ns"]
    scanned = running(
        with_value_chunk(sums, "x"), ["feature"], "x", [Running(f"c{p}", "sum", p) for p in parts]
    )
    totals = sums.groupBy("feature").agg(*[F.sum(p).alias(f"t{p}") for p in parts])
    x = F.col("x")
    reach = [
        (
            x * F.col(f"cn_{i}") - F.col(f"cs_{i}") + (F.col(f"ts_{i}") - F.col(f"cs_{i}"))
            - x * (F.col(f"tn_{i}") - F.col(f"cn_{i}"))
        ).alias(f"d_{i}")
        for i in range(len(labels))
    ]
    by_value = scanned.join(totals, "feature").select("feature", "x", *reach)
    weight = F.element_at(
        F.create_map(*[F.lit(v) for item in weights.items() for v in item]), F.col("feature")
    )
    return (
        long.join(by_value, ["feature", "x"])
        .groupBy(key, label)
        .agg(*[F.sum(F.col(f"d_{i}") * weight).alias(f"to_{i}") for i in range(len(labels))]),
        labels,
    )


def silhouette_widths(distances: DataFrame, labels: Sequence, key: str, label: str) -> DataFrame:
    """Silhouette width of every row; rows of single-member clusters get 0."""
    sizes = distances.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).collect()  # few clusters
    count = {row[label]: row["_n"] for row in sizes}
    own = F.lit(None).cast("double")
    others = []
    for i, v in enumerate(labels):
        mine = F.col(label) == v
        own = F.when(mine, ratio(F.col(f"to_{i}"), F.lit(count[v] - 1))).otherwise(own)
        others.append(F.when(~mine, F.col(f"to_{i}") / F.lit(count[v])))
    nearest = F.array_min(F.array(*others))
    width = ratio(nearest - F.col("_a"), F.greatest(F.col("_a"), nearest))
    return distances.withColumn("_a", own).select(
        key, label, F.when(F.col("_a").isNull(), 0.0).otherwise(F.coalesce(width, F.lit(0.0))).alias("width")
    )


def mean_cluster_distances(distances: DataFrame, labels: Sequence, label: str) -> np.ndarray:
    """K x K mean pair distance between clusters; the diagonal is the mean within a cluster."""
    rows = distances.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"to_{i}").alias(f"_{i}") for i in range(len(labels))]
    ).collect()  # one row per cluster
    found = {row[label]: row for row in rows}
    out = np.zeros((len(labels), len(labels)))
    for i, a in enumerate(labels):
        for j, b in enumerate(labels):
            pairs = found[a]["_n"] * (found[b]["_n"] - (i == j))
            out[i, j] = found[a][f"_{j}"] / pairs if pairs else 0.0
    return out


def davies_bouldin(means: np.ndarray) -> float:
    """Mean over clusters of the worst (within + within) / between ratio."""
    within = np.diag(means)
    worst = []
    for i in range(len(means)):
        other = [
            (within[i] + within[j]) / means[i, j] if means[i, j] > 0 else np.inf
            for j in range(len(means))
            if j != i
        ]
        worst.append(max(other))
    return float(np.mean(worst))


def calinski_harabasz(df: DataFrame, label: str, families: dict[str, Sequence[str]]) -> DataFrame:
    """Calinski-Harabasz index (n, k, calinski_harabasz) of all rows.

    Sums of squares are Euclidean on the features after the range and family weights, so one
    grouped pass gives the sum within clusters and one the total; no pairs are formed.
    """
    weights = feature_weights(df, families)
    spread = reduce(lambda a, b: a + b, (F.var_pop(F.col(c).cast("double") * w) for c, w in weights.items()))
    inside = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), spread.alias("s"))
    inside = inside.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("s")).alias("wss"))
    total = df.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * spread).alias("tss"))
    between = ratio(F.col("tss") - F.col("wss"), (F.col("k") - 1).cast("double"))
    rest = ratio(F.col("wss"), (F.col("n") - F.col("k")).cast("double"))
    return total.join(F.broadcast(inside)).select("n", "k", ratio(between, rest).alias("calinski_harabasz"))  # one row each


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))

    def pairs(counts: DataFrame):
        n = F.col("n").cast("double")
        return counts.agg(F.sum(n * (n - 1) / 2)).scalar()

    both = pairs(cells)
    left = pairs(cells.groupBy(a).agg(F.sum("n").alias("n")))
    right = pairs(cells.groupBy(b).agg(F.sum("n").alias("n")))
    total = F.sum("n").cast("double")
    sizes = cells.agg((total * (total - 1) / 2).alias("all"), F.sum("n").alias("n"))
    expected = ratio(F.col("left") * F.col("right"), F.col("all"))
    top = F.col("both") - expected
    bottom = (F.col("left") + F.col("right")) / 2 - expected
    return sizes.select(
        "n", "all", both.alias("both"), left.alias("left"), right.alias("right")
    ).select("n", F.coalesce(ratio(top, bottom), F.lit(1.0)).alias("ari"))


def centroid_distances(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Euclidean distance between the mean vectors of every pair of clusters."""
    means = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])
    long = means.unpivot([label], list(columns), "feature", "v")
    left = long.select(F.col(label).alias("a"), "feature", F.col("v").alias("va"))
    right = long.select(F.col(label).alias("b"), "feature", F.col("v").alias("vb"))
    gap = F.col("va") - F.col("vb")
    return (
        left.join(right, "feature").filter("a < b").groupBy("a", "b").agg(F.sqrt(F.sum(gap * gap)).alias("distance"))
    )


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a labeling on undirected weighted edges (src, dst, weight), each listed once."""
    place = labels.select("id", "label")
    tagged = edges.join(place.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(
        place.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst"
    )
    m = tagged.agg(F.sum("weight")).scalar()
    ends = tagged.select(
        F.explode(
            F.array(
                F.struct(F.col("ls").alias("label"), "weight", F.lit(0.0).alias("inner")),
                F.struct(
                    F.col("ld").alias("label"),
                    "weight",
                    F.when(F.col("ls") == F.col("ld"), F.col("weight")).otherwise(0.0).alias("inner"),
                ),
            )
        ).alias("_e")
    ).select("_e.*")
    parts = ends.groupBy("label").agg(F.sum("inner").alias("i"), F.sum("weight").alias("d")).withColumn("m", m)
    share = F.col("d") / (2 * F.col("m"))
    return parts.agg(F.sum(F.col("i") / F.col("m") - share * share).alias("modularity"))


def mutual_edges(neighbours: DataFrame) -> DataFrame:
    """Undirected edges of pairs (src, dst) that list each other."""
    low = F.least("src", "dst").alias("a")
    high = F.greatest("src", "dst").alias("b")
    return (
        neighbours.select("src", "dst").distinct().select(low, high).groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
        .select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"))
    )


def agglomerate(distance: np.ndarray, method: str = "average", cut: float | None = None, k: int | None = None) -> list[int]:
    """Hierarchical grouping of a small distance matrix of cluster centres or terms.

    ``average`` or ``ward`` updates; stop at height ``cut`` or at ``k`` groups.
    """
    size = {i: 1 for i in range(len(distance))}
    member = {i: [i] for i in size}
    gap = distance.astype(float) ** (2 if method == "ward" else 1)
    np.fill_diagonal(gap, np.inf)
    while len(size) > (k or 1):
        i, j = divmod(int(np.argmin(gap)), len(gap))
        height = gap[i, j] ** (0.5 if method == "ward" else 1.0)
        if cut is not None and height > cut:
            break
        ni, nj = size[i], size[j]
        for x in size:
            if x in (i, j):
                continue
            if method == "ward":
                nx = size[x]
                new = ((ni + nx) * gap[i, x] + (nj + nx) * gap[j, x] - nx * gap[i, j]) / (ni + nj + nx)
            else:
                new = (ni * gap[i, x] + nj * gap[j, x]) / (ni + nj)
            gap[i, x] = gap[x, i] = new
        size[i] = ni + nj
        member[i] += member.pop(j)
        size.pop(j)
        gap[j, :] = gap[:, j] = np.inf
    out = [0] * len(distance)
    for number, group in enumerate(sorted(member.values(), key=min), 1):
        for row in group:
            out[row] = number
    return out
