"""Weighted trees over cluster centres: degrees, leaves, distances from a root, pseudotime."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.functions.columns import ratio
from binloom.session import cut_lineage


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def root_leaf(edges: DataFrame, positions: DataFrame):
    """Leaf with the largest first coordinate; ``positions`` has (node, x)."""
    leaves = degrees(edges).filter("degree = 1").join(positions, "node")
    return leaves.agg(F.max_by("node", F.struct("x", "node"))).first()[0]


def tree_distances(edges: DataFrame, root) -> DataFrame:
    """Path length of every node from ``root`` on a tree, one join per level.

    Only the frontier is joined; reached nodes of each level are written out. A node that is
    reached twice lies on a cycle, which is an error.
    """
    links = cut_lineage(both_ways(edges))
    nodes = links.select("src").distinct().count()
    frontier = cut_lineage(
        links.select(F.lit(root).cast(links.schema["src"].dataType).alias("node")).limit(1)
        .withColumn("distance", F.lit(0.0)).withColumn("came", F.lit(None).cast(links.schema["src"].dataType))
    )
    levels, seen = [frontier], 1
    while True:
        step = (
            frontier.join(links.withColumnRenamed("src", "node"), "node")
            .filter(F.col("came").isNull() | (F.col("dst") != F.col("came")))
            .select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.col("node").alias("came"))
        )
        frontier = cut_lineage(step)
        size = frontier.count()
        if not size:
            break
        seen += size
        if seen > nodes:
            raise ValueError("the edges have a cycle")
        levels.append(frontier)
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.unionByName(level)
    return reached.select("node", "distance")


def pseudotime(assigned: DataFrame, distances: DataFrame) -> DataFrame:
    """Distance of each row's node scaled to [0, 1]; ``assigned`` has (id, node)."""
    low = distances.agg(F.min("distance")).scalar()
    high = distances.agg(F.max("distance")).scalar()
    return assigned.join(distances, "node").select(
        "id", "node", ratio(F.col("distance") - low, high - low).alias("pseudotime")
    )
