"""Similarity of terms on a weighted graph of terms and their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.session import cut_lineage

# What a parent keeps of its child's weight, by kind of link.
LINK_WEIGHTS = {"is_a": 0.8, "part_of": 0.6}


def ancestor_weights(links: DataFrame, max_doublings: int = 32) -> DataFrame:
    """(term, ancestor, weight): the largest product of weights along any path up, 1 for itself.

    ``links`` has (child, parent, weight) with weights in (0, 1). Known paths are joined with
    known paths, so their length doubles each round, and of paths with the same ends the
    heaviest stays. A cycle is an error; a parent that is no child has itself alone.
    """
    if not links.where("weight IS NULL OR weight <= 0 OR weight >= 1 OR child IS NULL OR parent IS NULL").isEmpty():
        raise ValueError("links need a child, a parent and a weight between 0 and 1")
    nodes = links.select(F.col("child").alias("term")).union(links.select("parent")).distinct()
    own = nodes.select("term", F.col("term").alias("ancestor"), F.lit(1.0).alias("weight"))
    steps = links.groupBy(F.col("child").alias("term"), F.col("parent").alias("ancestor")).agg(F.max("weight").cast("double").alias("weight"))
    known = cut_lineage(steps)
    for _ in range(max_doublings):
        further = known.select("term", F.col("ancestor").alias("_m"), F.col("weight").alias("_w")).join(
            known.select(F.col("term").alias("_m"), "ancestor", "weight"), "_m"
        ).select("term", "ancestor", (F.col("_w") * F.col("weight")).alias("weight"))
        longer = cut_lineage(known.unionByName(further).groupBy("term", "ancestor").agg(F.max("weight").alias("weight")))
        if not longer.where("term = ancestor").isEmpty():
            raise ValueError("the links have a cycle")
        grown = longer.join(known.withColumnRenamed("weight", "_before"), ["term", "ancestor"], "left")
        changed = not grown.where("_before IS NULL OR weight > _before").isEmpty()
        known = longer
        if not changed:
            break
    else:
        raise ValueError("paths are longer than the doublings reach")
    return known.unionByName(own)


def term_similarity(weights: DataFrame, terms: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Pairs (a, b, similarity) with a < b whose weighted ancestors agree to ``least`` or more.

    The similarity is the weight of shared ancestors, of both sides, by that of all. One of
    two such terms holds at least ``least`` of its own weight in what they share. So with its
    ancestors ordered from rare to common, they share one before the rest of the list weighs
    less than that; only those heads are joined with whole lists, which leaves out the common
    ancestors that would bring all terms together. ``terms`` (term) restricts both sides.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    rows = weights if terms is None else weights.join(terms.select("term").distinct(), "term")
    common = rows.groupBy("ancestor").agg(F.count("*").alias("_f"))
    order = Window.partitionBy("term").orderBy(F.desc("_f"), F.desc("ancestor"))  # the ancestors of one term
    lists = rows.join(common, "ancestor").withColumn("_upto", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lists = cut_lineage(lists.withColumn("total", F.sum("weight").over(Window.partitionBy("term"))))
    heads = lists.where(F.col("_upto") >= least * F.col("total") - 1e-9).select(F.col("term").alias("x"), "ancestor")
    pairs = heads.join(lists.select(F.col("term").alias("y"), "ancestor"), "ancestor").where("x <> y")
    pairs = cut_lineage(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    side = lambda name, w, t: lists.select(F.col("term").alias(name), "ancestor", F.col("weight").alias(w), F.col("total").alias(t))
    shared = pairs.join(side("a", "_wa", "_ta"), "a").join(side("b", "_wb", "_tb"), ["b", "ancestor"])
    found = shared.groupBy("a", "b").agg(F.sum(F.col("_wa") + F.col("_wb")).alias("_s"), F.max(F.col("_ta") + F.col("_tb")).alias("_t"))
    return found.select("a", "b", (F.col("_s") / F.col("_t")).alias("similarity")).where(F.col("similarity") >= least - 1e-12)
