"""Average-linkage grouping of terms on sparse similarities, by reciprocal nearest pairs.

The similarity of two groups is the sum over their pairs of members by the number of pairs;
a pair that is not listed adds nothing. Two groups that are each other's nearest will be merged
by the step-by-step procedure too, before either meets another group, so all such pairs merge
in one round. A round is a grouped maximum, a join and a grouped sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.session import cut_lineage


def average_linkage(similarities: DataFrame, terms: DataFrame, cut: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Merges (left, right, similarity, size) and groups (term, group, place) of an average linkage.

    ``similarities`` has (a, b, similarity), each pair once in either order, and ``terms`` (term) all
    terms. Merging goes on while two groups are at least ``cut`` similar, which must be above 0.
    A group is named after its least term; ``left`` is the lesser name and names the merged group.
    ``place`` is the place of a term among the leaves of its group's tree, from 0: members of
    ``left`` come before those of ``right``.
    Equal similarities go by name. Pairs of a term with itself and unknown terms are left out.
    """
    if not 0 < cut <= 1:
        raise ValueError("cut must be in (0, 1]")
    known = terms.select("term").distinct()
    groups = cut_lineage(known.select("term", F.col("term").alias("group"), F.lit(0).cast("long").alias("place")))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    pairs = similarities.where("a <> b AND similarity > 0").groupBy(low.alias("a"), high.alias("b")).agg(F.max("similarity").cast("double").alias("s"))
    pairs = pairs.join(known.withColumnRenamed("term", "a"), "a", "left_semi").join(known.withColumnRenamed("term", "b"), "b", "left_semi")
    pairs = cut_lineage(pairs.select("a", "b", "s", F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    merges = [pairs.select(F.col("a").alias("left"), F.col("b").alias("right"), F.lit(0.0).alias("similarity"), F.col("na").alias("size")).limit(0)]
    while True:
        near = pairs.withColumn("_s", F.round(F.col("s") / (F.col("na") * F.col("nb")), 12))
        sides = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "_s").unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("y"), "_s"))
        # Of equally near groups the pair of least names comes first, seen from both sides alike.
        order = F.struct(-F.col("_s"), F.least("x", "y"), F.greatest("x", "y"))
        best = sides.groupBy("x").agg(F.min_by("y", order).alias("y"))
        other = best.select(F.col("x").alias("y"), F.col("y").alias("_back"))
        both = best.join(other, "y").where("_back = x AND x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = cut_lineage(near.join(both, ["a", "b"]).where(F.col("_s") >= cut - 1e-12).select("a", "b", "_s", "na", (F.col("na") + F.col("nb")).alias("_n")))
        if joined.isEmpty():
            break
        merges.append(joined.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("_s").alias("similarity"), F.col("_n").alias("size")))
        named = joined.select(F.col("b").alias("_old"), F.col("a").alias("_new"), F.col("na").alias("_before"))
        sizes = joined.select(F.col("a").alias("_g"), "_n")
        groups = cut_lineage(
            groups.join(named.withColumnRenamed("_old", "group"), "group", "left").select(
                "term", F.coalesce("_new", "group").alias("group"), (F.col("place") + F.coalesce("_before", F.lit(0))).alias("place")
            )
        )

        def renamed(rows: DataFrame, side: str) -> DataFrame:
            rows = rows.join(named.select(F.col("_old").alias(side), F.col("_new").alias("_to")), side, "left")  # noqa: B023
            rows = rows.withColumn(side, F.coalesce("_to", side)).drop("_to")
            rows = rows.join(sizes.select(F.col("_g").alias(side), F.col("_n").alias("_m")), side, "left")  # noqa: B023
            return rows.withColumn(f"n{side}", F.coalesce("_m", f"n{side}")).drop("_m")

        moved = renamed(renamed(pairs, "a"), "b").where("a <> b")
        ends = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "na", "nb")).otherwise(
            F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb"))
        )
        moved = moved.select("s", ends.alias("_e")).select("_e.*", "s")
        pairs = cut_lineage(moved.groupBy("a", "b", "na", "nb").agg(F.sum("s").alias("s")))
    out = merges[0]
    for more in merges[1:]:
        out = out.unionByName(more)
    return out, groups
