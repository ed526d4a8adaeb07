"""The whole chain on a small planted genome."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from binloom.operators import sensitivity, trees
from binloom.params import DEFAULTS, MARKS, STAGES
from binloom.plans import chain


def planted(spark):
    rng = random.Random(6)
    rows = []
    for chrom in ("chr1", "chr2"):
        for stage in STAGES:
            for b in range(600):
                inside = (b // 12) % 3 == 0
                kind = (b // 36) % 2
                flags = [int(rng.random() < (0.7 if inside and (m % 2 == kind) else 0.1)) for m in range(len(MARKS))]
                flags[2] = int(inside and rng.random() < 0.97)
                rows.append((chrom, b, stage, *flags))
    return spark.createDataFrame(rows, "chrom string, bin long, stage string, " + ", ".join(f"{m} int" for m in MARKS))


def test_chain(spark):
    params = replace(DEFAULTS, knn_k=8, main_len=5)
    made = chain.run_features(planted(spark), params=params)
    rois = made.rois.collect()
    assert 20 < len(rois) and all(r["end"] > r["start"] for r in rois)
    assert made.raw.count() == made.standard.count() == len({r["roi"] for r in rois})
    row = made.standard.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in made.standard.columns]).first()
    assert not any(row)
    labelled = chain.run_clustering(made, params)
    assert labelled.count() == len(rois) and labelled.filter("cluster is null").count() == 0


def test_grid_and_tree(spark):
    assert len(sensitivity.grid()) == 75
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (2, 4, 5.0)], "src long, dst long, weight double")
    place = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 9.0), (4, 3.0)], "node long, x double")
    assert trees.root_leaf(edges, place) == 3
    far = {r["node"]: r["distance"] for r in trees.tree_distances(edges, 3).collect()}
    assert far == {3: 0.0, 2: 2.0, 1: 3.0, 4: 7.0}
    got = trees.pseudotime(place.select(F.col("node").alias("id"), "node"), trees.tree_distances(edges, 3))
    assert {r["id"]: round(r["pseudotime"], 6) for r in got.collect()} == {3: 0.0, 2: 0.285714, 1: 0.428571, 4: 1.0}
