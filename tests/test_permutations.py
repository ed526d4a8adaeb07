"""Keyed permutations, and permutation p-values against plain loops over the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.operators.permutations import (
    moved_places,
    numbered,
    permutation_statistic,
    permuted_features,
    permuted_labels,
)

SEED = 518


def test_places_are_a_permutation():
    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        for key in (0, -7, 12345678901):
            got = moved_places(np.arange(n), np.full(n, key), n)
            assert sorted(got.tolist()) == list(range(n))
    many = np.array([moved_places(np.arange(6), np.full(6, key), 6) for key in range(6000)])
    for place in range(6):  # every place is about as likely for every row
        assert np.abs(np.bincount(many[:, place], minlength=6) - 1000).max() < 130
    pairs = np.bincount(many[:, 0] * 6 + many[:, 1], minlength=36).reshape(6, 6)
    assert np.abs(pairs[~np.eye(6, dtype=bool)] - 200).max() < 70


def test_numbered(spark):
    rows, n = numbered(spark.range(0, 1000, 1, 7).selectExpr("(id * 37) % 1000 AS v"), ["v"])
    assert n == 1000 and rows.where("v <> place").count() == 0
    rows, n = numbered(spark.range(0).withColumn("v", F.lit(1)))
    assert n == 0 and rows.count() == 0


def test_labels_and_features(spark):
    data = [(k, float(k), float(k * k), "abc"[k % 3] if k % 5 else None) for k in range(100)]
    rows, n = numbered(spark.createDataFrame(data, "id long, x double, y double, g string"), ["id"])
    got = permuted_features(rows, n, ["x", "y"], 2).collect()
    for rep in (1, 2):
        x = moved_places(np.arange(n), np.full(n, (rep + SEED * 1_000_003) * 3 + 1), n)
        y = moved_places(np.arange(n), np.full(n, (rep + SEED * 1_000_003) * 3 + 2), n)
        mine = {r["place"]: (r["x"], r["y"]) for r in got if r["rep"] == rep}
        assert len(mine) == n
        assert all(mine[x[k]][0] == float(k) for k in range(n)) and all(mine[y[k]][1] == float(k * k) for k in range(n))
    with pytest.raises(ValueError):
        permutation_statistic(rows, ["x"], None, None, permute="columns")


def test_label_counts_stay(spark):
    data = [(k, "abc"[k % 3]) for k in range(90)]
    rows, n = numbered(spark.createDataFrame(data, "id long, g string"), ["id"])
    got = permuted_labels(rows, n, "g", 3).collect()
    for rep in (1, 2, 3):
        mine = [r["g"] for r in got if r["rep"] == rep]
        assert len(mine) == 90 and all(mine.count(g) == 30 for g in "abc")


def test_statistic_equals_loop(spark):
    """Clusters by the sign of x; the statistic is the gap between their means of y."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=80)
    y = np.where(x > 0, 0.25, -0.25) + rng.normal(size=80)
    table = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").coalesce(1)
    cluster = lambda rows: rows.withColumn("label", F.when(F.col("x") > 0, "p").otherwise("m"))

    def gap(rows):
        side = lambda g: F.avg(F.when(F.col("label") == g, F.col("y")))
        return rows.groupBy("rep").agg((side("p") - side("m")).alias("stat"))

    reps, base = 40, SEED * 1_000_003
    plain = lambda a, b: b[a > 0].mean() - b[a <= 0].mean()
    seen = plain(x, y)
    place = lambda key: moved_places(np.arange(80), np.full(80, key), 80)
    features, labels = [], []
    ordered = np.sort(np.where(x > 0, 1, -1))  # labels m then p
    for rep in range(1, reps + 1):
        a, b = np.empty(80), np.empty(80)
        a[place((rep + base) * 3 + 1)], b[place((rep + base) * 3 + 2)] = x, y
        features.append(plain(a, b))
        labels.append(plain(ordered[place(rep + base)], y))
    for mode, null in (("features", np.array(features)), ("labels", np.array(labels)), ("rows", np.full(reps, seen))):
        for kind in ("greater", "two.sided"):
            row = permutation_statistic(table, ["x", "y"], gap, cluster, mode, reps, kind).first()
            assert row["observed"] == pytest.approx(seen)
            if mode != "rows":  # whole rows: all replicates are the observed one up to rounding
                beyond = null >= seen if kind == "greater" else np.abs(null - null.mean()) >= abs(seen - null.mean())
                assert row["p"] == pytest.approx((beyond.sum() + 1) / (reps + 1))


def test_permuted_cells_travel_bare(spark):
    """A cell is shuffled as its place and value, not as a row of the whole width; nothing is lost."""
    rows = spark.createDataFrame([(i, i * 1.0, None if i == 3 else i * 10.0) for i in range(50)], "place long, a double, b double")
    made = permuted_features(rows, 50, ["a", "b"], 3)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    got = made.collect()
    assert made.dtypes == [("rep", "int"), ("place", "bigint"), ("a", "double"), ("b", "double")]
    for rep in (1, 2, 3):
        mine = [r for r in got if r["rep"] == rep]
        assert sorted(r["place"] for r in mine) == list(range(50))
        assert sorted(r["a"] for r in mine) == [i * 1.0 for i in range(50)]
        assert sorted(-1.0 if r["b"] is None else r["b"] for r in mine) == sorted(-1.0 if i == 3 else i * 10.0 for i in range(50))
