"""Neighbours, graphs, validity, resampling and control matching against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.functions import tails
from binloom.operators import controls, neighbours, sampling, trees, validity


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def brute(x, k):
    far = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    return [sorted(range(len(x)), key=lambda j: (round(far[i, j], 9), j))[:k] for i in range(len(x))]


def test_neighbours_many_pivots_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_PIVOT", 30)
    monkeypatch.setattr(neighbours, "BLOCK", 25)  # several tasks per cell
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(130, 3)) * 0.2, rng.normal(size=(50, 3)) + 6])
    got = {}
    for r in neighbours.nearest_neighbours(points(spark, x), 7).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    want = brute(x, 7)
    assert len(got) == 180 and all(got[i] == set(want[i]) for i in range(180))


def test_one_product_leaves_few_pairs_and_loses_none():
    rng = np.random.default_rng(3)
    b = rng.normal(size=(900, 16)) + 1000.0  # most digits of the squares cancel
    b[400:420] = b[7]
    a, same = b[:50], np.eye(50, 900, dtype=bool)
    i, j = neighbours._may_be_nearest(a, b, same, 10)
    assert len(i) < 50 * 40
    found, far = set(zip(i.tolist(), j.tolist())), neighbours.gaps(a, b)
    far[same] = np.inf
    limit = np.sort(far, axis=1)[:, 9]
    assert all((r, c) in found for r in range(50) for c in np.flatnonzero(far[r] <= limit[r]))
    b[3, 2] = np.nan
    assert len(neighbours._may_be_nearest(a, b, same, 10)[0]) == 50 * 899


def test_copies_spread_their_neighbours(spark):
    x = np.vstack([np.zeros((200, 2)), np.ones((20, 2))])
    near = neighbours.nearest_neighbours(points(spark, x), 5)
    assert near.filter("src < 200").agg(F.max("distance")).first()[0] == 0.0
    assert near.groupBy("dst").count().agg(F.max("count")).first()[0] < 30
    assert near.count() == 220 * 5


def test_shared_neighbours_and_communities(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(40, 2)) * 0.3 + c for c in ((0, 0), (8, 0), (0, 8))])
    k = 8
    lists = [set(near) | {i} for i, near in enumerate(brute(x, k - 1))]
    near = spark.createDataFrame([(i, j) for i, s in enumerate(lists) for j in s if j != i], "src long, dst long")
    edges = neighbours.shared_neighbours(near, k)
    got = {(r["src"], r["dst"]): r["weight"] for r in edges.collect()}
    want = {}
    for i in range(120):
        for j in range(i + 1, 120):
            s = len(lists[i] & lists[j])
            if s / (2 * k - s) >= 1 / 15:
                want[(i, j)] = s / (2 * k - s)
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)
    labels = neighbours.communities(edges, 0.2).withColumn("block", F.floor(F.col("id") / 40))
    mixed = labels.groupBy("label").agg(F.count_distinct("block").alias("b")).agg(F.max("b")).first()[0]
    assert mixed == 1


def test_swap_labels_only_when_complete(spark):
    df = spark.createDataFrame([(i, i % 7 + 1) for i in range(14)], "id int, cluster int")
    swapped = {r["id"]: r["cluster"] for r in neighbours.swap_labels(df, {4: 5, 5: 4}).collect()}
    assert swapped[3] == 5 and swapped[4] == 4 and swapped[0] == 1
    assert neighbours.swap_labels(df, {4: 5, 9: 4}) is df


def test_modularity_and_mutual_edges(spark):
    near = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)], "src int, dst int")
    edges = validity.mutual_edges(near)
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [(1, 2), (3, 4)]
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id int, label string")
    assert validity.modularity(edges, labels).first()[0] == pytest.approx(0.5)


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert sampling.fixed_sample(df, ["id"], 50).count() == 50
    again = sampling.fixed_sample(df.repartition(7), ["id"], 50)
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in sampling.fixed_sample(df, ["id"], 50).collect())
    assert {r["count"] for r in sampling.stratified_sample(df, ["g"], ["id"], 20).groupBy("g").count().collect()} == {20}
    reps = sampling.replicates(df, ["id"], 4, 0.8).groupBy("rep").count().collect()
    assert len(reps) == 4 and all(700 < r["count"] < 900 for r in reps)


def test_permutation(spark):
    df = spark.createDataFrame([(i, float(i % 2), "ab"[i % 2]) for i in range(60)], "id int, v double, g string")

    def gap(rows):
        side = lambda g: F.avg(F.when(F.col("g") == g, F.col("v")))
        return rows.groupBy("rep").agg(F.abs(side("a") - side("b")).alias("stat"))

    row = sampling.permutation_p(df, ["id"], "v", "g", gap, reps=19).first()
    assert row["observed"] == 1.0 and row["p"] == pytest.approx(1 / 20)


def test_controls_invariants(spark):
    rng = np.random.default_rng(10)
    seq = {c: "".join(rng.choice(list("ACGT"), 6000)) for c in ("c1", "c2")}
    chunks = spark.createDataFrame([(c, i, s[i * 500 : i * 500 + 500]) for c, s in seq.items() for i in range(12)], "chrom string, chunk long, seq string")
    lengths = spark.createDataFrame([(c, 6000) for c in seq], "chrom string, length long")
    targets = spark.createDataFrame([(f"t{i}", "c1", 300 * i, 300 * i + 100) for i in range(8)], "target_id string, chrom string, start long, end long")
    got, left = controls.matched_controls(targets, chunks, lengths, fold=2, rounds=6, chunk=500)
    rows = got.collect()
    assert len(rows) + left.count() == 16 and len(rows) >= 12
    blocked = [("c1", 300 * i, 300 * i + 100) for i in range(8)]
    for r in rows:
        text = seq[r["chrom"]][r["start"] : r["end"]]
        assert 90 <= len(text) <= 110 and r["end"] <= 6000
        assert r["control_gc"] == pytest.approx(sum(b in "GC" for b in text) / len(text))
        assert abs(r["gc_difference"]) <= 0.02 + 1e-12
        for c, s, e in blocked:
            assert c != r["chrom"] or e <= r["start"] or r["end"] <= s
        blocked.append((r["chrom"], r["start"], r["end"]))


def test_controls_gather_no_table_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(12)
    seq = {f"c{i}": "".join(rng.choice(list("ACGT"), 700 + 100 * i)) for i in range(9)}
    chunks = spark.createDataFrame([(c, k, s[500 * k : 500 * k + 500]) for c, s in seq.items() for k in range(-(-len(s) // 500))], "chrom string, chunk long, seq string")
    lengths = spark.createDataFrame([(c, len(s)) for c, s in seq.items()] + [("c0_", 0), ("cn", None)], "chrom string, length long")
    targets = spark.createDataFrame([(c, c, 100, 160) for c in seq], "target_id string, chrom string, start long, end long")
    real, plans = controls.cut_lineage, []

    def noted(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(controls, "cut_lineage", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    got, left = controls.matched_controls(targets, chunks, lengths, fold=1, rounds=2, chunk=500)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (got, left)]
    assert got.count() + left.count() == 9 and len(plans) > 8
    assert not [p for p in plans if "BroadcastExchange" in p]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_places_are_found_in_their_sequences(spark):
    ends = np.cumsum([5, 0, 4090, 9000, 1, 20000, 3])
    offsets = spark.createDataFrame([(f"c{i}", int(e - n), int(e)) for i, (e, n) in enumerate(zip(ends, [5, 0, 4090, 9000, 1, 20000, 3]))], "chrom string, `from` long, `to` long")
    spots = spark.range(int(ends[-1])).withColumnRenamed("id", "spot")
    got = {r["spot"]: r["chrom"] for r in controls.locate(spots, offsets).collect()}
    assert got == {s: f"c{int(np.searchsorted(ends, s, side='right'))}" for s in range(int(ends[-1]))}


def test_clusters_keep_every_row(spark):
    rng = np.random.default_rng(5)
    points = [(k, [1.0, 2.0]) for k in range(600)] + [
        (1000 + k, [float(x) for x in rng.normal(10 * (k % 2), 0.5, 2)]) for k in range(60)
    ]
    points.append((5000, [900.0, 900.0]))
    got = {r.id: r.cluster for r in neighbours.cluster(spark.createDataFrame(points, "id long, vec array<double>"), 10, 0.8).collect()}
    assert set(got) == {k for k, _ in points}
    assert len({got[k] for k in range(600)}) == 1 and got[0] == 1
    assert sorted(set(got.values())) == list(range(1, len(set(got.values())) + 1))


def test_tree_with_cycle_is_an_error(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "src long, dst long, weight double")
    with pytest.raises(ValueError):
        trees.tree_distances(edges, 1)


def test_calinski_harabasz_on_all_rows(spark):
    rng = np.random.default_rng(6)
    label = rng.integers(0, 3, 5000)
    x = rng.normal(label[:, None] * [1.0, 0.5], 1.0)
    rows = [(int(g), float(a), float(b)) for g, (a, b) in zip(label, x)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    scaled = x / (2 * (x.max(0) - x.min(0)))
    squares = lambda v: ((v - v.mean(0)) ** 2).sum()
    inside = sum(squares(scaled[label == g]) for g in range(3))
    want = ((squares(scaled) - inside) / 2) / (inside / (5000 - 3))
    got = validity.calinski_harabasz(df, "g", {"p": ["a"], "q": ["b"]}).first()
    assert (got["n"], got["k"]) == (5000, 3) and got["calinski_harabasz"] == pytest.approx(want)


def test_hypergeometric_support_is_whole():
    for white, black, drawn, keep in ((5, 7, 4, 2), (300, 20, 100, 90), (10**9, 10**9, 10**6, 500_000), (40, 10**7, 30, 30)):
        x, logs = tails.hypergeometric_log_pmf(white, black, drawn, keep)
        assert np.exp(logs).sum() == pytest.approx(1.0) and x[0] <= keep <= x[-1]
        assert (x * np.exp(logs)).sum() == pytest.approx(drawn * white / (white + black))
    draws = sampling.hypergeometric_draws(2 * 10**9, 10**9, 1000, range(200))
    assert abs(draws.mean() - 1000 * 2 / 3) < 5


def test_controls_query_runs_with_the_operators_rounds(spark, monkeypatch):
    import inspect

    from binloom.plans import model_queries

    real, asked = controls.matched_controls, {}

    def noted(*args, **kwargs):
        asked.update(inspect.signature(real).bind(*args, **kwargs).arguments)
        raise InterruptedError

    monkeypatch.setattr(controls, "matched_controls", noted)
    with pytest.raises(InterruptedError):
        model_queries.QUERIES["matched_controls"](spark, "/root/testdata/sf0.001")
    assert not {"rounds", "first_attempts", "max_attempts"} & set(asked)
