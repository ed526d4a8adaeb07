"""Spanning forests against Kruskal's loop, and a tree through rows of known shape."""

import numpy as np
import pytest

from binloom.operators import neighbours, spanning, trees


def kruskal(edges):
    """Edges of the least forest; equal weights go by their ends."""
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    out = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if w is not None and a != b):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.append((a, b, w))
    return sorted(out)


def test_forest_equals_kruskal(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 250), rng.integers(0, 60, 250), rng.integers(0, 12, 250))]
    edges += [(100, 101, 1.0), (101, 100, 0.5), (102, 102, 1.0), (103, 104, None)]  # parallel, loop, unknown
    table = spark.createDataFrame(edges, "src long, dst long, weight double")
    assert sorted(map(tuple, spanning.spanning_forest(table).collect())) == kruskal(edges)
    assert spanning.spanning_forest(table.limit(0)).count() == 0


def test_tree_of_a_fork(spark):
    """Three arms from one point: the tree has their ends as leaves, and time runs along an arm."""
    rng = np.random.default_rng(1)
    arms = np.array([[1.0, 0.0], [-0.5, 0.87], [-0.5, -0.87]])
    far = rng.uniform(0, 10, 900)
    x = arms[np.arange(900) % 3] * far[:, None] + rng.normal(0, 0.15, (900, 2))
    points = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, vec array<double>")
    edges, nodes = spanning.principal_tree(points, centres=20, stiffness=0.05, rounds=3)
    assert edges.count() == nodes.count() - 1 == 19
    place = np.array([r["vec"] for r in nodes.orderBy("node").collect()])
    square = ((place[:, None] - place[None]) ** 2).sum(-1)
    every = [(i, j, float(square[i, j])) for i in range(20) for j in range(i)]
    got = sorted((r["src"], r["dst"]) for r in edges.collect())
    assert got == [e[:2] for e in kruskal(every)]
    assert sum(r["weight"] for r in edges.collect()) == pytest.approx(sum(e[2] ** 0.5 for e in kruskal(every)))
    root = trees.root_leaf(edges, nodes.select("node", nodes["vec"][0].alias("x")))
    assert place[root][0] > 7
    timed = trees.pseudotime(neighbours.nearest_centre(points, nodes), trees.tree_distances(edges, root)).collect()
    assert len(timed) == 900 and min(r["pseudotime"] for r in timed) == 0.0 and max(r["pseudotime"] for r in timed) == 1.0
    order = np.array([r["pseudotime"] for r in sorted(timed, key=lambda r: r["id"])])
    along = np.where(np.arange(900) % 3 == 0, -far, far)
    assert np.corrcoef(order, along)[0, 1] > 0.95


def test_bad_trees(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [0.0])], "id long, vec array<double>")
    for k in (1, spanning.MAX_CENTRES + 1, 2):  # too few, too many, all rows equal
        with pytest.raises(ValueError):
            spanning.principal_tree(points, centres=k)
