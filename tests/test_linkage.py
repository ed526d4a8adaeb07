"""Average linkage in rounds against the step-by-step procedure."""

import itertools

import numpy as np
import pytest

from binloom.operators.linkage import average_linkage


def stepwise(names, similar, cut):
    """Merges, groups and leaf orders, one merge at a time."""
    members = {n: [n] for n in names}
    merges = []
    while True:
        best = None
        for a, b in itertools.combinations(sorted(members), 2):
            s = round(sum(similar.get((min(x, y), max(x, y)), 0.0) for x in members[a] for y in members[b]) / (len(members[a]) * len(members[b])), 12)
            if s > 0 and (best is None or (-s, a, b) < best):
                best = (-s, a, b)
        if best is None or -best[0] < cut - 1e-12:
            return merges, members
        _, a, b = best
        merges.append((a, b, -best[0], len(members[a]) + len(members[b])))
        members[a] = members[a] + members.pop(b)


@pytest.mark.parametrize("cut", [0.05, 0.3])
def test_equals_stepwise(spark, cut):
    rng = np.random.default_rng(4)
    names = [f"t{k:02d}" for k in range(22)]
    similar = {(a, b): float(rng.random()) for a, b in itertools.combinations(names, 2) if rng.random() < 0.35}
    rows = [(a, b, s) if k % 2 else (b, a, s) for k, ((a, b), s) in enumerate(similar.items())] + [("t00", "t00", 1.0), ("t01", "none", 0.9)]
    table = spark.createDataFrame(rows, "a string, b string, similarity double")
    merges, groups = average_linkage(table, spark.createDataFrame([(n,) for n in names], "term string"), cut)
    want, members = stepwise(names, similar, cut)
    got = sorted((r["left"], r["right"], round(r["similarity"], 9), r["size"]) for r in merges.collect())
    assert got == sorted((a, b, round(s, 9), n) for a, b, s, n in want)
    places = {r["term"]: (r["group"], r["place"]) for r in groups.collect()}
    assert places == {n: (g, k) for g, held in members.items() for k, n in enumerate(held)}


def test_ties_and_lone_terms(spark):
    rows = [(a, b, 0.8) for a, b in itertools.combinations("abcd", 2)]
    table = spark.createDataFrame(rows, "a string, b string, similarity double")
    terms = spark.createDataFrame([(t,) for t in "abcdx"], "term string")
    merges, groups = average_linkage(table, terms, 0.5)
    assert {r["similarity"] for r in merges.collect()} == {0.8} and merges.count() == 3
    assert {(r["term"], r["group"]) for r in groups.collect()} == {*((t, "a") for t in "abcd"), ("x", "x")}
    assert average_linkage(table, terms.limit(0), 0.5)[1].count() == 0
    with pytest.raises(ValueError):
        average_linkage(table, terms, 0.0)
