"""Ancestor weights and term similarity against plain recursion."""

import random
from functools import cache

import pytest

from binloom.operators.ontology import ancestor_weights, term_similarity


def plain(links):
    """All ancestors of each term with their largest product of weights."""
    up = {}
    for child, parent, weight in links:
        up.setdefault(child, []).append((parent, weight))

    @cache
    def weights(term):
        best = {term: 1.0}
        for parent, weight in up.get(term, []):
            for ancestor, w in weights(parent).items():
                best[ancestor] = max(best.get(ancestor, 0.0), weight * w)
        return best

    return {t: weights(t) for t in {c for c, _, _ in links} | {p for _, p, _ in links}}


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(2)
    links = [(f"t{k:03d}", f"t{rng.randrange(k):03d}", rng.choice((0.8, 0.6))) for k in range(1, 120) for _ in range(rng.randint(1, 3))]
    return links + [(f"c{k}", f"c{k + 1}", 0.9) for k in range(12)]  # a long chain


def test_weights_and_similarity(spark, graph):
    want = plain(graph)
    weights = ancestor_weights(spark.createDataFrame(graph, "child string, parent string, weight double"))
    rows = weights.collect()
    got = {(r["term"], r["ancestor"]): r["weight"] for r in rows}
    assert len(rows) == len(got) and got == pytest.approx({(t, a): w for t, ws in want.items() for a, w in ws.items()})
    for least in (0.5, 0.8):
        pairs = {(r["a"], r["b"]): r["similarity"] for r in term_similarity(weights, least=least).collect()}
        expected = {}
        for a in want:
            for b in want:
                if a < b:
                    both = sum(want[a][t] + want[b][t] for t in want[a].keys() & want[b].keys())
                    s = both / (sum(want[a].values()) + sum(want[b].values()))
                    if s >= least - 1e-12:
                        expected[a, b] = s
        assert pairs == pytest.approx(expected)
    some = spark.createDataFrame([("t005",), ("t006",), ("t007",), ("t005",)], "term string")
    few = term_similarity(weights, some, 0.1).collect()
    assert few and all({r["a"], r["b"]} <= {"t005", "t006", "t007"} for r in few)


def test_errors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "child string, parent string, weight double")
    for rows in ([("a", "b", 0.5), ("b", "c", 0.5), ("c", "a", 0.5)], [("a", "b", 1.0)], [("a", None, 0.5)], [("a", "a", 0.5)]):
        with pytest.raises(ValueError):
            ancestor_weights(frame(rows))
    with pytest.raises(ValueError):
        term_similarity(frame([("a", "b", 0.5)]), least=0.0)
    assert ancestor_weights(frame([]).limit(0)).count() == 0
