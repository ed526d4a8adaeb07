"""Negative-binomial fits against brute-force maxima; sampling draws twice in one session."""

import math

import numpy as np
import pytest

from binloom.functions import negbin
from binloom.operators import counts, sampling

LEVELS = ("d0", "d7", "d15")
X = counts.Design(tuple(range(9)), tuple(LEVELS[k // 3] for k in range(9)), LEVELS).matrix


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(2)
    factors = rng.uniform(0.5, 2.0, (40, 9))
    mu = rng.lognormal(2.5, 1.0, (40, 1)) * np.exp(rng.normal(0, 0.7, (40, 3))).repeat(3, 1) * factors
    alpha = rng.uniform(0.02, 0.8, 40)
    y = rng.negative_binomial(1 / alpha[:, None], 1 / (1 + alpha[:, None] * mu)).astype(float)
    y[0, :3] = 0.0  # a level without counts
    y[1] = np.arange(9) * 200  # far from any trend
    return y, factors, alpha


def plain_likelihood(y, mu, alpha):
    r = 1.0 / alpha
    return sum(
        math.lgamma(r + v) - math.lgamma(r) + (v * math.log(m / (m + r)) if v else 0.0) - r * math.log1p(m / r) for v, m in zip(y, mu)
    )


def best_levels(y, factors, alpha):
    """Each level's mean at the maximum, by ternary search."""
    found = []
    for k in range(3):
        part, scale = y[3 * k : 3 * k + 3], factors[3 * k : 3 * k + 3]
        low, high = -25.0, 15.0
        for _ in range(150):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            left, right = (plain_likelihood(part, scale * math.exp(e), alpha) for e in (a, b))
            low, high = (a, high) if left < right else (low, b)
        found.append((low + high) / 2)
    return found


def plain_profile(y, factors, alpha):
    eta = np.repeat(best_levels(y, factors, alpha), 3)
    mu = factors * np.exp(eta)
    information = X.T @ (X * (mu / (1 + alpha * mu))[:, None])
    return plain_likelihood(y, mu, alpha) - 0.5 * math.log(np.linalg.det(information))


def counted(y):
    """Features with counts in every level."""
    return np.flatnonzero(y.reshape(len(y), 3, 3).sum(axis=2).min(axis=1) > 0)


def test_special_functions():
    x = np.array([1e-9, 1e-3, 0.5, 1.0, 7.99, 8.0, 30.0, 1e6])
    want = np.array([math.lgamma(v) for v in x])
    assert np.allclose(negbin.log_gamma(x), want, rtol=1e-12, atol=1e-11)
    assert negbin.trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-10)
    assert negbin.trigamma(3.0) == pytest.approx(math.pi**2 / 6 - 1.25, rel=1e-10)
    r, y = np.array([1e8, 0.3, 20.0]), np.array([3.0, 5.0, 0.0])
    exact = [sum(math.log(a + k) for k in range(int(b))) for a, b in zip(r, y)]
    assert np.allclose(negbin.log_rising(r, y), exact, rtol=1e-12, atol=1e-9)


def test_means_are_the_maximum(drawn):
    y, factors, alpha = drawn
    beta, _ = negbin.fit_means(y, factors, X, alpha)
    for g in counted(y):
        want = best_levels(y[g], factors[g], alpha[g])
        assert np.allclose([beta[g, 0], beta[g, 0] + beta[g, 1], beta[g, 0] + beta[g, 2]], want, atol=1e-4)
    assert beta[0, 0] < -8 and np.isfinite(beta).all()


def test_dispersions_are_the_maximum(drawn):
    y, factors, _ = drawn
    found = negbin.fit_dispersions(y, factors, X)
    for g in counted(y)[:20]:
        places = np.exp(np.linspace(math.log(negbin.MIN_DISPERSION), math.log(10.0), 120))
        best = max(plain_profile(y[g], factors[g], a) for a in places)
        assert plain_profile(y[g], factors[g], found[g]) > best - 1e-5
    shrunk = negbin.fit_dispersions(y, factors, X, np.full(len(y), math.log(0.1)), 0.25)
    for g in counted(y)[:8]:
        score = lambda a: plain_profile(y[g], factors[g], a) - (math.log(a) - math.log(0.1)) ** 2 / 0.5  # noqa: B023, E731
        assert score(shrunk[g]) > max(score(a) for a in np.exp(np.linspace(-7, 2.3, 120))) - 1e-5


@pytest.fixture(scope="module")
def planted(spark):
    """600 features: the first 60 up fourfold in d15, the next 60 down, one silent."""
    rng = np.random.default_rng(5)
    size = np.array([0.7, 1.0, 1.3] * 3)
    rows = []
    for g in range(600):
        mean = rng.lognormal(5.0, 1.0)
        fold = 4.0 if g < 60 else 0.25 if g < 120 else 1.0
        mu = mean * size * np.where(np.arange(9) >= 6, fold, 1.0)
        a = 0.02 + 2.0 / mean
        y = rng.negative_binomial(1 / a, 1 / (1 + a * mu)) if g < 599 else np.zeros(9, int)
        rows += [(f"g{g}", f"s{k}", int(v), 100.0 + g) for k, v in enumerate(y)]
    design = spark.createDataFrame([(f"s{k}", LEVELS[k // 3]) for k in range(9)], "sample string, condition string")
    return spark.createDataFrame(rows, "feature string, sample string, n long, size double"), design


def test_planted_changes(planted):
    table, design = planted
    got = counts.differential_counts(table, design, LEVELS, [("d15", "d0"), ("d7", "d0")]).collect()
    assert len(got) == 1200
    late = {r["feature"]: r for r in got if r["contrast"] == "d15 vs d0"}
    early = [r["change"] for r in got if r["contrast"] == "d7 vs d0"]
    up = [late[f"g{g}"] for g in range(60)]
    down = [late[f"g{g}"] for g in range(60, 120)]
    assert sum(r["change"] == "Up" for r in up) >= 57 and sum(r["change"] == "Down" for r in down) >= 57
    assert abs(np.median([r["log2_fold_change"] for r in up]) - 2.0) < 0.25
    assert sum(late[f"g{g}"]["change"] != "NotSig" for g in range(120, 599)) <= 15
    assert sum(c in ("Up", "Down") for c in early) <= 5
    silent = late["g599"]
    assert silent["base_mean"] == 0.0 and silent["p"] is None and silent["change"] is None
    for r in up[:5]:
        assert r["p"] == pytest.approx(math.erfc(abs(r["stat"]) / math.sqrt(2)), rel=1e-9)
        assert r["stat"] == pytest.approx(r["log2_fold_change"] / r["lfc_se"])


def test_trend_equals_gamma_model(planted):
    table, design = planted
    known = counts.read_design(design, LEVELS)
    packed = counts.packed_counts(table, known)
    own = counts.gene_dispersions(counts.normalised(packed, known, counts.size_factors(packed, known)), known)
    rows = own.select("base_mean", "dispersion_own").cache()
    a, b = counts.dispersion_trend(rows)
    data = np.array([tuple(r) for r in rows.collect()])
    mean, y = data[data[:, 1] > 1e-6].T
    p = np.array([0.1, 1.0])
    for _ in range(60):  # the same rule on local arrays
        ratio = y / (p[0] + p[1] / mean)
        keep = (ratio > 1e-4) & (ratio < 15)
        design_matrix = np.column_stack([np.ones(keep.sum()), 1 / mean[keep]])
        for _ in range(60):
            w = 1 / (design_matrix @ p) ** 2
            p = np.linalg.solve(design_matrix.T @ (design_matrix * w[:, None]), design_matrix.T @ (w * y[keep]))
    assert (a, b) == pytest.approx(tuple(p), rel=1e-4)
    assert counts.dispersion_trend(rows.limit(0)) == (negbin.MIN_DISPERSION, 0.0)
    flat = rows.select("base_mean", (0.1 + rows["base_mean"] / 1e6).alias("dispersion_own"))
    level, slope = counts.dispersion_trend(flat)
    assert slope == 0.0 and level == pytest.approx(float(np.mean(0.1 + data[:, 0] / 1e6)))


def test_packing_and_lengths(spark):
    design = spark.createDataFrame([("b", "t"), ("a", "t"), ("c", "u")], "sample string, condition string")
    known = counts.read_design(design, ("t", "u"))
    assert known.samples == ("a", "b", "c") and known.of_sample == ("t", "t", "u")
    rows = [("f", "a", 2, 10.0), ("f", "a", 3, 30.0), ("f", "c", 8, -1.0), ("f", "other", 9, 1.0), ("g", "b", 1, float("nan"))]
    table = spark.createDataFrame(rows, "feature string, sample string, n long, len double")
    got = {r["feature"]: (list(r["counts"]), list(r["lengths"])) for r in counts.packed_counts(table, known, length="len").collect()}
    assert got == {"f": ([5.0, 0.0, 8.0], [20.0, 1.0, 1.0]), "g": ([0.0, 1.0, 0.0], [1.0, 1.0, 1.0])}
    whole = spark.createDataFrame([("f", s, n, w) for s, n, w in (("a", 4, 1.0), ("b", 8, 2.0), ("c", 2, 0.5))], "feature string, sample string, n long, len double")
    packed = counts.packed_counts(whole, known, length="len")
    sizes = counts.size_factors(packed, known)  # counts follow lengths: nothing is left
    assert all(v == pytest.approx(sizes["a"]) for v in sizes.values())
    row = counts.normalised(packed, known, sizes).head()
    assert np.prod(row["factors"]) == pytest.approx(1.0)
    assert np.array(row["counts"]) / np.array(row["factors"]) == pytest.approx([4.0] * 3)


def test_errors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "sample string, condition string")
    for rows in ([("a", "t"), ("a", "u"), ("b", "t")], [("a", "t"), ("b", "t"), ("c", "v")], [("a", "t"), ("b", "t")], [("a", "t"), ("b", "u")]):
        with pytest.raises(ValueError):
            counts.read_design(frame(rows), ("t", "u"))
    known = counts.read_design(frame([("a", "t"), ("b", "t"), ("c", "u")]), ("t", "u"))
    table = spark.createDataFrame([("f", "a", 1)], "feature string, sample string, n long")
    with pytest.raises(ValueError):
        counts.size_factors(counts.packed_counts(table, known), known)


def test_odds_ratio_intervals_twice(spark):
    rows = [("x", int(k % 3 == 0)) for k in range(90)] + [("y", int(k % 2)) for k in range(60)]
    table = spark.createDataFrame(rows, "side string, flag int")
    first, second = (sampling.odds_ratio_intervals(table, "side", "flag", {"x": 40, "y": 40}, 60).collect() for _ in range(2))
    assert first == second and 0 < first[0]["low"] <= first[0]["median"] <= first[0]["high"]
