"""Density curves and surfaces against the direct sum over rows."""

import numpy as np
import pytest

from binloom.operators.density import bandwidths, density_curve, density_surface


def rule(v, factor=0.9):
    q1, q3 = np.quantile(v, [0.25, 0.75])
    return factor * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2


def direct(v, grid, bw):
    return np.exp(-(((grid[:, None] - v) / bw) ** 2) / 2).sum(1) / (len(v) * bw * np.sqrt(2 * np.pi))


def test_curves(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.normal(size=300), "b": np.concatenate([rng.normal(5, 0.3, 80), rng.normal(9, 2, 50)])}
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("a", None), ("a", float("nan")), ("c", None)]
    table = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: r for r in bandwidths(table, ["g"], "v").collect()}
    assert set(found) == {"a", "b"} and all(found[k]["bw"] == pytest.approx(rule(v)) and found[k]["n"] == len(v) for k, v in data.items())
    got = density_curve(table, ["g"], "v", points=256).orderBy("g", "at").collect()
    for k, v in data.items():
        mine = [r for r in got if r["g"] == k]
        x, y = np.array([r["x"] for r in mine]), np.array([r["density"] for r in mine])
        assert [r["at"] for r in mine] == list(range(256))
        assert x[0] == pytest.approx(v.min() - 3 * rule(v)) and x[-1] == pytest.approx(v.max() + 3 * rule(v))
        want = direct(v, x, rule(v))
        assert np.abs(y - want).max() < 0.01 * want.max()
        assert np.trapezoid(y, x) == pytest.approx(1.0, abs=0.01)


def test_constant_and_empty(spark):
    table = spark.createDataFrame([("a", 2.0)] * 5 + [("z", 0.0)], "g string, v double")
    found = {r["g"]: r["bw"] for r in bandwidths(table, ["g"], "v").collect()}
    assert found == {"a": pytest.approx(0.9 * 2.0 * 5**-0.2), "z": pytest.approx(0.9)}
    assert density_curve(table.limit(0), ["g"], "v").count() == 0
    assert density_curve(table, ["g"], "v", points=32).count() == 64
    assert density_surface(table.limit(0), "v", "v").count() == 0


def test_surface(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = 0.6 * x + rng.normal(size=400)
    table = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {(r["i"], r["j"]): (r["x"], r["y"], r["density"]) for r in density_surface(table, "x", "y", 48).collect()}
    assert len(got) == 48 * 48
    hx, hy = rule(x, 1.06), rule(y, 1.06)
    want = {}
    for k, (a, b, _) in got.items():
        want[k] = (np.exp(-(((a - x) / hx) ** 2 + ((b - y) / hy) ** 2) / 2)).sum() / (400 * 2 * np.pi * hx * hy)
    top = max(want.values())
    assert max(abs(got[k][2] - want[k]) for k in got) < 0.03 * top
    assert got[0, 0][0] == pytest.approx(x.min()) and got[47, 47][1] == pytest.approx(y.max())
