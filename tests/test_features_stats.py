"""Feature, standardisation, rank and test fixtures."""

import math

import numpy as np
import pytest

from binloom.functions import tails
from binloom.operators import burden, features, mfa, qc, ranks, stitch, validity


def masks(spark, **tracks):
    """Region masks of one region from lists of bins per mark_stage."""
    size = len(next(iter(tracks.values())))
    cells = {k: sum(v << i for i, v in enumerate(vec)) for k, vec in tracks.items()}
    return spark.createDataFrame([("r", size, *cells.values())], "roi string, n_bins long, " + ", ".join(f"{k} long" for k in cells))


def test_feature_count():
    names = features.feature_names()
    assert len(names) == 299 and len(set(names)) == 299


def test_single_track(spark):
    def stats(vec):
        df = masks(spark, **{f"{m}_{s}": vec for m in ("A", "B") for s in ("d0", "d7", "d15")})
        row = features.features_from_masks(df, marks=("A", "B")).first()
        return [row[f"A_d0_{n}"] for n in features.SPATIAL]

    assert stats([1, 1, 0, 1]) == pytest.approx([0.75, 2, 2, 7 / 3 / 4, 2 / 3])
    assert stats([0, 0, 0]) == [0.0, 0.0, 0.0, None, 0.0]
    assert stats([1]) == [1.0, 1.0, 1.0, 1.0, None]


def test_patterns_jaccard_concordance(spark):
    df = masks(
        spark, A_d0=[1, 0], A_d7=[1, 1], A_d15=[1, 0], B_d0=[0, 0], B_d7=[0, 0], B_d15=[0, 0]
    )
    row = features.features_from_masks(df, marks=("A", "B")).first()
    assert row["A_pattern_111"] == 0.5
    assert sum(row[f"A_pattern_{p}"] for p in ("000", "111", "001", "110", "011", "100")) == 0.5
    assert row["A_delta_cov_d7_d0"] == 0.5 and row["A_delta_cov_d15_d7"] == -0.5
    assert row["A_vs_B_d0_jaccard"] == 0.0 and row["HDC_A_vs_B_cos"] == 0.0
    tri = masks(spark, A_d0=[1, 1, 0], A_d7=[0, 0, 0], A_d15=[0] * 3, B_d0=[0, 1, 1], B_d7=[0] * 3, B_d15=[0] * 3)
    row = features.features_from_masks(tri, marks=("A", "B")).first()
    assert row["A_vs_B_d0_jaccard"] == pytest.approx(1 / 3)
    assert row["A_vs_B_d7_jaccard"] is None and row["HDC_A_vs_B_cos"] == pytest.approx(1.0)


def test_region_wider_than_mask_raises(spark):
    bins = spark.createDataFrame([("a", 0, "d0", 1)], "chrom string, bin long, stage string, m int")
    words = stitch.pack_bins(bins, ("m",), ("d0",))
    wide = spark.createDataFrame([("r", "a", 0, 200 * 63)], "roi string, chrom string, start long, end long")
    with pytest.raises(Exception, match="62 bins"):
        features.region_masks(wide, words, marks=("m",), stages=("d0",)).collect()


def test_missing_value_rules(spark):
    data = [(i, None if i == 0 else float(i), None if i < 10 else float(i), None if i % 2 else 0.5) for i in range(20)]
    df = spark.createDataFrame(data, "roi int, few double, many double, x_jaccard double")
    out = qc.impute_missing(df, ["few", "many", "x_jaccard"])
    assert out.columns == ["roi", "few", "many", "x_jaccard", "many_wasNA"]
    row = out.filter("roi = 0").first()
    assert (row["few"], row["many"], row["many_wasNA"]) == (10.0, 14.5, 1)
    assert out.filter("roi = 1").first()["x_jaccard"] == 0.0


def test_pruning_rules(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    cols = {"x": x * 0.5, "y": x + rng.normal(size=300) * 0.05, "same": x * 1.0, "twice": x * 2.0, "flat": x * 0}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols.values())], ", ".join(f"{c} double" for c in cols))
    constant, dropped = qc.redundant_columns(df, list(cols))
    assert constant == ["flat"]
    assert "x" in dropped and "twice" not in dropped


def test_rank_scores(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 2.0), (3, 2.0), (4, 5.0)], "roi int, v double")
    out = {r["roi"]: r["v"] for r in qc.rank_scores(df, {"g": ["v"]}).collect()}
    assert out == {0: 0.0, 1: -1.0, 2: 0.5, 3: 0.5, 4: 1.0}


@pytest.mark.parametrize("method,want", [("BH", [0.03, 0.04, 0.04]), ("holm", [0.03, 0.06, 0.06])])
def test_adjust(spark, method, want):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03)], "i int, p double")
    got = ranks.adjust_p(df, [], "p", method).orderBy("i").select("p_adjusted").collect()
    assert [r[0] for r in got] == pytest.approx(want)


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9)], "v double")
    assert ranks.quantile_table(df, [], "v", {"q": 0.25}).first()["q"] == 1.75


def test_tails():
    assert tails.student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.student_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert tails.chi2_upper(5.991464547, 2) == pytest.approx(0.05, abs=1e-8)
    p, odds, low, high = tails.fisher_2x2(3, 1, 1, 3)
    assert p == pytest.approx(0.4857142857)
    assert odds == pytest.approx(6.408309, abs=1e-4)
    # by definition of the two-sided 95 % limits each tail holds 2.5 % at its limit
    mass = lambda odds: [math.comb(4, k) * math.comb(4, 4 - k) * odds**k for k in range(5)]
    assert sum(mass(low)[3:]) / sum(mass(low)) == pytest.approx(0.025)
    assert sum(mass(high)[:4]) / sum(mass(high)) == pytest.approx(0.025)
    x, logs = tails.hypergeometric_log_pmf(5, 10, 6, 2)
    want = [math.comb(5, int(k)) * math.comb(10, 6 - int(k)) / math.comb(15, 6) for k in x]
    assert np.exp(logs) == pytest.approx(want)


def test_burden(spark):
    links = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c"), ("g", "a")], "gene_id string, roi string")
    deltas = spark.createDataFrame([("a", 0.4), ("b", -0.2), ("c", None)], "roi string, d double")
    row = burden.gene_burden(links, deltas, {"m": "d"}).first()
    assert (row["n_crr"], row["m_n_valid"]) == (3, 2)
    assert row["m_gain"] == pytest.approx(0.4 / math.sqrt(2)) and row["m_loss"] == pytest.approx(0.2 / math.sqrt(2))


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2)) + [5, 0]
    y = 1 + x @ [2, -1] + rng.normal(size=80)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([x, y])], "a double, b double, y double")
    got = {r["term"]: r for r in burden.fit_ols(df, "y", ["a", "b"], standardize=False).collect()}
    design = np.column_stack([np.ones(80), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    residual = y - design @ beta
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * (residual @ residual) / 77)
    for term, b, se in zip(("(Intercept)", "a", "b"), beta, errors):
        assert got[term]["estimate"] == pytest.approx(b) and got[term]["std_error"] == pytest.approx(se)


def test_ari_of_renamed_partition(spark):
    df = spark.createDataFrame([(i % 3, f"c{(i + 1) % 3}") for i in range(30)], "a int, b string")
    assert validity.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(1.0)


def test_mfa_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double, e double")
    families = {"p": ["a", "b"], "q": ["c", "d", "e"]}
    eigen, coordinates = mfa.fit(df, "id", families)
    z = (x - x.mean(0)) / x.std(0)
    blocks = [z[:, :2], z[:, 2:]]
    scaled = np.hstack([b / np.sqrt(np.linalg.eigvalsh(b.T @ b / 60)[-1]) for b in blocks])
    want = np.linalg.eigvalsh(scaled.T @ scaled / 60)[::-1]
    assert [r["eigenvalue"] for r in eigen.orderBy("dim").collect()] == pytest.approx(want)
    got = np.array([r["coord"] for r in coordinates.orderBy("id").collect()])
    assert got @ got.T == pytest.approx(scaled @ scaled.T)


def test_agglomerate():
    points = np.array([0.0, 0.1, 5.0, 5.2, 9.0])
    gaps = np.abs(points[:, None] - points[None, :])
    assert validity.agglomerate(gaps, "average", cut=1.0) == [1, 1, 2, 2, 3]
    assert validity.agglomerate(gaps, "ward", k=2) == [1, 1, 2, 2, 2]
