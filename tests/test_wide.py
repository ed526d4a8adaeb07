"""Features of regions of any width against a plain version over bins."""

import random

import pytest

from binloom.operators import features, wide
from binloom.operators.stitch import pack_bins
from binloom.params import MARKS as ALL_MARKS
from binloom.params import STAGES

MARKS = ALL_MARKS[:3]


def plain(cells, first, stop):
    """Spatial statistics of one 0/1 vector, bin by bin."""
    v = [int(b in cells) for b in range(first, stop)]
    n, ones = len(v), sum(v)
    best = run = 0
    for x in v:
        run = run + 1 if x else 0
        best = max(best, run)
    return {
        "coverage": ones / n,
        "nseg": float(sum(1 for i, x in enumerate(v) if x and not (i and v[i - 1]))),
        "maxseg_bins": float(best),
        "com": sum(i for i, x in enumerate(v, 1) if x) / ones / n if ones else None,
        "local_var": sum(a != b for a, b in zip(v, v[1:])) / (n - 1) if n > 1 else None,
    }


def runs(rng, last):
    """Bins in runs of any length, some over many words; gaps leave words without a row."""
    cells, at = set(), rng.randint(-300, 0)
    while at < last:
        length = rng.choice([1, 2, 5, 31, 32, 33, 64, 200, 900])
        cells |= set(range(at, at + length))
        at += length + rng.choice([1, 2, 7, 32, 40, 300])
    return cells


@pytest.fixture(scope="module")
def tracks(spark):
    rng = random.Random(4)
    cells = {(m, s): runs(rng, 5400) for m in MARKS for s in STAGES}
    cells[MARKS[0], STAGES[0]] = set()
    cells[MARKS[1], STAGES[0]] = set(range(-400, 5600))
    rows = [
        ("chr1", b, s, *(int(b in cells[m, s]) for m in MARKS))
        for s in STAGES for b in sorted(set().union(*(cells[m, s] for m in MARKS)))
    ]
    bins = spark.createDataFrame(rows, ["chrom", "bin", "stage", *MARKS])
    words = pack_bins(bins, MARKS)
    words.persist()
    return cells, words


def test_any_width_equals_bins_one_by_one(spark, tracks):
    cells, words = tracks
    rng = random.Random(5)
    spans = [(0, 1), (31, 33), (32, 64), (-300, 4700), (-7, 73), (5, 5005), (5390, 5800), (6000, 6080)]
    spans += [(a, a + rng.randint(1, 3000)) for a in (rng.randint(-350, 5500) for _ in range(12))]
    regions = spark.createDataFrame(
        [("chr1", a * 200, b * 200, f"r{k}") for k, (a, b) in enumerate(spans)] + [("chr1", 400, 400, "none")],
        "chrom string, start long, end long, roi string",
    )
    for width in (3, wide.CHUNK_WORDS):
        got = {r.roi: r.asDict() for r in wide.region_features(regions, words, marks=MARKS, width=width).collect()}
        assert set(got) == {f"r{k}" for k in range(len(spans))}
        for k, (a, b) in enumerate(spans):
            row = got[f"r{k}"]
            for m in MARKS:
                for s in STAGES:
                    for stat, want in plain(cells[m, s], a, b).items():
                        value = row[f"{m}_{s}_{stat}"]
                        assert value is None if want is None else value == pytest.approx(want), (k, m, s, stat)
            one, two = (cells[m, STAGES[2]] & set(range(a, b)) for m in MARKS[1:3])
            want = len(one & two) / len(one | two) if one | two else None
            name = f"{MARKS[1]}_vs_{MARKS[2]}_{STAGES[2]}_jaccard"
            assert row[name] is None if want is None else row[name] == pytest.approx(want)
            flags = [[b_ in cells[MARKS[2], s] for s in STAGES] for b_ in range(a, b)]
            assert row[f"{MARKS[2]}_pattern_110"] == pytest.approx(sum(f == [True, True, False] for f in flags) / (b - a))


def test_narrow_regions_equal_the_single_mask(spark, tracks):
    _, words = tracks
    rng = random.Random(6)
    spans = [(a, a + rng.randint(1, 62)) for a in (rng.randint(-350, 5500) for _ in range(30))]
    regions = spark.createDataFrame(
        [("chr1", a * 200, b * 200, f"r{k}") for k, (a, b) in enumerate(spans)], "chrom string, start long, end long, roi string"
    )
    one = {r.roi: r.asDict() for r in features.features_from_masks(features.region_masks(regions, words, marks=MARKS), marks=MARKS).collect()}
    other = {r.roi: r.asDict() for r in wide.region_features(regions, words, marks=MARKS).collect()}
    assert one.keys() == other.keys()
    for roi in one:
        assert one[roi] == pytest.approx(other[roi], nan_ok=True)


def test_unknown_chromosome_raises(spark, tracks):
    _, words = tracks
    regions = spark.createDataFrame([("chrX", 0, 400, "r")], "chrom string, start long, end long, roi string")
    known = spark.createDataFrame([("chr1",)], "chrom string")
    assert wide.region_features(regions, words, marks=MARKS).first()[f"{MARKS[0]}_{STAGES[0]}_coverage"] == 0
    with pytest.raises(Exception, match="unknown chromosome"):
        wide.region_features(regions, words, marks=MARKS, chroms=known).collect()
