"""Hand-computed and brute-force checks of scans and interval operators."""

import random

import pytest
from pyspark.sql import functions as F

from binloom.operators import intervals, stitch
from binloom.operators.scan import Running, running
from binloom.params import MARKS
from binloom.plans import adapters


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def frame(spark, data, schema="chrom string, start long, end long"):
    return spark.createDataFrame(data, schema)


def bins(spark, chrom, values, stage="d0"):
    return [(chrom, i, stage, v) for i, v in enumerate(values)]


BINS = "chrom string, bin long, stage string, m int"


def test_stitch_runs(spark):
    data = bins(spark, "a", [1, 1, 0, 1, 1, 1, 0, 0, 1, 0]) + bins(spark, "b", [0, 1]) + bins(spark, "c", [1, 1])
    df = spark.createDataFrame(data, BINS)
    got = rows(stitch.stitch_segments(df, "m"), "chrom", "start", "end", "len")
    assert got == [("a", 0, 400, 2), ("a", 600, 1200, 3), ("c", 0, 400, 2)]
    assert rows(stitch.isolated_bins(df, "m"), "chrom", "start") == [("a", 1600), ("b", 200)]
    empty = stitch.stitch_segments(df.withColumn("m", F.lit(0)), "m")
    assert empty.count() == 0 and "len" in empty.columns


def test_stitch_crosses_words_and_chunks(spark):
    values = [1] * 100 + [0] + [1] * 40
    df = spark.createDataFrame(bins(spark, "a", values), BINS)
    for width in (7, 33, 65536):
        got = rows(stitch.stitch_segments(df, "m", bin_size=1, width=width), "start", "end")
        assert got == [(0, 100), (101, 141)]


@pytest.mark.parametrize(
    "data,slack,want",
    [
        ([(0, 1400), (1400, 2800)], 0, [(0, 2800)]),
        ([(0, 1400), (1401, 2800)], 0, [(0, 1400), (1401, 2800)]),
        ([(0, 1400), (1401, 2800)], 1, [(0, 2800)]),
        ([(0, 100), (10, 20), (50, 120)], 0, [(0, 120)]),
    ],
)
def test_merge(spark, data, slack, want):
    df = frame(spark, [("a", s, e) for s, e in data])
    for width in (8, 64, 65536):
        assert rows(intervals.merge_intervals(df, slack=slack, width=width), "start", "end") == want


def test_merge_random_against_sweep(spark):
    rng = random.Random(3)
    data = []
    for _ in range(400):
        s = rng.randrange(0, 4000)
        data.append((rng.choice("ab"), s, s + rng.choice([1, 3, 9, 300 if rng.random() < 0.05 else 5])))
    want = []
    for chrom in "ab":
        for s, e in sorted((s, e) for c, s, e in data if c == chrom):
            if want and want[-1][0] == chrom and s <= want[-1][2]:
                want[-1] = (chrom, want[-1][1], max(want[-1][2], e))
            else:
                want.append((chrom, s, e))
    got = rows(intervals.merge_intervals(frame(spark, data), width=16), "chrom", "start", "end")
    assert got == sorted(want)


def test_running_small_chunks(spark):
    data = [("k", p, v) for p, v in [(0, 5), (3, 1), (4, None), (9, 7), (20, 2)]]
    df = spark.createDataFrame(data, "k string, p long, v long")
    specs = [
        Running("total", "sum", "v"),
        Running("before", "max", "v", inclusive=False),
        Running("after", "min", "v", forward=False),
        Running("seen", "last", "v"),
    ]
    got = rows(running(df, ["k"], "p", specs, width=4), "p", "total", "before", "after", "seen")
    assert got == [(0, 5, None, 1, 5), (3, 6, 5, 1, 1), (4, 6, 5, 2, 1), (9, 13, 5, 2, 7), (20, 15, 7, 2, 2)]


def test_split(spark):
    df = frame(
        spark,
        [("a", 0, 4000, "p"), ("b", 0, 3999, "q"), ("c", 0, 4999, "r"), ("d", 0, 4998, "s")],
        "chrom string, start long, end long, peak string",
    )
    got = rows(intervals.split_long(df), "chrom", "start", "end", "peak")
    assert got == [
        ("a", 0, 1999, "p_1"), ("a", 2000, 4000, "p_2"), ("b", 0, 3999, "q"),
        ("c", 0, 1999, "r_1"), ("c", 2000, 3999, "r_2"), ("c", 4000, 4999, "r_3"),
        ("d", 0, 1999, "s_1"), ("d", 2000, 4998, "s_2"),
    ]


def test_tile(spark):
    df = frame(spark, [("a", 0, 10001, "x"), ("b", 0, 10000, "y")], "chrom string, start long, end long, peak_uid string")
    got = rows(intervals.tile(df), "chrom", "sub_start", "sub_end", "sub_order", "is_sliced")
    assert got[:6] == [("a", 2000 * i, min(2000 * i + 2000, 10001), i + 1, True) for i in range(6)]
    assert got[6:] == [("b", 0, 10000, 1, False)]


def test_overlap_modes(spark):
    a = frame(spark, [("a", 0, 200)])
    b = frame(spark, [("a", 200, 400)])
    named = b.select("chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    assert intervals.overlap_join(a, named).count() == 0
    assert intervals.overlap_join(a, named, closed=True).count() == 1
    assert intervals.with_overlap(a, b).count() == 0
    assert intervals.with_overlap(a, b, closed=True).count() == 1


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)

    def some(n):
        return [("a" if rng.random() < 0.7 else "b", s := rng.randrange(500), s + rng.randrange(1, 60)) for _ in range(n)]

    left, right = some(120), some(150)
    a = spark.createDataFrame([(i, *t) for i, t in enumerate(left)], "id int, chrom string, start long, end long")
    b = frame(spark, right)
    named = b.select("chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    pairs = sorted((i, s2, e2) for i, (c, s, e) in enumerate(left) for c2, s2, e2 in right if c == c2 and s < e2 and s2 < e)
    assert rows(intervals.overlap_join(a, named, bucket=16), "id", "b_start", "b_end") == pairs
    counts = {i: 0 for i in range(len(left))}
    for i, *_ in pairs:
        counts[i] += 1
    assert rows(intervals.count_overlaps(a, b, name="n", width=32), "id", "n") == sorted(counts.items())


def test_nearest_ties(spark):
    q = frame(spark, [("a", 10, 20), ("b", 10, 20)])
    p = spark.createDataFrame([("a", 5), ("a", 25), ("a", 90), ("b", 12), ("b", 15)], "chrom string, pos long")
    for width in (4, 65536):
        got = rows(intervals.nearest_points(q, p, width=width), "chrom", "near_pos", "distance")
        assert got == [("a", 5, 5), ("a", 25, 5), ("b", 12, 0), ("b", 15, 0)]


def test_origin_name_rounds_half_even(spark):
    rois = frame(spark, [("a", 100, 300, "x")], "chrom string, start long, end long, peak string")
    segs = frame(spark, [("a", 0, 400, "d0"), ("a", 400, 800, "d7")], "chrom string, start long, end long, stage string")
    got = intervals.origin_names(rois, segs, ("d0", "d7")).first()
    assert got["peak"] == "d0_a:0:400" and got["start"] == 100


def test_windows_met(spark):
    tiles = spark.createDataFrame([("a", k) for k in range(12)] + [("b", 3), (None, 3), ("a", None)], "chrom string, bin long")
    spans = spark.createDataFrame([("a", 200, 600), ("a", 500, 601), ("a", 1999, 2000), ("a", 700, 700), (None, 0, 900)], "chrom string, start long, end long")
    met = intervals.windows_met(tiles, spans, size=200)
    assert sorted(r.bin for r in met.collect()) == [1, 2, 3, 9]
    apart = intervals.windows_met(tiles, spans, size=200, met=False)
    assert sorted((r.chrom, r.bin) for r in apart.collect()) == [("a", k) for k in (0, 4, 5, 6, 7, 8, 10, 11)] + [("b", 3)]


def test_bins_are_grouped_by_small_rows(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    unknown = lines.limit(3).withColumns({"l_suppkey": F.lit(10**6).cast(lines.schema["l_suppkey"].dataType), "l_tax": F.lit(None).cast(lines.schema["l_tax"].dataType)})
    vague = lines.limit(50).withColumn("l_tax", F.lit(None).cast(lines.schema["l_tax"].dataType))
    lines.limit(400).unionByName(unknown).unionByName(vague).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").write.parquet(str(tmp_path / "supplier.parquet"))
    keys, marked = ["chrom", "stage", "bin"], adapters.marked_cells(spark, str(tmp_path))
    expected = marked.groupBy(*keys).agg(*[F.max(m).alias(m) for m in MARKS])
    whole = adapters.bins(spark, str(tmp_path))
    got = adapters.cells(spark, str(tmp_path))
    inside = whole.join(marked.select(*keys).distinct(), keys, "left_semi")
    assert got.exceptAll(inside).isEmpty() and inside.exceptAll(got).isEmpty()
    filled = [F.when(F.col("chrom") != "chr1000000", F.coalesce(m, F.when(F.col("bin") >= 0, 0))).otherwise(F.col(m)).alias(m) for m in MARKS]
    expected = expected.select(*keys, *filled)
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
    assert whole.count() > got.count() and not got.where(F.col(MARKS[1]).isNull()).isEmpty()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "partial_max(H3" not in plan
