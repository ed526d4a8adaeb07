"""Queries over bins, segments, merged regions and interval pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from binloom.functions.columns import rounded
from binloom.operators import disjoint, intervals, stitch
from binloom.params import MARKS, STAGES
from binloom.plans import adapters as A
from binloom.plans.sql import with_ctes, r6

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


@query(
    "bin_summary",
    with_ctes(
        f"""SELECT stage, mark, count(*) AS n_windows, CAST(sum(v) AS BIGINT) AS n_positive,
        {r6('avg(v)')} AS fraction FROM marks GROUP BY stage, mark""",
        "marks",
    ),
)
def bin_summary(spark, sf):
    return stitch.input_summary(A.bins(spark, sf)).withColumn("fraction", rounded(F.col("fraction")))


@query("stitch_segments", with_ctes('SELECT stage, chrom, "start", "end", len FROM segs', "segs"))
def stitch_segments(spark, sf):
    return A.segments(spark, sf)


@query(
    "stitch_all_marks",
    with_ctes(
        """SELECT mark, stage, chrom, min(bin) * 200 AS "start", (max(bin) + 1) * 200 AS "end",
        count(*) AS len FROM (SELECT mark, stage, chrom, bin, bin - row_number() OVER
          (PARTITION BY mark, stage, chrom ORDER BY bin) AS g FROM marks WHERE v = 1)
        GROUP BY mark, stage, chrom, g HAVING count(*) >= 2""",
        "marks",
    ),
)
def stitch_all_marks(spark, sf):
    packed = A.words(spark, sf)
    names = [f"{m}_{s}" for m in MARKS for s in STAGES]
    long = packed.unpivot(["chrom", "word"], names, "track", "mask").select(
        F.element_at(F.split("track", "_"), 1).alias("mark"),
        F.element_at(F.split("track", "_"), 2).alias("stage"),
        "chrom",
        "word",
        "mask",
    )
    return stitch.stitch_bits(long, keys=("mark", "stage", "chrom"))


@query(
    "length_cutoff_counts",
    with_ctes(
        f"""SELECT stage, CAST(k AS BIGINT) AS cutoff_bins, count(*) FILTER (WHERE len >= k) AS n_segments,
        {r6('count(*) FILTER (WHERE len >= k) / count(*)')} AS fraction
        FROM segs CROSS JOIN (SELECT unnest(range(2, 22)) AS k) GROUP BY stage, k""",
        "segs",
    ),
)
def length_cutoff_counts(spark, sf):
    return stitch.length_cutoffs(A.segments(spark, sf)).withColumn("fraction", rounded(F.col("fraction")))


@query(
    "isolated_bins",
    with_ctes('SELECT stage, chrom, b0 * 200 AS "start", (b1 + 1) * 200 AS "end" FROM runs WHERE len = 1', "runs"),
)
def isolated_bins(spark, sf):
    return stitch.isolated_bins(A.marked_cells(spark, sf)).drop("len")


@query(
    "merge_stage_intervals",
    with_ctes('SELECT chrom, "start", "end", time_points, n_members FROM merged', "merged"),
)
def merge_stage_intervals(spark, sf):
    return intervals.merge_stages(A.long_segments(spark, sf), STAGES)


@query(
    "merged_members",
    with_ctes(
        """SELECT chrom, stage, "start", "end", name,
        min("start") OVER (PARTITION BY chrom, isl) AS region_start FROM islands""",
        "islands",
    ),
)
def merged_members(spark, sf):
    return intervals.region_members(A.long_segments(spark, sf).drop("len"))


@query(
    "merged_peak_names",
    with_ctes(
        """SELECT chrom, rs AS region_start, stage, "start" // 65536 AS part,
        array_to_string(list(name ORDER BY "start", "end"), '|') AS merged_peaks FROM
        (SELECT *, min("start") OVER (PARTITION BY chrom, isl) AS rs FROM islands) GROUP BY ALL""",
        "islands",
    ),
)
def merged_peak_names(spark, sf):
    members = intervals.region_members(A.long_segments(spark, sf))
    named = intervals.merged_names(members, stage_order=STAGES)
    stage = F.element_at(F.array(*map(F.lit, STAGES)), F.col("piece.stage_rank") + 1)
    return named.select("chrom", "region_start", "merged_peaks", stage.alias("stage"), F.col("piece.part").alias("part"))


@query(
    "reduce_intervals",
    with_ctes(
        """SELECT chrom, min("start") AS "start", max("end") AS "end" FROM
        (SELECT *, sum(h) OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM
         (SELECT *, CASE WHEN "start" <= 1 + max("end") OVER (PARTITION BY chrom ORDER BY "start", "end"
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS h FROM regions))
        GROUP BY chrom, isl""",
        "regions",
    ),
)
def reduce_intervals(spark, sf):
    return intervals.merge_intervals(A.regions(spark, sf), slack=1)


@query(
    "merge_touching",
    with_ctes(
        """SELECT stage, chrom, min("start") AS "start", max("end") AS "end" FROM
        (SELECT *, sum(h) OVER (PARTITION BY stage, chrom ORDER BY "start", "end"
           ROWS UNBOUNDED PRECEDING) AS isl FROM
         (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY stage, chrom ORDER BY "start", "end"
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS h FROM regions))
        GROUP BY stage, chrom, isl""",
        "regions",
    ),
)
def merge_touching(spark, sf):
    return intervals.merge_intervals(A.regions(spark, sf), ("stage", "chrom"))


_SPLIT = """SELECT chrom, rid, s + (i - 1) * 200 AS "start",
    CASE WHEN i = pieces THEN e ELSE s + i * 200 - 1 END AS "end",
    CASE WHEN w > 400 THEN peak || '_' || i ELSE peak END AS peak, peak AS orig_peak FROM
    (SELECT *, unnest(range(1, 1 + pieces)) AS i FROM (SELECT *, CASE WHEN w <= 400 THEN 1
       WHEN full_n > 1 AND w - (full_n - 1) * 200 < 100 THEN full_n - 1 ELSE full_n END AS pieces
     FROM (SELECT chrom, rid, "start" AS s, "end" AS e, 'r' || rid AS peak, "end" - "start" + 1 AS w,
       CAST(ceil(("end" - "start" + 1) / 200.0) AS BIGINT) AS full_n FROM regions)))"""


@query("split_long_regions", with_ctes(_SPLIT, "regions"))
def split_long_regions(spark, sf):
    named = A.regions(spark, sf).select(
        "chrom", "rid", "start", "end", F.concat(F.lit("r"), F.col("rid").cast("string")).alias("peak")
    )
    return intervals.split_long(named, 400, 200, 100)


@query(
    "tile_regions",
    with_ctes(
        """SELECT chrom, peak_uid, CAST(i AS BIGINT) AS sub_order, w > 500 AS is_sliced,
        CASE WHEN w > 500 THEN s + (i - 1) * 100 ELSE s END AS sub_start,
        CASE WHEN w > 500 THEN least(s + i * 100, e) ELSE e END AS sub_end,
        CASE WHEN w > 500 THEN peak_uid || '_sub' || lpad(CAST(i AS VARCHAR), 4, '0') ELSE peak_uid END AS sub_name
        FROM (SELECT *, unnest(range(1, 1 + CASE WHEN w > 500 THEN CAST(ceil(w / 100.0) AS BIGINT) ELSE 1 END)) AS i
        FROM (SELECT chrom, 'P' || lpad(CAST(rid AS VARCHAR), 9, '0') AS peak_uid, "start" AS s, "end" AS e,
          "end" - "start" AS w FROM regions))""",
        "regions",
    ),
)
def tile_regions(spark, sf):
    keyed = A.regions(spark, sf).select(
        "chrom", "start", "end", F.format_string("P%09d", "rid").alias("peak_uid")
    )
    return intervals.tile(keyed, 500, 100).select(
        "chrom", "peak_uid", F.col("sub_order").cast("long").alias("sub_order"), "is_sliced",
        "sub_start", "sub_end", "sub_name",
    )


@query(
    "make_windows",
    with_ctes(
        """SELECT cluster, chrom, rid, ws AS "start", least(ws + 30, "end") AS "end" FROM
        (SELECT *, unnest(range("start", "end", 30)) AS ws FROM regions)""",
        "regions",
    ),
)
def make_windows(spark, sf):
    return intervals.make_windows(
        A.regions(spark, sf).select("cluster", "chrom", "rid", "start", "end"), 30
    )


@query(
    "rename_origin",
    with_ctes(
        """SELECT chrom, "start", "end", concat_ws('-', CASE WHEN f0 THEN 'd0' END,
        CASE WHEN f7 THEN 'd7' END, CASE WHEN f15 THEN 'd15' END) || '_' || chrom || ':' || rs || ':' || re AS peak
        FROM (SELECT r.chrom, r."start", r."end", rs, re, bool_or(l.stage = 'd0') AS f0, bool_or(l.stage = 'd7') AS f7,
          bool_or(l.stage = 'd15') AS f15 FROM (SELECT *, CAST(round_even("start" / 200.0, 0) AS BIGINT) * 200 AS rs,
          CAST(round_even("end" / 200.0, 0) AS BIGINT) * 200 AS re FROM rois) r LEFT JOIN longsegs l
          ON l.chrom = r.chrom AND l."start" < r.re AND r.rs < l."end" GROUP BY ALL)""",
        "rois", "longsegs",
    ),
)
def rename_origin(spark, sf):
    return intervals.origin_names(
        A.rois(spark, sf).drop("roi"), A.long_segments(spark, sf), STAGES
    )


_PAIRS = """FROM regions a JOIN regions b ON a.chrom = b.chrom AND a."start" < b."end" AND b."start" < a."end\""""


def _other(regions):
    return regions.select(
        "chrom", F.col("rid").alias("b_rid"), F.col("start").alias("b_start"), F.col("end").alias("b_end")
    )


@query(
    "overlap_self_pairs",
    with_ctes(
        """SELECT a.rid AS a_rid, b.rid AS b_rid FROM regions a JOIN regions b ON a.chrom = b.chrom
        AND a."start" <= b."end" AND b."start" <= a."end" AND a.rid < b.rid""",
        "regions",
    ),
)
def overlap_self_pairs(spark, sf):
    regions = A.regions(spark, sf).select("chrom", "rid", "start", "end")
    pairs = intervals.overlap_join(regions, _other(regions), closed=True, bucket=512)
    return pairs.filter("rid < b_rid").select(F.col("rid").alias("a_rid"), "b_rid")


def _segment_windows(spark, sf):
    """Order regions of one stage against the regions of another."""
    regions = A.regions(spark, sf)
    early = regions.filter("stage = 'd0'").select("chrom", "rid", "start", "end")
    late = _other(regions.filter("stage = 'd7'"))
    return early, late


@query(
    "overlap_bp",
    with_ctes(
        """SELECT a.rid, b.rid AS b_rid, least(a."end", b."end") - greatest(a."start", b."start") AS bp
        FROM regions a JOIN regions b ON a.chrom = b.chrom AND a."start" < b."end" AND b."start" < a."end"
        AND a.stage = 'd0' AND b.stage = 'd7'""",
        "regions",
    ),
)
def overlap_bp(spark, sf):
    early, late = _segment_windows(spark, sf)
    return intervals.overlap_join(early, late, bucket=512).select(
        "rid", "b_rid", intervals.overlap_bp().alias("bp")
    )


_COUNT = """SELECT a.rid, count(b.rid) AS n FROM regions a LEFT JOIN regions b ON a.chrom = b.chrom
    AND a."start" {op} b."end" AND b."start" {op} a."end" AND b.stage = 'd7' WHERE a.stage = 'd0' GROUP BY a.rid"""


@query("count_overlaps", with_ctes(_COUNT.format(op="<"), "regions"))
def count_overlaps(spark, sf):
    early, late = _segment_windows(spark, sf)
    return intervals.count_overlaps(early, late, b_range=("b_start", "b_end"), name="n").select("rid", "n")


@query("count_overlaps_closed", with_ctes(_COUNT.format(op="<="), "regions"))
def count_overlaps_closed(spark, sf):
    early, late = _segment_windows(spark, sf)
    return intervals.count_overlaps(
        early, late, b_range=("b_start", "b_end"), closed=True, name="n"
    ).select("rid", "n")


_EXISTS = """SELECT a.rid, a.chrom, a."start", a."end" FROM regions a WHERE a.stage = 'd0' AND {neg} EXISTS
    (SELECT 1 FROM regions b WHERE b.stage = 'd7' AND a.chrom = b.chrom AND a."start" < b."end" AND b."start" < a."end")"""


@query("overlap_semi", with_ctes(_EXISTS.format(neg=""), "regions"))
def overlap_semi(spark, sf):
    early, late = _segment_windows(spark, sf)
    return intervals.with_overlap(early, late, b_range=("b_start", "b_end"))


@query("overlap_anti", with_ctes(_EXISTS.format(neg="NOT"), "regions"))
def overlap_anti(spark, sf):
    early, late = _segment_windows(spark, sf)
    return intervals.without_overlap(early, late, b_range=("b_start", "b_end"))


@query(
    "bins_outside_segments",
    with_ctes(
        """SELECT b.stage, b.chrom, b.bin FROM bins b WHERE b.H3K27me3 = 1 AND NOT EXISTS (SELECT 1 FROM segs s
        WHERE s.stage = b.stage AND s.chrom = b.chrom AND s."start" < (b.bin + 1) * 200 AND b.bin * 200 < s."end")""",
        "segs",
    ),
)
def bins_outside_segments(spark, sf):
    marked = A.marked_cells(spark, sf).select("stage", "chrom", "bin").distinct()
    return intervals.windows_met(marked, A.segments(spark, sf), on=("stage", "chrom"), met=False).select("stage", "chrom", "bin")


@query(
    "nearest_point_ties",
    with_ctes(
        """SELECT rid, near_pos, distance FROM (SELECT rid, pos AS near_pos, d AS distance,
          min(d) OVER (PARTITION BY rid) AS best FROM (SELECT DISTINCT r.rid, p.pos,
            CASE WHEN p.pos < r."start" THEN r."start" - p.pos WHEN p.pos > r."end" THEN p.pos - r."end" ELSE 0 END AS d
          FROM regions r JOIN points p ON p.chrom = r.chrom)) WHERE d = best""".replace("WHERE d = best", "WHERE distance = best"),
        "regions", "points",
    ),
)
def nearest_point_ties(spark, sf):
    queries = A.regions(spark, sf, ["chrom", "rid", "start", "end"])
    return intervals.nearest_points(queries, A.points(spark, sf, ["chrom", "pos"])).select("rid", "near_pos", "distance")


@query(
    "flank_counts",
    with_ctes(
        """SELECT f.rid, f.side, count(p.pos) AS n FROM
        (SELECT rid, chrom, 'left' AS side, "start" - 200 AS s, "start" - 10 AS e FROM regions UNION ALL
         SELECT rid, chrom, 'right', "end" + 10, "end" + 200 FROM regions) f
        LEFT JOIN points p ON p.chrom = f.chrom AND p.pos < f.e AND p.pos >= f.s GROUP BY 1, 2""",
        "regions", "points",
    ),
)
def flank_counts(spark, sf):
    sides = intervals.flanks(A.regions(spark, sf, ["chrom", "rid", "start", "end"]))
    spots = A.points(spark, sf, ["chrom", "pos"]).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    return intervals.count_overlaps(sides, spots, name="n").select("rid", "side", "n")


@query(
    "greedy_disjoint",
    with_ctes(
        """SELECT rid, chrom, s AS "start", e AS "end" FROM (SELECT unnest(kept, recursive := true) FROM walk WHERE step = (SELECT max(n) FROM ranked))""",
        "regions",
        extra=(
            """listed AS MATERIALIZED (SELECT rid, 'a' || (rid % 25) AS chrom, "start" AS s, "end" AS e, rid * 7919 % 10007 AS p FROM regions)""",
            "ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY p, rid) AS n FROM listed)",
            """walk(chrom, step, kept) AS (SELECT chrom, 0::BIGINT, []::STRUCT(rid BIGINT, chrom VARCHAR, s BIGINT, e BIGINT)[] FROM (SELECT DISTINCT chrom FROM listed)
            UNION ALL SELECT w.chrom, w.step + 1, CASE WHEN r.rid IS NULL OR len(list_filter(w.kept, lambda k: k.s < r.e AND r.s < k.e)) > 0 THEN w.kept
              ELSE list_append(w.kept, {'rid': r.rid, 'chrom': r.chrom, 's': r.s, 'e': r.e}) END
            FROM walk w LEFT JOIN ranked r ON r.chrom = w.chrom AND r.n = w.step + 1 WHERE w.step < (SELECT max(n) FROM ranked))""",
        ),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def greedy_disjoint(spark, sf):
    """Regions of orders that a loop in scattered priority would keep, on 25 shared axes."""
    rows = A.regions(spark, sf).select(
        "rid", F.concat(F.lit("a"), (F.col("rid") % 25).cast("string")).alias("chrom"), "start", "end",
        (F.col("rid") * 7919 % 10007).alias("p"),
    )
    return disjoint.greedy_disjoint(rows, ["p", "rid"]).drop("p")
