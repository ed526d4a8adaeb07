"""Interval algebra: overlap joins and counts, merging, splitting, nearest points.

Intervals are ``(start, end)`` integer columns plus key columns (``chrom`` by default).
Half-open intervals overlap when they share at least one base; ``closed=True`` also
counts touching ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from binloom.functions.columns import round_to_grid
from binloom.operators.scan import CHUNK, Running, joinable, position_chunk, running
from binloom.params import DEFAULTS

CHROM = ("chrom",)


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    on: Sequence[str] = CHROM,
    a_range: tuple[str, str] = ("start", "end"),
    b_range: tuple[str, str] = ("b_start", "b_end"),
    closed: bool = False,
    bucket: int = DEFAULTS.bucket_width,
) -> DataFrame:
    """Every overlapping pair of rows of ``a`` and ``b`` that agree on ``on``.

    Both sides are spread over the position buckets they touch and meet in an equi-join;
    a pair is kept in the first bucket the two share, so it appears once. Partitions of a
    crowded bucket are split at run time by the adaptive skew join.
    """
    on = list(on)
    last = 0 if closed else 1

    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        first = F.floor(F.col(start) / bucket).cast("long")
        final = F.floor((F.col(end) - last) / bucket).cast("long")
        return df.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, final))))

    left = spread(a, *a_range)
    right = spread(b, *b_range)
    a_start, a_end = (F.col(c) for c in a_range)
    b_start, b_end = (F.col(c) for c in b_range)
    if closed:
        meets = (a_start <= b_end) & (b_start <= a_end)
    else:
        meets = (a_start < b_end) & (b_start < a_end)
    first_shared = F.floor(F.greatest(a_start, b_start) / bucket).cast("long")
    return (
        left.join(right, on + ["_bucket"])
        .filter(meets & (F.col("_bucket") == first_shared))
        .drop("_bucket")
    )


def overlap_bp(a_range=("start", "end"), b_range=("b_start", "b_end")) -> Column:
    """Shared length of two half-open intervals of one joined row."""
    return F.least(a_range[1], b_range[1]) - F.greatest(a_range[0], b_range[0])


def count_overlaps(
    a: DataFrame,
    b: DataFrame,
    on: Sequence[str] = CHROM,
    a_range: tuple[str, str] = ("start", "end"),
    b_range: tuple[str, str] = ("start", "end"),
    closed: bool = False,
    name: str = "n_overlaps",
    by: tuple[str, Sequence[str]] | None = None,
    width: int = DEFAULTS.scan_width,
) -> DataFrame:
    """``a`` with the number of overlapping rows of ``b``, without forming pairs.

    The count is the number of ``b`` starts up to the end of the row minus the number of
    ``b`` ends before its start; both are running totals over positions. ``by`` is a
    column of ``b`` with its values: then one count ``<name>_<value>`` each.
    """
    on = list(on)
    upto = (F.col(a_range[1]) - F.lit(0 if closed else 1)).cast("long")
    before = (F.col(a_range[0]) - F.lit(1 if closed else 0)).cast("long")
    if by is None:
        tests = {name: F.lit(True)}
    else:
        tests = {f"{name}_{value}": F.col(by[0]) == value for value in by[1]}
    out = list(tests)
    marks = b.select(
        *on,
        *[test.alias(f"_is_{n}") for n, test in tests.items()],
        F.explode(
            F.array(
                F.struct(F.col(b_range[0]).cast("long").alias("_pos"), F.lit(True).alias("_begin")),
                F.struct(F.col(b_range[1]).cast("long").alias("_pos"), F.lit(False).alias("_begin")),
            )
        ).alias("_m"),
    ).select(
        *on,
        "_m._pos",
        F.lit(0).cast("long").alias("_asked"),
        *[(F.col("_m._begin") & F.col(f"_is_{n}")).cast("long").alias(f"_s_{n}") for n in out],
        *[(~F.col("_m._begin") & F.col(f"_is_{n}")).cast("long").alias(f"_e_{n}") for n in out],
    )
    sides = [f"_{side}_{n}" for side in "se" for n in out]
    asked = a.select(*on, F.explode(F.array(upto, before)).alias("_pos")).select(
        *on, "_pos", F.lit(1).cast("long").alias("_asked"), *[F.lit(0).cast("long").alias(c) for c in sides]
    )
    positions = (
        marks.unionByName(asked)
        .groupBy(*on, "_pos")
        .agg(F.max("_asked").alias("_asked"), *[F.sum(c).alias(c) for c in sides])
    )
    # All columns are named in the scan and in the filter, so both joins share its shuffles.
    specs = [Running("_ever", "max", "_asked"), *[Running(f"_run{c}", "sum", c) for c in sides]]
    totals = running(positions, on, "_pos", specs, width).filter(
        (F.least("_asked", "_ever") == 1) & (F.greatest("_asked", *[f"_run{c}" for c in sides]) >= 0)
    )
    begun = totals.select(*on, F.col("_pos").alias("_upto"), *[f"_run_s_{n}" for n in out])
    ended = totals.select(*on, F.col("_pos").alias("_before"), *[f"_run_e_{n}" for n in out])
    return (
        a.withColumn("_upto", upto)
        .withColumn("_before", before)
        .join(begun, on + ["_upto"])
        .join(ended, on + ["_before"])
        .select(*a.columns, *[(F.col(f"_run_s_{n}") - F.col(f"_run_e_{n}")).alias(n) for n in out])
    )


def with_overlap(a: DataFrame, b: DataFrame, **kwargs) -> DataFrame:
    """Rows of ``a`` that overlap at least one row of ``b``, each once."""
    return count_overlaps(a, b, name="_n", **kwargs).filter("_n > 0").drop("_n")


def without_overlap(a: DataFrame, b: DataFrame, **kwargs) -> DataFrame:
    """Rows of ``a`` that overlap no row of ``b``."""
    return count_overlaps(a, b, name="_n", **kwargs).filter("_n = 0").drop("_n")


def windows_met(
    a: DataFrame,
    b: DataFrame,
    window: str = "bin",
    on: Sequence[str] = CHROM,
    size: int = DEFAULTS.bin_size,
    met: bool = True,
) -> DataFrame:
    """Rows of ``a`` whose grid window an interval of ``b`` shares a base with, or with ``met=False`` those of no such window.

    ``window`` numbers the windows of ``size`` bases from position 0. Intervals become the windows they
    touch, so ``a`` is shuffled once and meets them by equality; the work is linear in the
    rows of ``a`` and the total length of ``b``. Rows without a key or a window go.
    """
    first, last = (F.floor(c / size).cast("long") for c in (F.col("start"), F.col("end") - 1))
    touched = b.filter("start < end").select(*on, F.explode(F.sequence(first, last)).alias(window))
    return joinable(a, [*on, window]).join(touched, [*on, window], "left_semi" if met else "left_anti")


def regions_of(
    df: DataFrame,
    keys: Sequence[str] = CHROM,
    slack: int = 0,
    extra: Sequence[Column] = (),
    width: int = DEFAULTS.scan_width,
) -> DataFrame:
    """One row per distinct (keys, start) with the start of its merged region.

    A row opens a region when it starts more than ``slack`` beyond every earlier end.
    ``extra`` are aggregates carried along per distinct start.

    Regions are first opened inside position chunks. One summary row per chunk then says
    how far earlier chunks reach and where the region they leave open began; a locally
    opened region that starts within that reach belongs to the open one.
    """
    keys = list(keys)
    group = keys + [CHUNK]
    starts = (
        df.groupBy(*keys, F.col("start").cast("long").alias("start"))
        .agg(F.max(F.col("end").cast("long")).alias("end"), *extra)
        .withColumn(CHUNK, position_chunk("start", width))
    )
    starts = joinable(starts, group)
    inside = Window.partitionBy(*group).orderBy("start")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = (
        starts.withColumn("_reached", F.max("end").over(before))
        .withColumn("_head", F.when(_beyond("start", "_reached", slack), F.col("start")))
        .withColumn(
            "_open",
            F.last("_head", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        local.groupBy(*group)
        .agg(F.max("end").alias("_end"), F.max("_head").alias("_last"))
        .withColumn("_far", F.max("_end").over(earlier))
        .withColumn("_opened", F.when(_beyond("_last", "_far", slack), F.col("_last")))
        .withColumn("_from", F.last("_opened", ignorenulls=True).over(earlier))
        .filter("_far is not null")
        .select(*group, "_far", "_from")
    )
    region = F.when(_beyond("_open", "_far", slack), F.col("_open")).otherwise(F.col("_from"))
    kept = [c for c in starts.columns if c != CHUNK]
    return local.join(carried, group, "left").select(*kept, region.alias("region_start"))


def _beyond(start: str, reached: str, slack: int) -> Column:
    return F.col(reached).isNull() | (F.col(start) > F.col(reached) + slack)


def merge_intervals(
    df: DataFrame,
    keys: Sequence[str] = CHROM,
    slack: int = 0,
    width: int = DEFAULTS.scan_width,
) -> DataFrame:
    """Union of the intervals of each key as disjoint regions.

    ``slack=0`` joins overlapping and touching intervals, ``slack=1`` also joins closed
    intervals on neighbouring integers.
    """
    keys = list(keys)
    return (
        regions_of(df, keys, slack, width=width)
        .groupBy(*keys, "region_start")
        .agg(F.max("end").alias("end"))
        .select(*keys, F.col("region_start").alias("start"), "end")
    )


def merge_stages(
    df: DataFrame,
    stages: Sequence[str],
    keys: Sequence[str] = CHROM,
    width: int = DEFAULTS.scan_width,
) -> DataFrame:
    """Merge the intervals of all stages; touching intervals join.

    ``time_points`` lists the contributing stages in text order, joined by ``_``.
    """
    keys = list(keys)
    ordered = sorted(stages)
    seen = [F.bool_or(F.col("stage") == s).alias(f"_at_{s}") for s in ordered]
    members = F.count(F.lit(1)).alias("_members")
    found = regions_of(df, keys, 0, [*seen, members], width)
    merged = found.groupBy(*keys, "region_start").agg(
        F.max("end").alias("end"),
        F.sum("_members").alias("n_members"),
        *[F.bool_or(f"_at_{s}").alias(f"_at_{s}") for s in ordered],
    )
    names = F.concat_ws("_", *[F.when(F.col(f"_at_{s}"), F.lit(s)) for s in ordered])
    return merged.select(
        *keys, F.col("region_start").alias("start"), "end", names.alias("time_points"), "n_members"
    )


def region_members(
    df: DataFrame, keys: Sequence[str] = CHROM, slack: int = 0, width: int = DEFAULTS.scan_width
) -> DataFrame:
    """Every input row with the start of the merged region it belongs to."""
    keys = list(keys)
    found = regions_of(df, keys, slack, width=width).select(*keys, "start", "region_start")
    return df.withColumn("start", F.col("start").cast("long")).join(found, keys + ["start"])


def merged_names(
    members: DataFrame,
    keys: Sequence[str] = CHROM,
    name: str = "name",
    stage_order: Sequence[str] = (),
    separator: str = "|",
) -> DataFrame:
    """Member names of each region joined in stage, then position order, in pieces.

    Names of one region are grouped by the scan chunk of their start, so a region with
    very many members becomes several rows; ``piece`` orders them.
    """
    rank = F.lit(0)
    for i, stage in enumerate(stage_order):
        rank = F.when(F.col("stage") == stage, i).otherwise(rank)
    piece = F.floor(F.col("start") / DEFAULTS.scan_width).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "start", "end", name)))
    return (
        members.withColumn("_rank", rank)
        .withColumn("piece", F.struct(F.col("_rank").alias("stage_rank"), piece.alias("part")))
        .groupBy(*keys, "region_start", "piece")
        .agg(F.array_join(F.transform(ordered, lambda r: r[name]), separator).alias("merged_peaks"))
    )


def split_long(
    df: DataFrame,
    threshold: int = DEFAULTS.split_threshold,
    window: int = DEFAULTS.split_window,
    min_tail: int = DEFAULTS.split_min_tail,
    name: str = "peak",
) -> DataFrame:
    """Cut closed intervals wider than ``threshold`` into ``window`` wide pieces.

    A last piece shorter than ``min_tail`` is joined to the piece before it. Pieces are
    named ``<name>_<n>``; ``orig_peak`` keeps the source name.
    """
    span = F.col("end") - F.col("start") + 1
    full = F.ceil(span / F.lit(window)).cast("int")
    tail = span - (full - 1) * window
    pieces = F.when(span <= threshold, 1).otherwise(
        F.when((full > 1) & (tail < min_tail), full - 1).otherwise(full)
    )
    payload = [c for c in df.columns if c not in ("start", "end", name)]
    piece_start = F.col("_from") + (F.col("_piece") - 1) * window
    piece_end = F.when(F.col("_piece") == F.col("_pieces"), F.col("_to")).otherwise(
        piece_start + (window - 1)
    )
    label = F.when(span > threshold, F.concat_ws("_", F.col(name), F.col("_piece").cast("string")))
    return (
        df.withColumn("_pieces", pieces.cast("int"))
        .withColumn("_piece", F.explode(F.sequence(F.lit(1), F.col("_pieces"))))
        .withColumn("_label", F.coalesce(label, F.col(name)))
        .withColumn("_from", F.col("start"))
        .withColumn("_to", F.col("end"))
        .select(
            *payload,
            piece_start.cast("long").alias("start"),
            piece_end.cast("long").alias("end"),
            F.col("_label").alias(name),
            F.col(name).alias("orig_peak"),
        )
    )


def tile(
    df: DataFrame,
    longer_than: int = DEFAULTS.slice_length,
    window: int = DEFAULTS.slice_window,
    uid: str = "peak_uid",
) -> DataFrame:
    """Slice half-open intervals longer than ``longer_than`` into ``window`` wide tiles.

    Adds ``sub_start, sub_end, sub_order, sub_name, is_sliced``; the last tile may be short.
    """
    long_row = (F.col("end") - F.col("start")) > longer_than
    tiles = F.when(long_row, F.ceil((F.col("end") - F.col("start")) / F.lit(window))).otherwise(1)
    order = F.col("sub_order")
    begin = F.col("start") + (order - 1) * window
    return (
        df.withColumn("is_sliced", long_row)
        .withColumn("sub_order", F.explode(F.sequence(F.lit(1), tiles.cast("int"))))
        .withColumn("sub_start", F.when(F.col("is_sliced"), begin).otherwise(F.col("start")).cast("long"))
        .withColumn(
            "sub_end",
            F.when(F.col("is_sliced"), F.least(begin + window, F.col("end")))
            .otherwise(F.col("end"))
            .cast("long"),
        )
        .withColumn(
            "sub_name",
            F.when(F.col("is_sliced"), F.format_string("%s_sub%04d", F.col(uid), order)).otherwise(
                F.col(uid)
            ),
        )
    )


def make_windows(df: DataFrame, window: int = DEFAULTS.bin_size) -> DataFrame:
    """Fixed-width windows of every interval, payload repeated."""
    payload = [c for c in df.columns if c not in ("start", "end")]
    return df.withColumn(
        "_from", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(window).cast("long")))
    ).select(
        *payload,
        F.col("_from").alias("start"),
        F.least(F.col("_from") + window, F.col("end")).alias("end"),
    )


def flanks(df: DataFrame, near: int = 10, far: int = 200) -> DataFrame:
    """Left and right neighbourhoods ``[start-far, start-near]`` and ``[end+near, end+far]``."""
    payload = [c for c in df.columns if c not in ("start", "end")]
    sides = F.array(
        F.struct(
            F.lit("left").alias("side"),
            (F.col("start") - far).alias("start"),
            (F.col("start") - near).alias("end"),
        ),
        F.struct(
            F.lit("right").alias("side"),
            (F.col("end") + near).alias("start"),
            (F.col("end") + far).alias("end"),
        ),
    )
    return df.select(*payload, F.explode(sides).alias("_side")).select(*payload, "_side.*")


def origin_names(
    rois: DataFrame,
    stage_intervals: DataFrame,
    stages: Sequence[str],
    bin_size: int = DEFAULTS.bin_size,
    width: int = DEFAULTS.scan_width,
) -> DataFrame:
    """Rename regions to ``<stages>_<chrom>:<start>:<end>`` by overlap of the rounded region.

    Rounded coordinates appear in the name only. A region that rounds to zero width
    overlaps nothing.
    """
    rounded = rois.withColumn("_rs", round_to_grid(F.col("start"), bin_size)).withColumn(
        "_re", round_to_grid(F.col("end"), bin_size)
    )
    rounded = count_overlaps(
        rounded, stage_intervals, a_range=("_rs", "_re"), name="_n", by=("stage", stages), width=width
    )
    origin = F.concat_ws("-", *[F.when((F.col("_re") > F.col("_rs")) & (F.col(f"_n_{s}") > 0), F.lit(s)) for s in stages])
    place = F.concat_ws(":", "chrom", F.col("_rs").cast("string"), F.col("_re").cast("string"))
    kept = [c for c in rois.columns if c != "peak"]
    return rounded.select(*kept, F.concat_ws("_", origin, place).alias("peak"))


def _located(
    queries: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    q_range: tuple[str, str],
    pos: str,
    width: int,
) -> DataFrame:
    """Queries with the last point up to their end and the first point from their start."""
    q_start, q_end = (F.col(c) for c in q_range)
    known = points.select(*keys, F.col(pos).cast("long").alias("_pos")).select(
        *keys, "_pos", F.col("_pos").alias("_point")
    )
    asked = queries.select(
        *keys, F.explode(F.array(q_start.cast("long"), q_end.cast("long"))).alias("_pos")
    ).select(*keys, "_pos", F.lit(None).cast("long").alias("_point"))
    positions = known.unionByName(asked).groupBy(*keys, "_pos").agg(F.max("_point").alias("_point"))
    sides = running(
        positions,
        keys,
        "_pos",
        [Running("_left", "max", "_point"), Running("_right", "min", "_point", forward=False)],
        width,
    )
    left = sides.select(*keys, F.col("_pos").alias("_qe"), "_left")
    right = sides.select(*keys, F.col("_pos").alias("_qs"), "_right")
    return (
        queries.withColumn("_qs", q_start.cast("long"))
        .withColumn("_qe", q_end.cast("long"))
        .join(left, [*keys, "_qe"])
        .join(right, [*keys, "_qs"])
    )


def point_distance(
    queries: DataFrame,
    points: DataFrame,
    keys: Sequence[str] = CHROM,
    q_range: tuple[str, str] = ("start", "end"),
    pos: str = "pos",
    name: str = "distance",
    width: int = DEFAULTS.scan_width,
) -> DataFrame:
    """Distance of each closed query to the closest point of its key, 0 inside, NULL without points."""
    located = _located(queries, points, list(keys), q_range, pos, width)
    gap = F.least(F.col("_qs") - F.col("_left"), F.col("_right") - F.col("_qe"))
    return located.select(*queries.columns, F.greatest(gap, F.when(gap.isNotNull(), 0)).alias(name))


def nearest_points(
    queries: DataFrame,
    points: DataFrame,
    keys: Sequence[str] = CHROM,
    q_range: tuple[str, str] = ("start", "end"),
    pos: str = "pos",
    width: int = DEFAULTS.scan_width,
) -> DataFrame:
    """Closest point position of each closed query interval, ties on both sides kept.

    Adds ``near_pos`` and ``distance``. A query that contains points gets one row with
    distance 0 per distinct point inside it, found by ``overlap_join``; other queries get
    the nearest position on the left, the right, or both when equally far.
    """
    keys = list(keys)
    located = _located(queries, points, keys, q_range, pos, width)
    inside = located.filter("_right <= _qe").drop("_left", "_right")
    outside = located.filter("_right is null or _right > _qe")
    distinct_points = points.select(*keys, F.col(pos).cast("long").alias("near_pos")).distinct()
    hits = overlap_join(
        inside,
        distinct_points.withColumn("_pe", F.col("near_pos")),
        keys,
        ("_qs", "_qe"),
        ("near_pos", "_pe"),
        closed=True,
    ).withColumn("distance", F.lit(0).cast("long"))
    gap_left = F.col("_qs") - F.col("_left")
    gap_right = F.col("_right") - F.col("_qe")
    closest = F.least(gap_left, gap_right)
    ties = F.filter(
        F.array(
            F.struct(F.col("_left").alias("p"), gap_left.alias("d")),
            F.struct(F.col("_right").alias("p"), gap_right.alias("d")),
        ),
        lambda s: s["d"] == F.col("_closest"),
    )
    near = (
        outside.withColumn("_closest", closest)
        .withColumn("_tie", F.explode(ties))
        .withColumn("near_pos", F.col("_tie.p"))
        .withColumn("distance", F.col("_tie.d"))
    )
    columns = [*queries.columns, "near_pos", "distance"]
    return hits.select(*columns).unionByName(near.select(*columns))


def matched_loci(
    regions: DataFrame, loci: DataFrame, gene: str = "gene_id", score: str = "pp_h4", least: float = 0.8,
    bucket: int = DEFAULTS.bucket_width,
) -> DataFrame:
    """Region and locus pairs that overlap, name the same gene and reach the score."""
    strong = loci.filter(F.col(score) >= least).select(
        "chrom", gene, F.col("start").alias("b_start"), F.col("end").alias("b_end"), score
    )
    return overlap_join(regions, strong, ["chrom", gene], bucket=bucket)
