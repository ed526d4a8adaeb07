"""Kernel density curves and surfaces: linear binning, then convolution inside a window.

Each row adds its weight to the grid points beside it, which map tasks combine, so all later
work is on the grid. Bandwidths come from exact quartiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.operators.ranks import attach, quantile_table
from binloom.session import cut_lineage

#: Bandwidths beyond which a normal kernel adds nothing in double precision.
REACH = 8.5


def bandwidths(df: DataFrame, keys: Sequence[str], value: str, factor: float = 0.9) -> DataFrame:
    """Per key ``n``, ``low``, ``high`` and ``bw``, by the rule of thumb for normal kernels.

    ``factor * min(sd, IQR / 1.34) * n ** -0.2``; where that is 0 the standard deviation,
    then the size of the least value, then 1 takes the place of the spread.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    totals = known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd"),
    )
    quartiles = quantile_table(known, keys, value, {"_q1": 0.25, "_q3": 0.75})
    found = attach(totals, quartiles, list(keys))
    spread = F.least("_sd", (F.col("_q3") - F.col("_q1")) / 1.34)
    first = lambda *options: F.coalesce(*[F.when(o > 0, o) for o in options], F.lit(1.0))
    bw = F.lit(factor) * first(spread, F.col("_sd"), F.abs("low")) * F.pow(F.col("n"), -0.2)
    return found.select(*keys, "n", "low", "high", bw.alias("bw"))


def _beside(place: Column) -> Column:
    """The grid points beside a place, with the weight that each gets."""
    left = F.floor(place)
    part = place - left
    return F.array(F.struct(left.alias("at"), (1.0 - part).alias("w")), F.struct((left + 1).alias("at"), part.alias("w")))


def _smoothed(bins: DataFrame, keys: Sequence[str], at: str, ratio: str, points: int) -> DataFrame:
    """Convolution of ``w`` along ``at`` with a normal kernel; ``ratio`` is bandwidth by step."""
    reach = F.least(F.ceil(F.col(ratio) * REACH), F.lit(points)).cast("long")
    spread = bins.withColumn("_d", F.explode(F.sequence(-reach, reach)))
    z = F.col("_d") / F.col(ratio)
    kernel = F.exp(-z * z / 2.0) / (F.sqrt(F.lit(2.0) * F.pi()) * F.col(ratio))
    moved = spread.withColumn(at, F.col(at) + F.col("_d")).where(F.col(at).between(0, points - 1))
    return moved.groupBy(*keys, at).agg(F.sum(F.col("w") * kernel).alias("w"))


def density_curve(df: DataFrame, keys: Sequence[str], value: str, points: int = 512, cut: float = 3.0, adjust: float = 1.0) -> DataFrame:
    """Density of ``value`` per key on a grid: ``at`` (0 to points - 1), ``x``, ``density``.

    The grid reaches ``cut`` bandwidths beyond the data; ``adjust`` stretches the bandwidth.
    Nulls and NaN are left out; a key without values has no rows.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    shape = bandwidths(known, keys, "_v").withColumn("bw", F.col("bw") * adjust)
    shape = cut_lineage(
        shape.withColumn("start", F.col("low") - cut * F.col("bw"))
        .withColumn("step", (F.col("high") - F.col("low") + 2 * cut * F.col("bw")) / (points - 1))
        .withColumn("ratio", F.col("bw") / F.col("step")).drop("low", "high")
    )
    placed = attach(known, shape, keys)
    cells = placed.select(*keys, F.inline(_beside((F.col("_v") - F.col("start")) / F.col("step"))), (1.0 / F.col("n")).alias("_share"))
    bins = cut_lineage(cells.groupBy(*keys, "at").agg(F.sum(F.col("w") * F.col("_share")).alias("w")))
    smooth = _smoothed(attach(bins, shape, keys), keys, "at", "ratio", points)
    grid = shape.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(points - 1)).cast("array<bigint>")))
    found = grid.join(smooth, [*keys, "at"], "left")
    return found.select(
        *keys, "at", (F.col("start") + F.col("at") * F.col("step")).alias("x"), (F.coalesce("w", F.lit(0.0)) / F.col("step")).alias("density")
    )


def density_surface(df: DataFrame, x: str, y: str, points: int = 64, cut: float = 0.0) -> DataFrame:
    """Density of (x, y) on a square grid: ``i``, ``j``, ``x``, ``y``, ``density``.

    A product of two normal kernels, each with the bandwidth of its own axis (factor 1.06);
    the kernel is applied along one axis after the other. Rows with a null or NaN are left out.
    """
    usable = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (x, y)]
    known = df.where(usable[0] & usable[1]).select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    sides = {}
    for side in ("_x", "_y"):
        row = bandwidths(known, [], side, 1.06).first()
        if row is None or not row["n"]:
            return known.select(*[F.lit(0).cast("long").alias(c) for c in "ij"], *[F.lit(0.0).alias(c) for c in ("x", "y", "density")]).limit(0)
        start, span = row["low"] - cut * row["bw"], row["high"] - row["low"] + 2 * cut * row["bw"]
        sides[side] = (start, (span or 1.0) / (points - 1), row["bw"], row["n"])
    place = {s: (F.col(s) - sides[s][0]) / sides[s][1] for s in sides}
    cells = known.select(F.inline(_beside(place["_x"])), F.col("_y")).withColumnsRenamed({"at": "i", "w": "_wi"})
    cells = cells.select("i", "_wi", F.inline(_beside(place["_y"]))).withColumnRenamed("at", "j")
    n = sides["_x"][3]
    bins = cut_lineage(cells.groupBy("i", "j").agg((F.sum(F.col("_wi") * F.col("w")) / n).alias("w")))
    ratios = {s: F.lit(sides[s][2] / sides[s][1]).alias("ratio") for s in sides}
    along = _smoothed(bins.select("*", ratios["_x"]), ["j"], "i", "ratio", points)
    both = _smoothed(along.select("*", ratios["_y"]), ["i"], "j", "ratio", points)
    grid = df.sparkSession.range(points * points).select((F.col("id") % points).alias("i"), F.floor(F.col("id") / points).alias("j"))
    area = sides["_x"][1] * sides["_y"][1]
    at = lambda s, c: (F.lit(sides[s][0]) + F.col(c) * sides[s][1])
    return grid.join(both, ["i", "j"], "left").select(
        "i", "j", at("_x", "i").alias("x"), at("_y", "j").alias("y"), (F.coalesce("w", F.lit(0.0)) / area).alias("density")
    )
