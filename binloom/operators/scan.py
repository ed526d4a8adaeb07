"""Ordered scans that never gather a whole key in one task.

A running value over ``(keys, position)`` is computed in two levels: a window inside
fixed-width position chunks, and a window over one summary row per chunk whose result
is carried back into the chunks. Inputs are pre-aggregated to one row per position, so
a chunk holds at most ``width`` rows however many rows share its key, and the number of
chunks of a key is bounded by the coordinate range divided by ``width``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

CHUNK = "_chunk"


@dataclass(frozen=True)
class Running:
    """One running value: ``func`` over ``source`` in position order.

    ``forward=False`` scans from the largest position down; ``inclusive=False`` leaves
    out the current row. ``last`` keeps the most recent non-null value.
    """

    name: str
    func: str
    source: str
    forward: bool = True
    inclusive: bool = True

    def aggregate(self) -> Column:
        if self.func == "last":
            raise ValueError("last has no order-free aggregate")
        return getattr(F, self.func)(self.source)

    def over(self, source: str, window) -> Column:
        if self.func == "last":
            return F.last(source, ignorenulls=True).over(window)
        return getattr(F, self.func)(source).over(window)

    def combine(self, own: Column, carried: Column) -> Column:
        if self.func == "sum":
            zero = F.lit(0)
            return F.coalesce(own, zero) + F.coalesce(carried, zero)
        if self.func == "max":
            return F.greatest(own, carried)
        if self.func == "min":
            return F.least(own, carried)
        return F.coalesce(own, carried)


def position_chunk(position: str | Column, width: int) -> Column:
    """Chunk number of an integer position."""
    column = F.col(position) if isinstance(position, str) else position
    return F.floor(column / F.lit(width)).cast("long")


def with_value_chunk(df: DataFrame, value: str, chunks: int = 256) -> DataFrame:
    """Add the chunk column for a floating value from approximate quantiles of the column.

    The split points are one scalar sub-query; a fixed-depth bisection finds the chunk.
    """
    depth = max(1, (chunks - 1).bit_length())
    size = 1 << depth
    probs = [i / size for i in range(1, size)]
    splits = df.agg(
        F.percentile_approx(F.col(value).cast("double"), F.array(*map(F.lit, probs)), 8 * size)
    ).scalar()
    steps = F.array(*[F.lit(1 << (depth - 1 - i)) for i in range(depth)])
    place = F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(
            F.get(F.col("_splits"), low + step - 1) < F.col(value), low + step
        ).otherwise(low),
    )
    return df.withColumn("_splits", splits).withColumn(CHUNK, place.cast("long")).drop("_splits")


def joinable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without null in ``columns``, the only ones that an inner join on them lets through.

    Said before a frame is used twice, both uses read the same rows, and Spark shuffles these once.
    """
    return df.filter(" and ".join(f"`{c}` is not null" for c in columns))


def running(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    specs: Sequence[Running],
    width: int = 65_536,
    keep_chunk: bool = False,
) -> DataFrame:
    """Add the running values of ``specs`` to ``df``, which has one row per (keys, position).

    Rows without a key or position go. Only chunks that others come before in scan order are
    carried into, so keys of one chunk cost no second shuffle. ``df`` is shuffled once for both
    levels as long as ``specs`` name all its columns.

    ``keep_chunk`` leaves the chunk column in the result; a following scan over the same
    keys then finds its rows already partitioned.
    """
    keys = list(keys)
    group = keys + [CHUNK]
    if CHUNK in df.columns:
        frame = joinable(df, group)
    else:
        frame = joinable(df.withColumn(CHUNK, position_chunk(position, width)), group).repartition(*group)
    kept = [c for c in df.columns if c != CHUNK] + ([CHUNK] if keep_chunk else [])
    orders = {True: F.col(position).asc(), False: F.col(position).desc()}

    def inner(spec: Running):
        end = 0 if spec.inclusive else -1
        base = Window.partitionBy(*group).orderBy(orders[spec.forward])
        return base.rowsBetween(Window.unboundedPreceding, end)

    local = frame.select(
        "*", *[spec.over(spec.source, inner(spec)).alias(f"_in_{spec.name}") for spec in specs]
    )
    totals = []
    for spec in specs:
        if spec.func == "last":
            ordered = F.when(F.col(spec.source).isNotNull(), F.struct(position, spec.source))
            picked = F.max(ordered) if spec.forward else F.min(ordered)
            totals.append(picked[spec.source].alias(f"_sum_{spec.name}"))
        else:
            totals.append(spec.aggregate().alias(f"_sum_{spec.name}"))
    chunk_orders = {True: F.col(CHUNK).asc(), False: F.col(CHUNK).desc()}
    outer = keys or [F.lit(0)]

    def across(spec: Running):
        base = Window.partitionBy(*outer).orderBy(chunk_orders[spec.forward])
        return base.rowsBetween(Window.unboundedPreceding, -1)

    carries = (
        frame.groupBy(*group)
        .agg(*totals)
        .select(
            *group,
            *[
                spec.over(f"_sum_{spec.name}", across(spec)).alias(f"_carry_{spec.name}")
                for spec in specs
            ],
        )
        .filter(" or ".join(f"`_carry_{spec.name}` is not null" for spec in specs))
    )
    joined = local.join(carries, group, "left")
    return joined.select(
        *kept,
        *[
            spec.combine(F.col(f"_in_{spec.name}"), F.col(f"_carry_{spec.name}")).alias(spec.name)
            for spec in specs
        ],
    )
