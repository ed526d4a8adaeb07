"""Small column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero or missing denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def rounded(column: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return (F.round(column.cast("double"), digits) + F.lit(0.0))


def clipped(column: Column, low: Column, high: Column) -> Column:
    """Value limited to [low, high]; NULL stays NULL."""
    return F.when(column.isNotNull(), F.least(F.greatest(column, low), high))


def round_to_grid(position: Column, step: int) -> Column:
    """Nearest multiple of ``step``, ties to the even multiple."""
    return (F.bround(position / F.lit(step)) * F.lit(step)).cast("long")


def floor_to_grid(position: Column, step: int) -> Column:
    return F.floor(position / F.lit(step)).cast("long")


def ceil_to_grid(position: Column, step: int) -> Column:
    return F.ceil(position / F.lit(step)).cast("long")
