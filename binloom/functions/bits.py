"""Runs, overlaps and positions of 0/1 vectors packed into long bit masks.

Bit ``i`` of a mask is the value of bin ``i``. A word covers 32 bins, so words are
non-negative; a region mask covers up to 62 bins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 32
REGION_BITS = 62


def low_bits(count: Column) -> Column:
    """Mask of the ``count`` lowest bits, for 0 <= count <= 62."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), count.cast("int")) - F.lit(1)


def run_start_bits(mask: Column) -> Column:
    return mask.bitwiseAND(F.bitwise_not(F.shiftleft(mask, 1)))


def run_end_bits(mask: Column) -> Column:
    return mask.bitwiseAND(F.bitwise_not(F.shiftright(mask, 1)))


def set_positions(mask: Column, width: int = WORD) -> Column:
    """Array of the positions of the set bits, ascending."""
    index = F.sequence(F.lit(0), F.lit(width - 1))
    return F.filter(index, lambda i: F.expr("1L").bitwiseAND(_shift_right(mask, i)) == 1)


def _shift_right(mask: Column, by: Column) -> Column:
    return F.call_function("shiftright", mask, by)


def shifted(mask: Column, by: Column) -> Column:
    """Mask moved up by ``by`` bins, or down when ``by`` is negative."""
    up = F.call_function("shiftleft", mask, by.cast("int"))
    down = F.call_function("shiftright", mask, (-by).cast("int"))
    return F.when(by >= 0, up).otherwise(down)
