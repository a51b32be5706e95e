"""Ranges of whole numbers as dyadic intervals: a join key for points in ranges.

Level n cuts the numbers into intervals of 2 ** n. A range is the union of at most two of
them a level; a point lies in one of each level, so points and ranges meet by equality.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 48


def _down(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def cover(lo: Column, hi: Column) -> Column:
    """array(struct(level, at)): the fewest intervals that make up ``lo .. hi`` (both 0 or more); none where ``lo > hi``."""
    lo, end = lo.cast("long"), hi.cast("long") + 1

    def of_level(n: Column) -> Column:
        first, last = -_down(-lo, n), _down(end, n)  # whole intervals first .. last - 1
        take = lambda keep, at: F.when((first < last) & keep, F.struct(n.alias("level"), at.alias("at")))
        return F.array(take(first % 2 == 1, first), take(last % 2 == 1, last - 1))

    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of_level))
    return F.array_distinct(F.filter(pieces, lambda p: p.isNotNull()))


def places(x: Column, levels: Column) -> Column:
    """array(struct(level, at)): the interval of each level that holds ``x``."""
    return F.transform(levels, lambda n: F.struct(n.alias("level"), _down(x.cast("long"), n).alias("at")))
