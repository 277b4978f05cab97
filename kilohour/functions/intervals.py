"""Points and intervals of whole numbers that meet in an equi-join, however long the intervals are.

An interval is covered by dyadic ranges, those of 2^l neighbouring numbers that start at a multiple of 2^l: two a level at most,
so O(log n) rows. A point lies in one range of each level. Interval and point meet exactly once, in the one covering range that
holds the point. A point's rows are dealt over ``salts``, an interval's row goes to one, so many intervals over one stretch of
numbers spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 32


def cover(low: Column, high: Column, top: int = TOP) -> Column:
    """Array of (level, range) whose disjoint union is [low, high]; empty if low > high or either is null.

    Above level ``top`` nothing is merged, so an interval longer than 2^top takes a row for each 2^top on top.
    """
    pieces = []
    for level in range(top + 1):
        first = F.shiftright(low + (2**level - 1), level)
        last = F.shiftright(high + 1, level) - 1
        there = first <= last
        if level == top:
            rest = F.when(there, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
            pieces.append(F.transform(rest, lambda i: F.struct(F.lit(top).alias("level"), i.alias("range"))))
            break
        # a range belongs to the cover if the one twice as long around it reaches beyond the interval
        left = F.when(there & (F.pmod(first, F.lit(2)) == 1), F.struct(F.lit(level).alias("level"), first.alias("range")))
        right = F.when(there & (F.pmod(last, F.lit(2)) == 0), F.struct(F.lit(level).alias("level"), last.alias("range")))
        pieces.append(F.array_compact(F.array(left, right)))
    whole = F.concat(*pieces)
    return F.when(low.isNotNull() & high.isNotNull(), whole).otherwise(F.array_compact(F.array(F.lit(None).cast("struct<level:int,range:bigint>"))))


def holders(point: Column, top: int = TOP) -> Column:
    """Array of (level, range), one a level, that hold the point."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(point, level).alias("range")) for level in range(top + 1)])


def meet(
    points: DataFrame, intervals: DataFrame, *, point: Column, low: Column, high: Column, salt: Sequence[str] = (), salts: int = 4, top: int = TOP
) -> DataFrame:
    """Every point beside every interval [low, high] that holds it, with the columns of both (names must differ).

    ``salt`` names the interval columns that are dealt by. Null points and borders meet nothing.
    """
    dealt = F.pmod(F.xxhash64(*salt), F.lit(salts)) if salt else F.lit(0).cast("long")
    covered = intervals.withColumn("_salt", dealt).withColumn("_r", F.explode(cover(low.cast("long"), high.cast("long"), top)))
    copies = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1 if salt else 0).cast("long"))
    spread = points.where(point.isNotNull()).withColumn("_r", F.explode(holders(point.cast("long"), top))).withColumn("_salt", F.explode(copies))
    keys = ["_level", "_range", "_salt"]
    flat = [d.withColumn("_level", F.col("_r.level")).withColumn("_range", F.col("_r.range")).drop("_r") for d in (spread, covered)]
    return flat[0].join(flat[1], keys).drop(*keys)
