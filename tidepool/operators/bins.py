"""Interval index: joins of overlapping intervals through bins of several sizes.

Bins double three times from level to level. An interval's level is the first whose bins are as long as itself, so it touches two
of them at most, whatever its length: these are its home. Two intervals that overlap meet at the higher of their two levels,
where one is at home and the other is looked up, and count in the bin where their overlap begins. So short intervals are never
spread for the sake of long ones, and a chromosome-long interval is two rows instead of thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a position within a bin of level 0, bits per level, and levels.
BITS, STEP, LEVELS = 14, 3, 17
#: Intervals of the upper levels that are broadcast at most.
FEW = 250_000


def level_of(length: Column) -> Column:
    """The first level whose bins are as long as that."""
    return F.size(F.filter(F.array(*(F.lit(1 << (BITS + STEP * i)) for i in range(LEVELS - 1))), lambda size: size < length))


def _bin(c: str, level: str) -> str:
    return f"shiftright({c}, {BITS} + {STEP} * {level})"


def _entries(side: DataFrame, a: str, b: str, levels: Column | None) -> DataFrame:
    """side with _level and _bin: a row per touched bin at its home level, or at each of the levels at or above it."""
    own = level_of(F.col(b) - F.col(a) + 1)
    at = side.withColumn("_level", own if levels is None else F.explode(F.filter(levels, lambda x: x >= own)))
    return at.withColumn("_bin", F.explode(F.expr(f"sequence({_bin(a, '_level')}, {_bin(b, '_level')})")))


def _levels(side: DataFrame, a: str, b: str) -> list[int]:
    return sorted(r[0] for r in side.select(level_of(F.col(b) - F.col(a) + 1)).distinct().collect() if r[0] is not None)  # LEVELS at most


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, a2: str, b2: str) -> DataFrame:
    """Rows of left and right, equal in ``on``, whose intervals [a, b] and [a2, b2] (longs) overlap, each pair once.

    Column names other than ``on`` differ between the sides. Both sides are read for their levels first, so they should be tables
    or cheap to make. Homes of the upper levels are broadcast if they are few; then long intervals cost no shuffle at all.
    Intervals with a null bound, or that end before they start, meet nothing.
    """
    left, right = left.where(F.col(a) <= F.col(b)), right.where(F.col(a2) <= F.col(b2))
    ours, theirs = _levels(left, a, b), _levels(right, a2, b2)
    keys, once = [*on, "_level", "_bin"], F.expr(f"{a} <= {b2} AND {a2} <= {b} AND {_bin(f'greatest({a}, {a2})', '_level')} = _bin")
    columns = [*on, *(c for c in left.columns if c not in on), *(c for c in right.columns if c not in on)]
    array = lambda levels: F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    parts = []
    if theirs:
        # at the right one's home: the left one's level is the same or lower; the lowest bins apart, as these are many
        homes, looks = _entries(right, a2, b2, None), lambda levels: _entries(left, a, b, array(levels))
        parts.append(looks([x for x in theirs if x == 0]).join(homes.where("_level = 0"), keys))
        if upper := [x for x in theirs if x > 0]:
            shared = looks(upper).repartition(3 * left.sparkSession.sparkContext.defaultParallelism, *on, a, b)
            parts.append(shared.join(_upper(homes), keys))
        if upper := [x for x in ours if x > theirs[0]]:
            # at the left one's home, which is higher than the right one's
            strictly = _entries(right.withColumn("_own", level_of(F.col(b2) - F.col(a2) + 1)), a2, b2, array(upper)).where("_level > _own").drop("_own")
            # a small table is few tasks, but each of its rows may meet thousands of long ones: all cores share them
            shared = strictly.repartition(3 * left.sparkSession.sparkContext.defaultParallelism, *on, a2, b2)
            parts.append(shared.join(_upper(_entries(left, a, b, None)), keys))
    if not parts:
        return left.join(right, on).where("false").select(*columns)
    out = parts[0].where(once).select(*columns)
    for more in parts[1:]:
        out = out.union(more.where(once).select(*columns))
    return out


def _upper(homes: DataFrame) -> DataFrame:
    high = homes.where("_level > 0")
    return high.hint("broadcast") if high.limit(FEW + 1).count() <= FEW else high
