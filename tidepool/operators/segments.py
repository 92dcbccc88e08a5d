"""Tracks as disjoint segments (track, start, end, value), from 1 and inclusive; positions in no segment have no value.

The same algebra as on dense tracks, at the cost of the segments and not of the positions: a genome of 3 * 10**9 positions at
one value is one row. Results are joined: touching segments of equal value are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import regions
from .pieces import scan

#: Positions that are painted together at most.
PIECE = 1 << 20
_KEYS, _ORDER = ("track",), {"pos": "start"}


def joined(segments: DataFrame) -> DataFrame:
    """Touching segments of equal value as one."""
    last = scan(segments.select("track", "start", "end", "value"), _KEYS, {"_last": ("max", F.struct("start", "end", "value"))}, itself=False, **_ORDER)
    opens = F.col("_last").isNull() | (F.col("_last.end") + 1 != F.col("start")) | ~F.col("_last.value").eqNullSafe(F.col("value"))
    first = scan(last, _KEYS, {"_first": ("max", F.when(opens, F.col("start")))}, **_ORDER)
    return first.groupBy("track", F.col("_first").alias("start"), "value").agg(F.max("end").alias("end")).select("track", "start", "end", "value")


def from_dense(track: DataFrame) -> DataFrame:
    return joined(track.select("track", F.col("pos").alias("start"), F.col("pos").alias("end"), "value"))


def to_dense(segments: DataFrame) -> DataFrame:
    return segments.select("track", F.explode(F.sequence("start", "end")).alias("pos"), "value")


def _painted(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint stretches (first, end behind it) and the interval on top of each. Later intervals lie on top; each of the stretches
    between borders is taken once, by the topmost interval that reaches it."""
    borders = np.unique(np.concatenate([starts, ends]))
    lows, highs = np.searchsorted(borders, starts).tolist(), np.searchsorted(borders, ends).tolist()
    free, owner = list(range(len(borders))), np.full(len(borders), -1, np.int64)  # free: the next stretch not taken yet

    def find(i: int) -> int:
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return i

    for k in range(len(starts) - 1, -1, -1):
        i = find(lows[k])
        while i < highs[k]:
            owner[i] = k
            free[i] = i + 1
            i = find(i + 1)
    taken = np.flatnonzero(owner >= 0)
    return borders[taken], borders[taken + 1], owner[taken]


def paint(lines: DataFrame, place: list[str], piece: int = PIECE) -> DataFrame:
    """Segments of lines (track, start, end, value) that may overlap: where they do, the later one by ``place`` (columns) wins.

    Lines are clipped to pieces of positions. Of lines with the same borders only the last counts, before they meet, so piles of
    lines stay small. Within a piece stretches between borders are taken from the last line backwards.
    """
    at = lines.withColumn("_p", F.explode(F.expr(f"sequence(start div {piece}, end div {piece})")))
    low, high = F.greatest(F.col("start"), F.col("_p") * piece), F.least(F.col("end"), (F.col("_p") + 1) * piece - 1)
    clipped = at.select("track", "_p", low.alias("_s"), (high + 1).alias("_e"), F.struct(*place).alias("_at"), "value")
    tops = clipped.groupBy("track", "_p", "_s", "_e").agg(F.max(F.struct("_at", "value")).alias("_t")).select("track", "_p", "_s", "_e", "_t._at", F.col("_t.value").cast("double").alias("value"))

    def sweep(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).select(["_at", "_s", "_e", "value"])
        t = t.flatten().sort_by([(f"_at.{c}", "ascending") for c in place])
        first, behind, owner = _painted(t.column("_s").to_numpy(), t.column("_e").to_numpy())
        yield pa.record_batch([pa.array([key[0].as_py()] * len(first), pa.string()), pa.array(first), pa.array(behind - 1), t.column("value").combine_chunks().take(pa.array(owner))], names=["track", "start", "end", "value"])

    return joined(tops.groupBy("track", "_p").applyInArrow(sweep, "track string, start long, end long, value double"))


def _swept(segments: DataFrame, areas: DataFrame) -> DataFrame:
    """segments cut at the borders of areas (track, start, end), with _depth, the number of areas that hold each part."""
    nothing = F.lit(None).cast(segments.select(F.struct("start", "end", "value").alias("s")).schema[0].dataType)
    own = segments.select("track", F.explode(F.array(F.struct(F.col("start").alias("at"), F.struct("start", "end", "value").alias("seg")), F.struct((F.col("end") + 1).alias("at"), nothing.alias("seg")))).alias("m"), F.lit(0).alias("d")).select("track", "m.at", "m.seg", "d")
    other = areas.select("track", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("d")))).alias("m")).select("track", "m.at", nothing.alias("seg"), "m.d")
    borders = own.union(other).groupBy("track", "at").agg(F.max("seg").alias("seg"), F.sum("d").alias("d"))
    told = scan(borders, _KEYS, {"_seg": ("max", F.col("seg")), "_depth": ("sum", F.col("d")), "_next": ("min", F.col("at"), {"itself": False, "after": True})}, pos="at")
    held = told.where("_seg IS NOT NULL AND at <= _seg.end")
    return held.select("track", F.col("at").alias("start"), F.least(F.col("_next") - 1, F.col("_seg.end")).alias("end"), F.col("_seg.value").alias("value"), "_depth")


def outside(segments: DataFrame, areas: DataFrame) -> DataFrame:
    """What lies in none of the areas (track, start, end)."""
    return _swept(segments, areas).where("_depth = 0").drop("_depth")


def inside(segments: DataFrame, areas: DataFrame) -> DataFrame:
    return _swept(segments, areas).where("_depth > 0").drop("_depth")


def renumbered(segments: DataFrame) -> DataFrame:
    """Positions from 1 on without holes, per track: a segment begins behind the lengths of those before it."""
    length = F.col("end") - F.col("start") + 1
    told = scan(segments, _KEYS, {"_n": ("sum", length)}, itself=False, **_ORDER)
    return joined(told.select("track", (F.col("_n") + 1).alias("start"), (F.col("_n") + length).alias("end"), "value"))


def exclude(segments: DataFrame, areas: DataFrame) -> DataFrame:
    """Without the positions of the areas (track, start, end), renumbered."""
    return renumbered(outside(segments, areas))


def prune_joint(segments: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Positions where some track is above its threshold (-1000 and less: the track has no say), of all named tracks, renumbered."""
    vote = F.lit(False)
    for name, t in thresholds.items():
        if t > -1000:
            vote = vote | ((F.col("track") == name) & (F.col("value") > t))
    kept = regions.merge(segments.where(vote).select(F.lit("").alias("chrom"), "start", "end"))
    named = kept.select(F.explode(F.array(*map(F.lit, thresholds))).alias("track"), "start", "end")
    return renumbered(inside(segments.where(F.col("track").isin(*thresholds)), named))


def shift(segments: DataFrame, by: int, length: int) -> DataFrame:
    """Circular shift of tracks of the given length; a segment that would reach over the end is two."""
    start = (F.col("start") - 1 + by) % length + 1
    end = start + F.col("end") - F.col("start")
    moved = segments.select("track", start.alias("_s"), end.alias("_e"), "value")
    part = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    cut = F.when(F.col("_e") > length, F.array(part(F.col("_s"), F.lit(length)), part(F.lit(1), F.col("_e") - length))).otherwise(F.array(part(F.col("_s"), F.col("_e"))))
    return joined(moved.select("track", F.inline(cut), "value"))


def runs(segments: DataFrame, keep: Column, least: int = 1, keep_last: bool = False) -> DataFrame:
    """Maximal runs (track, start, end) of ``least`` positions or more that ``keep`` (of value) holds for. One that reaches a track's
    last position is left out unless ``keep_last``."""
    found = joined(segments.where(keep).withColumn("value", F.lit(1.0))).where(F.col("end") - F.col("start") + 1 >= least).drop("value")
    if keep_last:
        return found
    return found.join(segments.groupBy("track").agg(F.max("end").alias("_last")), "track").where("end < _last").drop("_last")
