"""Dense tracks: one row per position (track, pos from 1, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pieces import scan


def quantize(value: Column, thresholds: list[float]) -> Column:
    """The largest threshold not above the value; an error if there is none."""
    out = F.raise_error(F.lit("value below all thresholds")).cast("double")
    for t in sorted(thresholds):
        out = F.when(value >= t, F.lit(float(t))).otherwise(out)
    return out


def log1p_base(value: Column, base: float) -> Column:
    return F.ln(value + 1) / F.ln(F.lit(base))


def slice_(track: DataFrame, start: int, end: int) -> DataFrame:
    return track.where(F.col("pos").between(start, end)).withColumn("pos", F.col("pos") - start + 1)


def renumber(track: DataFrame) -> DataFrame:
    """Positions 1.. without holes, per track."""
    return scan(track, ("track",), {"_n": ("sum", F.lit(1).cast("bigint"))}).withColumn("pos", F.col("_n")).drop("_n")


def exclude(track: DataFrame, regions: DataFrame) -> DataFrame:
    """Without the positions of the regions (start, end), renumbered. Regions are spread over their positions."""
    gone = regions.select(F.explode(F.expr("sequence(start, end)")).alias("pos")).distinct()
    return renumber(track.join(gone, "pos", "left_anti").select(*track.columns))


def prune_joint(tracks: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Positions where some track is above its threshold (-1000 and less: the track has no say), renumbered."""
    vote = F.lit(False)
    for name, t in thresholds.items():
        if t > -1000:
            vote = vote | ((F.col("track") == name) & (F.col("value") > t))
    kept = tracks.where(vote).select("pos").distinct()
    return renumber(tracks.join(kept, "pos", "left_semi").select(*tracks.columns))


def shift(track: DataFrame, by: int, length: int) -> DataFrame:
    """Circular shift of a track of the given length."""
    return track.withColumn("pos", (F.col("pos") - 1 + by) % length + 1)


def permute_blocks(track: DataFrame, block: int, length: int, seed: int) -> DataFrame:
    """Whole blocks of the track in another order, by a hash of seed and block; a rest shorter than a block drops out."""
    n = length // block
    hashed = track.sparkSession.range(n).select(F.col("id").alias("_b"), F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))).alias("_h")).withColumn("_g", F.substring("_h", 1, 3))
    # ranked in 4096 ranges of the hash, and the counts of the ranges before are added
    before = hashed.groupBy("_g").agg(F.count("*").alias("_c")).select("_g", F.coalesce(F.sum("_c").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    order = hashed.join(before, "_g").select("_b", (F.col("_o") + F.row_number().over(W.partitionBy("_g").orderBy("_h", "_b"))).alias("_to"))
    at = track.withColumn("_b", F.expr(f"(pos - 1) div {block}"))
    return at.join(order, "_b").select("track", ((F.col("_to") - 1) * block + (F.col("pos") - 1) % block + 1).alias("pos"), "value")


def extrema(track: DataFrame) -> DataFrame:
    return track.groupBy("track").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def runs(track: DataFrame, keep: Column, keep_last: bool = False) -> DataFrame:
    """Maximal runs of neighbouring positions that ``keep`` (of value) holds for. One that reaches the track's last position is
    left out unless ``keep_last``."""
    last = track.groupBy("track").agg(F.max("pos").alias("_last"))
    island = scan(track.where(keep), ("track",), {"_n": ("sum", F.lit(1).cast("bigint"))}).withColumn("_k", F.col("pos") - F.col("_n"))
    found = island.groupBy("track", "_k").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("_k")
    return found if keep_last else found.join(last, "track").where("end < _last").drop("_last")


def peaks(track: DataFrame, threshold: float) -> DataFrame:
    return runs(track, F.col("value") >= threshold)


def valleys(track: DataFrame, threshold: float) -> DataFrame:
    return runs(track, F.col("value") <= threshold)


def run_lengths(track: DataFrame) -> DataFrame:
    """Runs of equal values (start, end, value)."""
    last = scan(track.select("track", "pos", "value"), ("track",), {"_last": ("max", F.struct("pos", "value"))}, itself=False)
    opens = F.coalesce(F.col("value") != F.col("_last.value"), F.lit(True))
    return scan(last, ("track",), {"start": ("max", F.when(opens, F.col("pos")))}).groupBy("track", "start", "value").agg(F.max("pos").alias("end"))
