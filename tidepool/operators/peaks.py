"""Enriched runs at every height threshold, their counts, and stitching across windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import regions
from .pieces import scan
from .staged import dealt, staged

MAX_THRESHOLD = 1000


def all_threshold_peaks(profile: DataFrame, gap: int, max_threshold: int = MAX_THRESHOLD) -> DataFrame:
    """chrom, thr, start, end of the maximal runs with height >= thr, runs up to ``gap`` apart merged.

    Only crossings of thresholds are made rows, twice the number of fragments at most. A chromosome falls apart into
    stretches wherever the height is 0 for ``gap`` positions or more; no peak reaches over such a hole, so windows are
    partitioned by stretch and stay short. Crossings are dealt by their number.
    """
    profile = staged(profile, "profile")
    low, high = F.least("height", "prev_height"), F.least(F.greatest("height", "prev_height"), F.lit(max_threshold).cast("bigint"))
    crossed = profile.agg(F.sum(F.greatest(high - low, F.lit(0)))).first()[0] or 0
    hole = (F.col("prev_height") == 0) & (F.col("prev_pos").isNull() | (F.col("pos") - F.col("prev_pos") >= gap))
    cut = scan(profile, ("chrom",), {"_stretch": ("sum", hole.cast("bigint"))})
    up = F.col("height") > F.col("prev_height")
    crossings = cut.where(low < max_threshold).select("chrom", "_stretch", "pos", up.alias("up"), F.explode(F.sequence(low + 1, high)).alias("thr"))
    by = W.partitionBy("chrom", "_stretch", "thr")
    runs = dealt(crossings, crossed, "chrom", "_stretch", "thr").withColumn("e", F.lead("pos").over(by.orderBy("pos")) - 1).where("up")
    return merge_runs(runs.select("chrom", "_stretch", "thr", F.col("pos").alias("s"), "e"), ["chrom", "_stretch", "thr"], gap).drop("_stretch")


def merge_runs(runs: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Runs (s, e) that do not overlap: one that starts no more than ``gap`` after the end before it joins that one."""
    by = W.partitionBy(*keys)
    opened = runs.withColumn("_new", F.coalesce((F.col("s") > F.lag("e").over(by.orderBy("s")) + gap).cast("int"), F.lit(1)))
    numbered = opened.withColumn("_k", F.sum("_new").over(by.orderBy("s").rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_k").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("_k")


def counts_per_window(peaks: DataFrame, window: int) -> DataFrame:
    """A peak counts in each window it touches."""
    wins = F.explode(F.expr(f"sequence(start div {window}, end div {window})"))
    return peaks.select("chrom", "thr", wins.alias("win")).groupBy("chrom", "thr", "win").agg(F.count("*").alias("n"))


def peaks_in_range(peaks: DataFrame, low: int, high: int) -> DataFrame:
    return peaks.where((F.col("start") <= high) & (F.col("end") >= low)).groupBy("chrom", "thr").agg(F.count("*").alias("n"))


def stitch(peaks: DataFrame, win_thr: DataFrame, gap: int, window: int) -> DataFrame:
    """Regions: in each window the peaks of its threshold, clipped to it, and joined over window borders by the gap rule.

    Windows are joined on (chrom, thr, win); the clipped peaks are merged as regions are, piece by piece of a chromosome.
    """
    touched = peaks.select("*", F.explode(F.expr(f"sequence(start div {window}, end div {window})")).alias("win"))
    pieces = touched.join(win_thr.where("thr > 0"), ["chrom", "thr", "win"]).select("chrom", F.greatest(F.col("start"), F.col("win") * window).alias("start"), F.least(F.col("end"), (F.col("win") + 1) * window - 1).alias("end"))
    return regions.merge(pieces, gap - 1)
