"""Scores of regions: interval counts, binomial tail, enrichment, summit, and q-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bins import overlap_join
from .staged import staged, tasks_for

#: Copies that count per position, regions above this length are not widened, and the widening.
COPIES, LONG_REGION, WIDEN = 3, 1000, 2000


def count_in_regions(regions: DataFrame, starts: DataFrame, ext: int, widen: int = 0) -> DataFrame:
    """regions with n_chip and n_ctrl: reads (3 copies of a position at most) whose fragment of ``ext`` touches the region.

    starts: sample, chrom, start, c (reads there).
    """
    low = F.when(F.col("start") > widen, F.col("start") - widen).otherwise(F.lit(1)) if widen else F.col("start")
    wide = regions.select("chrom", "start", "end", (low - ext).cast("bigint").alias("_a"), (F.col("end") + widen).cast("bigint").alias("_b"))
    reads = starts.select("chrom", F.col("start").cast("bigint").alias("_s"), F.col("start").cast("bigint").alias("_e"), "sample", F.least("c", F.lit(COPIES)).alias("_c"))
    met = overlap_join(wide, reads, ["chrom"], "_a", "_b", "_s", "_e")
    total = lambda s: F.sum(F.when(F.col("sample") == s, F.col("_c")).otherwise(0))
    counts = met.groupBy("chrom", "start", "end").agg(total("chip").alias("n_chip"), total("control").alias("n_ctrl"))
    return regions.join(counts, ["chrom", "start", "end"], "left").na.fill(0, ["n_chip", "n_ctrl"])


def log_binomial_tail(n: Column, upto: Column) -> Column:
    """ln of the chance of ``upto`` heads at most in ``n`` throws of a fair coin, by a running log-sum."""
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.ln((n - i + 1).cast("double")) - F.ln(i.cast("double"))
        top = F.greatest(acc["s"], t)
        return F.struct(t.alias("t"), (top + F.log1p(F.exp(-F.abs(acc["s"] - t)))).alias("s"))

    terms = F.when(upto > 0, F.sequence(F.lit(1).cast("bigint"), F.least(upto, n))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, step)["s"] - n * F.ln(F.lit(2.0))


def with_log_tail(rows: DataFrame, n: str, upto: str, name: str = "log_p") -> DataFrame:
    """rows with ``log_binomial_tail`` of two columns, taken once for each pair of values, as rows share few of these and a tail costs
    ``upto`` steps. The pairs are dealt to all cores, however few files the rows come from."""
    pairs = staged(rows.select(n, upto).distinct(), "pairs")
    dealt = pairs.repartition(tasks_for(pairs.sparkSession, pairs.agg(F.sum(F.greatest(upto, F.lit(1)))).first()[0] or 0), n, upto)
    tails = staged(dealt.select(F.col(n).alias("_n"), F.col(upto).alias("_upto"), log_binomial_tail(F.col(n), F.col(upto)).alias(name)), "tails")
    return rows.join(tails, F.col(n).eqNullSafe(F.col("_n")) & F.col(upto).eqNullSafe(F.col("_upto")), "left").drop("_n", "_upto")


def score_regions(regions: DataFrame, starts: DataFrame, slopes: DataFrame, ext: int) -> DataFrame:
    """regions with n_chip, n_ctrl, n_ctrl_adj, excess, enrichment and log_p. Chromosomes without a positive slope drop out."""
    near = count_in_regions(regions, starts, ext)
    wide = count_in_regions(regions, starts, ext, WIDEN).select("chrom", "start", "end", F.col("n_ctrl").alias("_wide"))
    width = F.col("end") - F.col("start") + 1
    local = F.col("_wide") * width / (width + 2 * WIDEN)
    joined = near.join(wide, ["chrom", "start", "end"]).join(slopes.where("slope > 0").select("chrom", "slope"), "chrom")
    ctrl = joined.withColumn("_ctrl", F.when(F.col("end") - F.col("start") > LONG_REGION, F.col("n_ctrl").cast("double")).otherwise(F.greatest(F.col("n_ctrl").cast("double"), local)))
    adjusted = ctrl.withColumn("n_ctrl_adj", F.greatest(F.ceil(F.round(F.col("_ctrl") * F.col("slope"), 9)), F.lit(1)).cast("bigint")).withColumn("n_ctrl", F.when(F.col("_ctrl") == 0, 1.0).otherwise(F.col("_ctrl")))
    return adjusted.select("chrom", "start", "end", "n_chip", "n_ctrl", "n_ctrl_adj", (F.col("n_chip") - F.col("n_ctrl_adj")).alias("excess"), (F.col("n_chip") / (F.col("n_ctrl") * F.col("slope"))).alias("enrichment"), log_binomial_tail(F.col("n_ctrl_adj") + F.col("n_chip"), F.col("n_ctrl_adj")).alias("log_p"))


def summits(regions: DataFrame, segments: DataFrame) -> DataFrame:
    """regions with max_height, its first run's start and end (clipped to the region)."""
    right = segments.select("chrom", F.col("pos").alias("_p"), F.col("next_pos").alias("_q"), (F.col("next_pos") - 1).alias("_l"), "height")
    met = overlap_join(regions.select("chrom", "start", "end"), right, ["chrom"], "start", "end", "_p", "_l")
    best = met.groupBy("chrom", "start", "end").agg(F.max_by(F.struct(F.greatest("_p", "start").alias("a"), F.least(F.col("_q") - 1, F.col("end")).alias("b"), F.col("height").alias("h")), F.struct(F.col("height"), -F.col("_p"))).alias("m"))
    return best.select("chrom", "start", "end", F.col("m.h").alias("max_height"), F.col("m.a").alias("summit_start"), F.col("m.b").alias("summit_end"))


def summit_offset(compat: bool = True) -> Column:
    """The summit as an offset from the region's start. ``compat`` keeps the usual output: any summit right of the start
    becomes the region's length."""
    middle = F.expr("(summit_start + summit_end) div 2")
    return F.when(middle > F.col("start"), F.col("end") - F.col("start")).otherwise(middle - F.col("start")) if compat else middle - F.col("start")


def q_values(peaks: DataFrame) -> DataFrame:
    """q = p * N / rank over ascending p, neither monotone nor capped; ties by place.

    Ranks are taken in ranges of log_p and the counts of the ranges before are added, so no task sorts all peaks.
    """
    by_range = peaks.withColumn("_g", F.floor(F.greatest("log_p", F.lit(-1e6)) * 16).cast("bigint"))
    counts = by_range.groupBy("_g").agg(F.count("*").alias("_c"))
    every = W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_g", F.coalesce(F.sum("_c").over(every), F.lit(0)).alias("_o"), F.sum("_c").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_n"))
    rank = F.col("_o") + F.row_number().over(W.partitionBy("_g").orderBy("log_p", "chrom", "start", "end"))
    return by_range.join(offsets, "_g").withColumn("rank", rank).withColumn("q", F.exp("log_p") * F.col("_n") / F.col("rank")).drop("_g", "_o", "_n")
