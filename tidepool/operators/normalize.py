"""Scaling of control to signal by regression over position bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 10_000


def bin_counts(fragments: DataFrame, size: int = BIN, compat: bool = False) -> DataFrame:
    """chrom, bin, x (control) and y (chip): distinct starts per bin, bins that both samples have.

    Starts below 0 are left out; with ``compat`` those of the control fall into bin 0.
    """
    kept = fragments.where("start >= 0 OR sample = 'control'") if compat else fragments.where("start >= 0")
    at = F.greatest(F.expr(f"start div {size}"), F.lit(0))
    once = kept.select("sample", "chrom", "start", at.alias("bin")).distinct()
    count = lambda s: F.count(F.when(F.col("sample") == s, 1))
    return once.groupBy("chrom", "bin").agg(count("control").alias("x"), count("chip").alias("y")).where("x > 0 AND y > 0")


def scaling(bins: DataFrame) -> DataFrame:
    """chrom, slope (with intercept; null for fewer than two bins), slope through the origin, correlation. Slopes are rounded to
    12 places, so that a last bit cannot tip a later ceiling."""
    return bins.groupBy("chrom").agg(F.round(F.regr_slope("y", "x"), 12).alias("slope"), F.round(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x")), 12).alias("slope_origin"), F.round(F.corr("x", "y"), 9).alias("pearson"))
