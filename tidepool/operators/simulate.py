"""Synthetic reads around regions."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .background import uniform
from .staged import tasks_for


def simulate_fragments(regions: DataFrame, n: int, length: int, seed: int, chip: bool) -> DataFrame:
    """``n`` fragments per region (key, chrom, start, end): chrom, start, len, strand.

    Signal starts crowd around the region's middle (a discretised normal with deviation length // 40 by its inverse
    distribution); control starts follow the cumulated i/length, whose inverse is a closed form.
    """
    spread = regions.repartition(tasks_for(regions.sparkSession, regions.count() * n), "chrom", "start", "end", "key")
    drawn = spread.select("*", F.explode(F.expr(f"sequence(1L, {n}L)")).alias("read"))
    u = F.expr(f"{uniform(['key', 'read'], seed)} / 2147483647.0D")
    strand = F.when(F.expr(f"{uniform(['key', 'read'], seed + 1)} > 1073741823"), "F").otherwise("R")
    width = F.col("end") - F.col("start") + 1
    if chip:
        sigma = max(length // 40, 1)
        weights = [math.exp(-((i - length / 2) ** 2) / (2 * sigma**2)) for i in range(length)]
        cdf = list(itertools.accumulate(w / sum(weights) for w in weights))
        # how many of the ascending sums are at most u, by halving steps
        drawn, sums = drawn.withColumn("_u", u), F.array(*(F.lit(c) for c in cdf))
        halves = F.array(*(F.lit(1 << i) for i in reversed(range(length.bit_length()))))
        fits = lambda at: F.when(at <= length, F.get(sums, at - 1) <= F.col("_u")).otherwise(False)
        offset = F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(fits(at + half), half).otherwise(0)) % length
    else:
        offset = F.least(F.ceil((F.sqrt(8.0 * length * u + 1) - 1) / 2), F.lit(length - 1))
    return drawn.select("chrom", (F.col("start") + offset.cast("bigint") % width).alias("start"), F.lit(length).cast("bigint").alias("len"), strand.alias("strand"))
