"""Interval algebra on (chrom, start, end), 1-based and inclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bins import overlap_join
from .pieces import scan
from .staged import dealt


def intersect(left: DataFrame, right: DataFrame, strands: bool = False, first_only: bool = False) -> DataFrame:
    """Pairs that overlap, with the overlap. ``first_only``: of each left region only the first right one, by start and end."""
    on = ["chrom", "strand"] if strands else ["chrom"]
    met = overlap_join(left.select(*on, "start", "end"), right.select(*on, F.col("start").alias("start2"), F.col("end").alias("end2")), on, "start", "end", "start2", "end2")
    if first_only:
        met = met.groupBy(*on, "start", "end").agg(F.min(F.struct("start2", "end2")).alias("_f")).select(*on, "start", "end", "_f.start2", "_f.end2")
    return met.select("chrom", "start", "end", "start2", "end2", F.expr("least(end, end2) - greatest(start, start2) + 1").alias("l_overlap"))


def distance_histogram(left: DataFrame, right: DataFrame, cell: int, most: int) -> DataFrame:
    """How many pairs of a left and a right region lie so many cells apart (right start minus left start, floor of each by cell),
    up to ``most`` cells either way. Starts are counted per cell before they meet, so no pairs of regions are made: the counts of
    two cells are multiplied. distance long, n long; distances without a pair are left out."""
    at = lambda d, name: d.groupBy("chrom", F.floor(F.col("start") / cell).cast("bigint").alias("_at")).agg(F.count("*").alias(name))
    reached = at(left, "n1").withColumn("distance", F.explode(F.expr(f"sequence({-most}L, {most}L)"))).withColumn("_at", F.col("_at") + F.col("distance"))
    return reached.join(at(right, "n2"), ["chrom", "_at"]).groupBy("distance").agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))


def merge(regions: DataFrame, gap: int = 0) -> DataFrame:
    """Regions joined where they overlap or lie at most ``gap`` apart (0: where they touch). Each belongs to the last one before
    it that begins beyond all ends so far. Of the regions with one start only the longest counts, so piles of them stay small."""
    longest = dealt(regions, regions.count(), "chrom", "start").groupBy("chrom", "start").agg(F.max("end").alias("end"))
    reach = scan(longest, ("chrom",), {"_reach": ("max", F.col("end"))}, pos="start", itself=False)
    opens = F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + 1 + gap)
    opened = scan(reach, ("chrom",), {"_first": ("max", F.when(opens, F.col("start")))}, pos="start")
    return opened.groupBy("chrom", F.col("_first").alias("start")).agg(F.max("end").alias("end"))


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """The parts of the merged left regions that no right region covers (a sweep over both sides' borders).

    Between two borders a place is free or not; where that turns, a part begins or ends, and each beginning takes the next end.
    """
    marks = lambda d, l, r: d.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(l).alias("l"), F.lit(r).alias("r")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-l).alias("l"), F.lit(-r).alias("r")))).alias("m"))  # noqa: E731, E741
    net = marks(left, 1, 0).union(marks(right, 0, 1)).groupBy("chrom", "m.pos").agg(F.sum("m.l").alias("l"), F.sum("m.r").alias("r"))
    swept = scan(net, ("chrom",), {"_l": ("sum", F.col("l")), "_r": ("sum", F.col("r"))})
    free, before = F.expr("_l > 0 AND _r = 0"), F.expr("_l - l > 0 AND _r - r = 0")
    turns = swept.where(free != before).select("chrom", "pos", free.alias("opens"))
    paired = scan(turns, ("chrom",), {"next": ("min", F.when(~F.col("opens"), F.col("pos")))}, itself=False, after=True)
    return paired.where("opens").select("chrom", F.col("pos").alias("start"), (F.col("next") - 1).alias("end"))


def coverage(regions: DataFrame) -> DataFrame:
    """Positions that the regions of a chromosome cover."""
    return merge(regions).groupBy("chrom").agg(F.sum(F.expr("end - start + 1")).alias("covered"))


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with the distance to the nearest right region: 0 if they overlap, else the positions between plus 1; null without
    any. Both sides' borders are sorted into one sequence; no pairs are made."""
    own = left.select("chrom", "start", "end").distinct()
    points = own.select("chrom", F.col("start").alias("at"), F.lit(1).alias("side"), "start", "end", F.lit(None).cast("bigint").alias("rs"), F.lit(None).cast("bigint").alias("re"))
    others = right.select("chrom", F.col("start").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"), F.col("start").alias("rs"), F.col("end").alias("re"))
    seen = scan(points.union(others), ("chrom",), {"_e": ("max", F.col("re")), "_s": ("min", F.col("rs"), {"itself": False, "after": True})}, pos="at", ties=("side",))
    left_gap = F.when(F.col("_e").isNotNull(), F.greatest(F.col("start") - F.col("_e"), F.lit(0)))
    right_gap = F.when(F.col("_s").isNotNull(), F.greatest(F.col("_s") - F.col("end"), F.lit(0)))
    return seen.where("side = 1").select("chrom", "start", "end", F.least(left_gap, right_gap).alias("distance"))


def flanks(regions: DataFrame, size: int) -> DataFrame:
    left = regions.select("chrom", F.lit("left").alias("side"), F.greatest(F.col("start") - size, F.lit(1)).alias("start"), (F.col("start") - 1).alias("end")).where("start <= end")
    return left.union(regions.select("chrom", F.lit("right").alias("side"), (F.col("end") + 1).alias("start"), (F.col("end") + size).alias("end")))


def distances(regions: DataFrame) -> DataFrame:
    """From each region's end to the next one's start."""
    behind = scan(regions.select("chrom", "start", "end"), ("chrom",), {"_next": ("min", F.col("start"))}, pos="start", ties=("end",), itself=False, after=True)
    return behind.select("chrom", "start", "end", (F.col("_next") - F.col("end")).alias("distance"))


def exons(regions: DataFrame) -> DataFrame:
    return regions.select("chrom", "name", F.inline("intervals"))


def extend_ends(regions: DataFrame, five: int, three: int) -> DataFrame:
    """Regions longer at their 5' and 3' ends by strand, not below 1."""
    back = F.col("strand").isin("-", "R")
    return regions.withColumn("start", F.greatest(F.lit(1), F.col("start") - F.when(back, three).otherwise(five))).withColumn("end", F.col("end") + F.when(back, five).otherwise(three))
