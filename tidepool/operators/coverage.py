"""Fragments and coverage: pruning, extension, events, the running height, and slices of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pieces import scan
from .staged import dealt


def prune_duplicates(reads: DataFrame, cap: int, keys: tuple[str, ...] = ("sample", "replicate", "chrom")) -> DataFrame:
    """At most ``cap`` reads of each replicate at one position, strands together (0: all).

    Equal reads of one input task are counted before they meet, so a position with millions of copies is a few rows with counts; a
    running sum of the counts is cut at the cap, and what is kept becomes rows again. Both steps are dealt by the number of reads.
    """
    if not cap:
        return reads
    rows = reads.count()
    told = dealt(reads.withColumn("_t", F.spark_partition_id()), rows, *reads.columns, "_t")
    alike = dealt(told.groupBy(*reads.columns, "_t").agg(F.count("*").alias("_c")), rows, *keys, "pos")
    order = W.partitionBy(*keys, "pos").orderBy("strand", "cigar", *(c for c in reads.columns if c not in (*keys, "pos", "strand", "cigar")))
    upto = F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, 0))
    kept = F.least(F.col("_c"), F.greatest(F.lit(cap) - (upto - F.col("_c")), F.lit(0)))
    return alike.withColumn("_k", kept).where("_k > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_k")))).select(*reads.columns)


def extend(fragments: DataFrame, ext: int) -> DataFrame:
    """Fragments of length ``ext`` at least, from their 5' end; all become forward (start, len)."""
    start = F.when((F.col("strand") == "R") & (F.col("len") < ext), F.col("start") + F.col("len") - ext).otherwise(F.col("start"))
    rest = [c for c in fragments.columns if c not in ("start", "len", "strand")]
    return fragments.select(*rest, start.alias("start"), F.greatest("len", F.lit(ext)).cast("bigint").alias("len"))


def reads_per_window(fragments: DataFrame, window: int) -> DataFrame:
    return fragments.groupBy("sample", "chrom", F.expr(f"start div {window}").alias("win")).agg(F.count("*").alias("n"))


def events(fragments: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Net change of height per position, without positions where it is 0."""
    return net(changes(fragments, keys), keys)


def changes(fragments: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Two rows a fragment: 1 where it begins, -1 behind its end."""
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).cast("bigint").alias("delta")), F.struct((F.col("start") + F.col("len")).alias("pos"), F.lit(-1).cast("bigint").alias("delta")))
    return fragments.select(*keys, F.inline(ends))


def net(changes_: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Changes of one position added up, without those that cancel out."""
    return changes_.groupBy(*keys, "pos").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def profile(events_: DataFrame, keys: tuple[str, ...] = ("chrom",), piece: int | None = None) -> DataFrame:
    """The step function: from pos on the height is ``height``; ``prev_height`` before, ``prev_pos`` the event before."""
    run = scan(events_, keys, {"_before": ("sum", F.col("delta")), "prev_pos": ("max", F.col("pos"))}, itself=False, piece=piece)
    return run.select(*keys, "pos", (F.col("_before") + F.col("delta")).alias("height"), F.col("_before").alias("prev_height"), "prev_pos")


def segments(profile_: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """[pos, next_pos) with its height, from the end of each segment backwards (no second window)."""
    return profile_.where("prev_height <> 0").select(*keys, F.col("prev_pos").alias("pos"), F.col("pos").alias("next_pos"), F.col("prev_height").alias("height"))


def profile_slice(segments_: DataFrame, low: int, high: int) -> DataFrame:
    return segments_.where((F.col("next_pos") >= low) & (F.col("pos") < high))
