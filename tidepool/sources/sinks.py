"""Rows of the text outputs, and their writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bins import overlap_join


def narrowpeak_rows(peaks: DataFrame) -> DataFrame:
    """narrowPeak: 0-based start, -log10 of p, the raw q, and the summit's offset."""
    log10 = -F.col("log_p") / F.ln(F.lit(10.0))
    return peaks.select("chrom", (F.col("start") - 1).alias("chrom_start"), F.col("end").alias("chrom_end"), F.lit(".").alias("name"), F.lit(0).alias("score"), F.lit(".").alias("strand"), F.round("enrichment", 3).alias("enrichment"), F.round(log10, 6).alias("neg_log10_p"), F.round("q", 6).alias("q"), F.col("summit").alias("summit"))


def result_rows(peaks: DataFrame) -> DataFrame:
    return peaks.select(F.col("chrom").alias("chromosome"), F.col("start").alias("begin"), "end", "n_chip", F.col("n_ctrl_adj").alias("n_control"), "excess", F.round("enrichment", 3).alias("enrichment"), F.round("log_p", 3).alias("log_p"), F.round("q", 3).alias("q"), F.col("summit").alias("max_position"), "max_height")


#: Titles of the result text's columns, the cell of each (printf), and the cells of a narrowPeak line.
TITLES = ["Chromosome", "Begin", "End", "#_ChIP_Reads", "#_Control_Reads", "Excess", "Enrichment", "Log_p-value", "Q-value", "Max_Position", "Max_Height"]
CELLS = ["%-15s", "%-12d", "%-12d", "%-11d", "%-11d", "%-6d", "%-12.3f", "%-15.3f", "%-8.3f", "%-12d", "%-10d"]
NARROWPEAK_CELLS = ["%-15s", "%-12d", "%-12d", "%s", "%d", "%s", "%-12.3f", "%e", "%e", "%d"]


def title_line() -> str:
    return " ".join(re.sub(r"(\.\d+)?[sdf]$", "s", cell) for cell in CELLS) % tuple(TITLES)


def result_lines(peaks: DataFrame) -> DataFrame:
    """One column, named by the title line, with the result text's lines."""
    rows = result_rows(peaks)
    return rows.select(F.format_string(" ".join(CELLS), *(F.col(c) for c in rows.columns)).alias(title_line()))


def narrowpeak_lines(peaks: DataFrame) -> DataFrame:
    rows = narrowpeak_rows(peaks)
    return rows.select(F.format_string("\t".join(NARROWPEAK_CELLS), *(F.col(c) for c in rows.columns)).alias("value"))


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").csv(path)


def write_lines(lines: DataFrame, path: str, title: bool = False) -> None:
    """Lines (one column) as text; with ``title`` each file begins with the column's name."""
    plain = {"sep": "\x01", "quote": "", "escapeQuotes": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.write.mode("overwrite").options(header=title, **plain).csv(path)


def peak_profiles(regions: DataFrame, segments: DataFrame) -> DataFrame:
    """The steps of the height inside each region (pos: the region's start at least)."""
    right = segments.select("chrom", F.col("pos").alias("_p"), (F.col("next_pos") - 1).alias("_l"), "height")
    met = overlap_join(regions.select("chrom", "start", "end"), right, ["chrom"], "start", "end", "_p", "_l")
    return met.select("chrom", "start", "end", F.greatest("_p", "start").alias("pos"), "height")


def write_peak_profiles(profiles: DataFrame, path: str) -> None:
    """A folder per chromosome; a peak's steps stand together and in order."""
    profiles.repartition("chrom", "start").sortWithinPartitions("chrom", "start", "end", "pos").write.mode("overwrite").partitionBy("chrom").parquet(path)


def bed_rows(regions: DataFrame, stranded: bool = False, value: str | None = None) -> DataFrame:
    """BED rows; with ``value`` that column (such as p or q) follows a name."""
    base = [F.col("chrom"), (F.col("start") - 1).alias("start"), F.col("end")]
    named = [F.lit(".").alias("name")] if stranded or value else []
    return regions.select(*base, *named, *([F.col(value)] if value else [F.lit(0).alias("score")] if stranded else []), *([F.col("strand")] if stranded else []))


def interval_rows(regions: DataFrame) -> DataFrame:
    """Regions with ``intervals`` as lines' fields: starts 0-based, lists with commas."""
    joined = lambda field, less: F.array_join(F.transform("intervals", lambda x: (x[field] - less).cast("string")), ",")
    return regions.select("name", "chrom", "strand", (F.col("start") - 1).alias("start"), "end", F.size("intervals").alias("blocks"), joined("start", 1).alias("starts"), joined("end", 0).alias("ends"))


def tagalign_rows(fragments: DataFrame) -> DataFrame:
    return fragments.select("chrom", "start", (F.col("start") + F.col("len") - 1).alias("end"), F.lit(".").alias("name"), F.lit(1000).alias("score"), F.when(F.col("strand") == "F", "+").otherwise("-").alias("strand"))


def gff_rows(regions: DataFrame, source: str, feature: str, child: str | None = None) -> DataFrame:
    """GFF rows, positions from 1. With ``child`` a row for each of a region's ``intervals`` follows, and attributes tie parent and
    children by the region's name. A table without strands has ``.``."""
    strand = F.col("strand") if "strand" in regions.columns else F.lit(".")
    row = lambda kind, a, b: [F.col("chrom"), F.lit(source).alias("source"), F.lit(kind).alias("feature"), F.col(a).alias("start"), F.col(b).alias("end"), F.lit(".").alias("score"), strand.alias("strand"), F.lit(".").alias("frame")]
    if child is None:
        return regions.select(*row(feature, "start", "end"))
    parents = regions.select(*row(feature, "start", "end"), F.concat(F.lit("ID="), "name").alias("attributes"))
    each = regions.select("*", F.posexplode("intervals").alias("_i", "_c"))
    ids = F.concat(F.lit("ID="), "name", F.lit("."), (F.col("_i") + 1).cast("string"), F.lit(";Parent="), "name")
    return parents.union(each.select(*row(child, "_c.start", "_c.end"), ids.alias("attributes")))


def fastq_lines(records: DataFrame) -> DataFrame:
    return records.select(F.concat_ws("\n", F.concat(F.lit("@"), "id"), "nucs", F.concat(F.lit("+"), "id"), "quality").alias("value"))


def bedgraph_rows(runs: DataFrame) -> DataFrame:
    return runs.select("track", (F.col("start") - 1).alias("start"), "end", "value")


def phred_distribution(records: DataFrame) -> DataFrame:
    """How often each quality letter stands at each place."""
    return records.select(F.posexplode(F.split("quality", "")).alias("place", "letter")).groupBy("place", "letter").agg(F.count("*").alias("n"))
