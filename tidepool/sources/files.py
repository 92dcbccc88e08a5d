"""Text files whose lines count: FASTQ, bedGraph and BED with line numbers, from any number of files in any number of byte ranges.

Spark reads a file in byte ranges, so a line's number is not known where it is read. Lines are counted per file and range first;
the sum of the ranges before gives each range's first number. The second reading adds each line's place in its range. Both read
the ranges where they lie, and nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.bins import FEW
from ..operators.staged import staged
from . import reads


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (from 0 in each file) and value of every line. Empty files have none; compressed files are one range."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_id"))
    ranges = text.groupBy("file", "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = W.partitionBy("file").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    known = staged(ranges.select("file", "_range", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before")), "ranges")
    met = text.join(known.hint("broadcast" if known.limit(FEW + 1).count() <= FEW else "merge"), ["file", "_range"])
    return met.select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, record (from 0 in each file), id, nucs and quality. Lines of one record meet by file and number, so records may lie
    across ranges, and quality lines may begin with @."""
    return reads.parse_fastq(numbered_lines(spark, path))


def read_bedgraph(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of bedGraph files (start and end from 1, inclusive, value) with their chromosome as track and their place; see ``segments.paint``."""
    return reads.bedgraph_lines(numbered_lines(spark, path))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Regions with the file and line that each stands in, and the line itself."""
    return reads.parse_bed(numbered_lines(spark, path).withColumn("text", F.col("value")))
