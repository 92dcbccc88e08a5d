"""Streaming counterparts: reads that keep arriving, and counts per window of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.reads import PARSERS


def stream_reads(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    """Reads parsed from text files as they appear in a folder."""
    return PARSERS[fmt](spark.readStream.text(path))


def append_reads(reads: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet by chromosome, exactly once; stops when what is there has been read."""
    return reads.writeStream.format("parquet").partitionBy("chrom").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(reads: DataFrame, window: int) -> DataFrame:
    """Running counts of reads per chromosome and window of positions (output mode complete or update)."""
    return reads.groupBy("chrom", F.expr(f"pos div {window}").alias("win")).agg(F.count("*").alias("n"))
