"""A store of coverage that grows by appends: event deltas, a folder per append.

The store keeps net changes of the height at positions, so what lies before a position does not change them. An append writes its
own changes and no others, and a folder however many pieces of positions it touches; changes are summed when the store is read. A
folder tells which pieces its append has reached, so an append that failed halfway is run again under its number and adds only the
pieces that are missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import coverage
from .pieces import PIECE
from .staged import exists, scope, staged

_SCHEMA = "pos bigint, delta bigint, chrom string, piece bigint, batch bigint"
_KEYS = ["chrom", "piece"]


@dataclass(frozen=True)
class CoverageStore:
    path: str
    piece: int = PIECE

    def deltas(self, spark: SparkSession) -> DataFrame:
        """pos, delta, chrom, piece, batch: the changes of each append."""
        return spark.read.schema(_SCHEMA).parquet(self.path) if exists(spark, self.path) else spark.createDataFrame([], _SCHEMA)

    def append(self, fragments: DataFrame, number: int) -> int:
        """Adds fragments (chrom, start, len) as append ``number`` (numbers rise). The number of pieces that were written."""
        spark = fragments.sparkSession
        with scope():
            at = F.floor(F.col("pos") / self.piece).cast("bigint").alias("piece")
            fresh = coverage.events(fragments).select("pos", "delta", "chrom", at)
            if exists(spark, self.path):
                done = self.deltas(spark).where(F.col("batch") >= number).select(*_KEYS).distinct()
                fresh = fresh.join(done, _KEYS, "left_anti")
            fresh = staged(fresh, "fresh")
            fresh.sortWithinPartitions("chrom", "pos").write.mode("append").parquet(f"{self.path}/batch={number}")
            return fresh.select(*_KEYS).distinct().count()

    def profile(self, spark: SparkSession) -> DataFrame:
        """The step function of all that was appended, as ``coverage.profile`` gives it."""
        changes = self.deltas(spark).groupBy("chrom", "pos").agg(F.sum("delta").alias("delta")).where("delta <> 0")
        return coverage.profile(changes, piece=self.piece)
