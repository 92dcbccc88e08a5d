"""Coverage and merged peaks of reads that keep arriving in about the order of their positions.

Positions play the part of event time, each chromosome with a watermark of its own: the last start seen less ``late``. Events
(net changes of the height) at or below it are closed: nothing that still comes may change them. What is kept between the
batches is one table of the events above the watermark, the height at the last closed event as one more event, and the peaks
that may still grow. So the state follows the disorder and the length of fragments, not the number of reads.

Each micro-batch is DataFrame work on (chromosome, piece of positions); no task holds a chromosome. State and results are
written under the batch's number, so a batch that is run again replaces its own rows and nothing counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import coverage, regions
from ..operators.staged import dealt, exists, scope, staged

_EVENTS, _BOUNDS, _PEAKS = "chrom string, pos bigint, delta bigint", "chrom string, last bigint, closed bigint", "chrom string, start bigint, end bigint"


@dataclass(frozen=True)
class CoverageStream:
    """out: folder of the results segments, peaks and late (reads that came after their positions were closed: these count
    nowhere else). threshold and gap: runs at or above the threshold are joined up to that gap."""

    out: str
    late: int = 1000
    threshold: int = 1
    gap: int = 200

    def _read(self, spark: SparkSession, table: str, batch: int, schema: str) -> DataFrame:
        path = f"{self.out}/state/{table}/{batch}"
        if batch >= 0 and exists(spark, path):
            return spark.read.schema(schema).parquet(path)
        # an empty relation that Spark knows to be empty: a join by chromosome with it shuffles nothing
        return spark.range(1).where("false").selectExpr(*(f"CAST(NULL AS {kind}) AS {c}" for c, kind in map(str.split, schema.split(", "))))

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.out}/{name}")

    def batch(self, fragments: DataFrame, number: int) -> None:
        """fragments: chrom, start, len, forward and extended. Closes what the batch allows."""
        self._advance(fragments, number, False)

    def finish(self, spark: SparkSession, number: int) -> None:
        """Closes everything, as batch ``number``: one more than the last."""
        self._advance(spark.createDataFrame([], "chrom string, start bigint, len bigint"), number, True)

    def _advance(self, fragments: DataFrame, number: int, last: bool) -> None:
        spark = fragments.sparkSession
        with scope():
            before = self._read(spark, "bounds", number - 1, _BOUNDS)
            told = staged(fragments.select("chrom", "start", "len").join(before.select("chrom", "closed"), "chrom", "left"), "batch")
            self._write(told.where("start <= closed").drop("closed"), f"late/{number}")
            fresh = told.where("closed IS NULL OR start > closed")
            seen = before.select("chrom", "last", "closed").union(fresh.groupBy("chrom").agg(F.max("start").alias("last")).select("chrom", "last", F.lit(None).cast("bigint")))
            closing = F.lit((1 << 62)) if last else F.greatest(F.coalesce(F.max("closed"), F.lit(-(1 << 62))), F.max("last") - self.late)
            bounds = staged(seen.groupBy("chrom").agg(F.max("last").alias("last"), closing.alias("closed")), "bounds")

            kept = self._read(spark, "events", number - 1, _EVENTS)
            both = dealt(kept.union(coverage.changes(fresh)), kept.count() + 2 * told.count(), "chrom", "pos")
            events = staged(coverage.net(both).join(bounds.select("chrom", "closed"), "chrom"), "events")
            done = staged(coverage.profile(events.where("pos <= closed").drop("closed")), "profile")
            emitted = staged(coverage.segments(done), "segments")
            reached = staged(done.groupBy("chrom").agg(F.max("pos").alias("reached"), F.max_by("height", "pos").alias("height")).withColumnRenamed("reached", "pos"), "reached")
            carry = reached.where("height <> 0").select("chrom", "pos", F.col("height").alias("delta"))

            high = emitted.where(F.col("height") >= self.threshold).select("chrom", F.col("pos").alias("start"), (F.col("next_pos") - 1).alias("end"))
            peaks = regions.merge(high.union(self._read(spark, "peaks", number - 1, _PEAKS)), self.gap - 1).join(reached.select("chrom", F.col("pos").alias("upto")), "chrom", "left")
            peaks = staged(peaks.withColumn("final", F.lit(last) | F.coalesce(F.col("upto") > F.col("end") + self.gap, F.lit(False))).drop("upto"), "peaks")

            self._write(emitted, f"segments/{number}")
            self._write(peaks.where("final").drop("final"), f"peaks/{number}")
            self._write(peaks.where("NOT final").select("chrom", "start", "end"), f"state/peaks/{number}")
            self._write(events.where("pos > closed").select("chrom", "pos", "delta").union(carry), f"state/events/{number}")
            self._write(bounds.select("chrom", "last", "closed"), f"state/bounds/{number}")

    def start(self, fragments: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs over a stream of fragments; stops when what is there has been read."""
        return fragments.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def result(self, spark: SparkSession, name: str, batches: int) -> DataFrame:
        """segments, peaks or late of the batches 0 to ``batches`` - 1."""
        return reduce(DataFrame.union, (spark.read.parquet(f"{self.out}/{name}/{i}") for i in range(batches)))
