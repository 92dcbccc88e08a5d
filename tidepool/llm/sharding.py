"""Sharding by proportional stratified interleaving, in built-in functions only.

Rows of each source are put in a seeded random order; row r (from 0) of a source of n rows gets the fraction (2r+1)/(2n).
All rows sorted by that fraction interleave the sources in proportion, and cutting the order into equal runs gives shards
whose row counts differ by one at most and whose mixtures all match the whole.

No window sees a whole source or table: rows are ranked in buckets of the random order (resp. of the fraction), which are
even by construction, and the counts of the buckets before are added. The number of buckets follows the row count.

Edge cases: null sources are a source of their own; null ids and repeated rows are rows like others (ties in hash and
fraction break on id, then checksum; rows equal in all of these are interchangeable). Fewer rows than shards leave shards empty.
An empty table gives no rows; op4_sharding reads null texts as empty and texts of any length whole. Further columns may have any
name and stay; columns named shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Staging, crc32_sql, documents, hash_bucket, row_fields, utf8, whole_row

#: Rows per ranking bucket, in the mean.
BUCKET_ROWS = 200_000
#: Buckets at least, so that a hot source is spread over many tasks.
LEAST_BUCKETS = 64
SHARDS = 8
SEED = "shard-7"


def interleave(rows: DataFrame, shards: int, seed: str, source_col: str = "source", id_col: str = "doc_id", tie_col: str = "text_crc32") -> DataFrame:
    """The rows with shard int and slot long (gapless from 0 in each shard). Keep ``rows`` narrow: they are shuffled."""
    total = rows.count()
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_ROWS))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-"))  # null is a source like others
    tied = [F.col("_h"), F.col("_id"), F.col("_tie")]
    hashed = rows.select(whole_row(rows).alias("_row"), F.col(id_col).alias("_id"), F.col(tie_col).alias("_tie"), key.alias("_s"), F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(tie_col).cast("string"))).alias("_h")).withColumn("_b", hash_bucket(F.col("_h"), F.lit(float(buckets))))
    before = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = hashed.groupBy("_s", "_b").agg(F.count("*").alias("_c"))
    offsets = counts.select("_s", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(W.partitionBy("_s")).alias("_n"))
    ranked = hashed.join(offsets, ["_s", "_b"]).withColumn("_r", F.col("_o") + F.row_number().over(W.partitionBy("_s", "_b").orderBy(*tied)) - 1)
    fraction = ranked.withColumn("_f", (2 * F.col("_r") + 1) / (2 * F.col("_n")).cast("double")).withColumn("_g", F.floor(F.col("_f") * buckets).cast("long"))
    # positions of the fractions' buckets: as many rows as buckets
    starts = fraction.groupBy("_g").agg(F.count("*").alias("_c")).select("_g", F.coalesce(F.sum("_c").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_p"))
    placed = fraction.join(starts, "_g").withColumn("_p", F.col("_p") + F.row_number().over(W.partitionBy("_g").orderBy("_f", "_s", *tied)) - 1)
    shard = F.expr(f"CAST((_p * {shards}L) DIV {max(total, 1)}L AS INT)")
    first = F.expr(f"((shard * {max(total, 1)}L) + {shards - 1}L) DIV {shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_p") - first).select(*row_fields(rows, "_row", "shard", "slot"), "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = utf8(F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", "source", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = interleave(Staging(spark).put(rows, "sizes"), SHARDS, SEED)  # narrow: the texts are read once
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


ORACLE = f"""
WITH r AS (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
h AS (SELECT *, coalesce('=' || source, '-') AS s, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(text_crc32 AS VARCHAR)) AS h FROM r),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY s ORDER BY h, doc_id, text_crc32) - 1) / CAST(2 * count(*) OVER (PARTITION BY s) AS DOUBLE) AS f, count(*) OVER () AS n FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY f, s, h, doc_id, text_crc32) - 1 AS p FROM f),
k AS (SELECT *, (p * {SHARDS}) // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(p - (shard * n + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM k
"""
