"""Mixing sources to target weights, in built-in functions only.

Targets: a source's share of all words by its weight, limited to ``MAX_EPOCHS`` times its own size; the excess goes to the
others by weight until none is above (water level: the sources by limit over weight, one running sum).

Drawing: each source is cut into hash blocks of about 1/``BLOCKS`` of all words. Its quota is so many copies of blocks:
all blocks for each whole epoch, then blocks in a permuted order while they fit, and of the next block documents in a
permuted order while they fit (the last document counts if at least half of it does). The quotas are parted among output
shards by a splitting tree: at each node the copies of all sources are shuffled and cut in two halves, so the counts that go
left are multivariate hypergeometric and the quotas stay exact. Each shard then draws its quota from the source's
permuted copies, disjoint from the other shards' draws, and shuffles locally: ``place`` orders a shard's documents.

Everything random is an MD5 of a seed and ids, so reruns agree. Tables of blocks have ``BLOCKS`` rows plus a few per source
whatever the input's size, so the windows over them stay small as long as sources are not counted in millions; documents meet
them on (source, block), which splits a hot source.

Edge cases: null sources are one source, last in order; null ids and repeated rows are rows like others (rows equal in id and
size in one block may be taken in either order); documents without words (null or empty texts) have size 0 and are taken 0
times; texts of any length count whole; an empty table gives no rows. Further columns may have any name and stay; columns named
source_size, target, copies, shards or place are replaced by mix, and none by mix_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Staging, documents, hash_bucket, row_fields, whole_row, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCKS = 4096
SHARDS = 8
SALTS = 64
SEED = "mix-7"


def _md5(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.lit(p) if isinstance(p, str) else p for p in parts)))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: _s (key), source, source_size; adds weight and target. One row per source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("long")).withColumn("_limit", F.col("source_size") * MAX_EPOCHS)
    by_ratio = W.orderBy(F.col("_limit") / F.col("weight"), "_s")
    run = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(run), F.lit(0))
    parts = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(run), F.lit(0))
    levels = weighed.withColumn("_level", left.cast("double") / parts)
    # the level holds from the first source that stays below its limit; those before it are full
    fits = levels.withColumn("_fits", F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.col("_level")))
    level = F.first("_fits", ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    capped = F.least(F.col("_limit").cast("double"), level * F.col("weight"))
    return fits.withColumn("target", F.coalesce(capped, F.lit(0.0))).drop("_limit", "_level", "_fits")


def split(copies: DataFrame, shards: int) -> DataFrame:
    """copies: _s, _k (copy number in the source's permuted order, from 0). Adds shard through the splitting tree."""
    tree = copies.select("_s", "_k").withColumn("_node", F.lit(0)).withColumn("_lo", F.lit(0)).withColumn("_hi", F.lit(shards))
    for depth in range(max(1, (shards - 1).bit_length())):
        node = W.partitionBy("_node")
        mid = F.expr("(_lo + _hi) div 2").cast("int")
        quota = F.expr("(count(*) over (partition by _node) * (((_lo + _hi) div 2) - _lo)) div greatest(_hi - _lo, 1)")
        at = F.row_number().over(node.orderBy(_md5(f"split{depth}", F.col("_s"), F.col("_k").cast("string"))))
        left = (at <= quota) & (F.col("_hi") - F.col("_lo") > 1)
        cut = tree.withColumn("_left", F.when(F.col("_hi") - F.col("_lo") > 1, left)).withColumn("_mid", mid)
        tree = cut.select("_s", "_k", (F.col("_node") * 2 + F.when(F.coalesce("_left", F.lit(True)), 0).otherwise(1)).alias("_node"), F.when(F.coalesce(~F.col("_left"), F.lit(False)), F.col("_mid")).otherwise(F.col("_lo")).alias("_lo"), F.when(F.coalesce(F.col("_left"), F.lit(False)), F.col("_mid")).otherwise(F.col("_hi")).alias("_hi"))
    quotas = tree.groupBy("_s", F.col("_lo").alias("shard")).agg(F.count("*").alias("_q"))
    upto = W.partitionBy("_s").orderBy("shard")
    ranges = quotas.select("_s", "shard", (F.sum("_q").over(upto) - F.col("_q")).alias("_from"), F.sum("_q").over(upto).alias("_to"))
    return copies.join(ranges, "_s").where((F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_to"))).drop("_from", "_to")


def mix(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", shards: int = SHARDS) -> DataFrame:
    """rows (narrow: id, source, size) with source_size, target, copies int, shards (array<int>, one entry per copy) and place (hash that orders a shard)."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-"))
    keyed = rows.select(whole_row(rows).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(size_col).alias("_size"), key.alias("_s"), _md5("doc", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(size_col).cast("string")).alias("_h"))
    sizes = targets(keyed.groupBy("_s").agg(F.first("_source").alias("source"), F.sum("_size").alias("source_size")))
    per_block = F.greatest(F.ceil(F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) / F.lit(float(BLOCKS))), F.lit(1))
    sizes = sizes.withColumn("_blocks", F.greatest(F.ceil(F.col("source_size") / per_block.cast("double")), F.lit(1)).cast("long"))
    plan = sizes.select("_s", "source_size", "target", "_blocks", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long").alias("_epochs"))
    plan = plan.withColumn("_rest", F.greatest(F.col("target") - F.col("_epochs") * F.col("source_size"), F.lit(0.0)))
    # salted: a hot source meets its one row of the plan in SALTS places
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    located = keyed.withColumn("_salt", hash_bucket(F.col("_h"), F.lit(float(SALTS)))).join(salted, ["_s", "_salt"]).drop("_salt").withColumn("_b", hash_bucket(F.col("_h"), F.col("_blocks").cast("double")))

    blocks = located.groupBy("_s", "_b").agg(F.sum("_size").alias("_words"), F.first("_epochs").alias("_epochs"), F.first("_rest").alias("_rest"))
    permuted = W.partitionBy("_s").orderBy(_md5("block", F.col("_s"), F.col("_b").cast("string")), "_b")
    drawn = blocks.withColumn("_i", F.row_number().over(permuted) - 1).withColumn("_upto", F.sum("_words").over(permuted.rowsBetween(W.unboundedPreceding, W.currentRow)))
    left = F.col("_rest") - (F.col("_upto") - F.col("_words"))  # words that the last epoch still wants when it comes to this block
    drawn = drawn.withColumn("_part", F.when(F.col("_upto") <= F.col("_rest"), F.lit(2)).when(left > 0, F.lit(1)).otherwise(F.lit(0))).withColumn("_left", F.greatest(left, F.lit(0.0)))

    copies = drawn.select("_s", "_b", F.explode(F.expr("sequence(0L, _epochs)")).alias("_epoch"), "_i", "_epochs", "_part").where((F.col("_epoch") < F.col("_epochs")) | (F.col("_part") > 0))
    copies = copies.withColumn("_k", F.row_number().over(W.partitionBy("_s").orderBy("_epoch", "_i")) - 1)
    dealt = split(copies, shards).groupBy("_s", "_b").agg(F.array_sort(F.collect_list(F.struct("_epoch", "shard"))).alias("_deal"))  # MAX_EPOCHS + 1 entries at most
    table = drawn.select("_s", "_b", "_part", "_left").join(dealt, ["_s", "_b"], "left")

    # a block is about 1/BLOCKS of all words, whatever the ids (blocks go by id and size), so no window holds more than that
    inside = W.partitionBy("_s", "_b").orderBy(_md5("pick", F.col("_h")), "_size", "_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = located.join(table, ["_s", "_b"]).withColumn("_run", F.sum("_size").over(inside))
    out = out.withColumn("_more", F.when(F.col("_part") == 1, (F.col("_run") - F.col("_size") / 2.0 <= F.col("_left")).cast("int")).otherwise((F.col("_part") == 2).cast("int")))
    n = F.when(F.col("_size") > 0, F.least(F.col("_epochs") + F.col("_more"), F.lit(MAX_EPOCHS))).otherwise(0).cast("int")
    chosen = F.slice(F.transform(F.coalesce(F.col("_deal"), F.array().cast("array<struct<_epoch:bigint,shard:int>>")), lambda x: x["shard"]), F.lit(1), n)
    new = {"source_size": F.col("source_size"), "target": F.col("target"), "copies": n, "shards": chosen, "place": _md5("place", F.col("_h"))}
    return out.select(*row_fields(rows, "_row", *new), *(c.alias(name) for name, c in new.items()))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(Staging(spark).put(rows, "sizes"))  # narrow: the texts are read once
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"), "place")


_WORDS = f"CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT)"
_TREE = []
for _d in range((SHARDS - 1).bit_length()):
    _TREE.append(f"""t{_d}a AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY md5('{SEED}|split{_d}|' || s || '|' || CAST(k AS VARCHAR))) <= (count(*) OVER (PARTITION BY node) * ((lo + hi) // 2 - lo)) // (hi - lo) AS l FROM t{_d}),
t{_d + 1} AS (SELECT s, k, node * 2 + CASE WHEN l THEN 0 ELSE 1 END AS node, CASE WHEN l THEN lo ELSE (lo + hi) // 2 END AS lo, CASE WHEN l THEN (lo + hi) // 2 ELSE hi END AS hi FROM t{_d}a)""")
_BUCKET = "CAST(floor(('0x' || substr({h}, 1, 8))::BIGINT::DOUBLE * {n} / 4294967296.0) AS BIGINT)"
ORACLE = f"""
WITH r AS (SELECT doc_id, source, {_WORDS} AS size, coalesce('=' || source, '-') AS s, md5('{SEED}|doc|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST({_WORDS} AS VARCHAR)) AS h FROM documents),
z0 AS (SELECT s, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY s),
z1 AS (SELECT *, {MAX_EPOCHS} * source_size AS lim, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)}] AS w FROM z0),
z2 AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level, sum(source_size) OVER () AS words FROM z1 WINDOW o AS (ORDER BY lim / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z3 AS (SELECT *, least(CAST(lim AS DOUBLE), w * (SELECT arg_min(level, (lim / w, s)) FROM z2 WHERE level * w <= lim)) AS target FROM z2),
z4 AS (SELECT s, source_size, target, greatest(CAST(ceil(source_size / greatest(ceil(words / {BLOCKS}.0), 1)) AS BIGINT), 1) AS nb, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS ep FROM z3),
z5 AS (SELECT *, greatest(target - ep * source_size, 0.0) AS rest FROM z4),
l AS (SELECT r.*, source_size, target, ep, rest, {_BUCKET.format(h='h', n='nb')} AS b FROM r JOIN z5 USING (s)),
b0 AS (SELECT s, b, CAST(sum(size) AS BIGINT) AS words, any_value(ep) AS ep, any_value(rest) AS rest FROM l GROUP BY s, b),
b1 AS (SELECT *, row_number() OVER o - 1 AS i, sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM b0 WINDOW o AS (PARTITION BY s ORDER BY md5('{SEED}|block|' || s || '|' || CAST(b AS VARCHAR)), b)),
b2 AS (SELECT *, CASE WHEN upto <= rest THEN 2 WHEN rest - (upto - words) > 0 THEN 1 ELSE 0 END AS part, greatest(rest - (upto - words), 0.0) AS remain FROM b1),
c0 AS (SELECT s, b, i, ep, part, unnest(range(ep + 1)) AS e FROM b2),
c AS (SELECT s, b, e, row_number() OVER (PARTITION BY s ORDER BY e, i) - 1 AS k FROM c0 WHERE e < ep OR part > 0),
t0 AS (SELECT s, k, 0 AS node, 0 AS lo, {SHARDS} AS hi FROM c),
{", ".join(_TREE)},
q AS (SELECT s, lo AS shard, count(*) AS q FROM t{(SHARDS - 1).bit_length()} GROUP BY s, lo),
g AS (SELECT s, shard, sum(q) OVER (PARTITION BY s ORDER BY shard) - q AS f, sum(q) OVER (PARTITION BY s ORDER BY shard) AS t FROM q),
d AS (SELECT c.s, c.b, list(g.shard ORDER BY c.e) AS deal FROM c JOIN g ON c.s = g.s AND c.k >= g.f AND c.k < g.t GROUP BY c.s, c.b),
x AS (SELECT l.*, part, remain, deal FROM l JOIN b2 USING (s, b) LEFT JOIN d USING (s, b)),
y AS (SELECT *, CASE part WHEN 2 THEN 1 WHEN 0 THEN 0 ELSE CASE WHEN sum(size) OVER (PARTITION BY s, b ORDER BY md5('{SEED}|pick|' || h), size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 <= remain THEN 1 ELSE 0 END END AS more FROM x),
n AS (SELECT *, CASE WHEN size > 0 THEN least(ep + more, {MAX_EPOCHS}) ELSE 0 END AS copies FROM y)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, source, coalesce(array_to_string(coalesce(deal, [])[1:copies], ','), '') AS shards, md5('{SEED}|place|' || h) AS place FROM n
"""


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as the mixture takes them: a row appears as often as it is taken, and columns of any name and type stay.

    Rows equal in id, source and text (128 bits of hash) are taken together. Null and empty texts and others without words have
    size 0 and are not taken. Each task writes its rows shard by shard; within a shard each copy has a place of its own.
    """
    tags = [F.xxhash64("doc_id", "source", "text").alias("tag"), F.xxhash64(F.lit(1), "text", "source", "doc_id").alias("other")]
    sizes = docs.select(*tags, "source", word_count(F.col("text")).alias("size"))
    units = sizes.groupBy("tag", "other", "source").agg(F.sum("size").alias("size")).withColumn("id", F.concat_ws(":", "tag", "other"))
    taken = mix(Staging(spark).put(units, "sizes"), id_col="id").where("copies > 0").select("tag", "other", "shards", "place")
    placed = docs.select(whole_row(docs).alias("row"), *tags).join(taken, ["tag", "other"]).select("row", "place", F.posexplode("shards").alias("copy", "shard"))
    return placed.sortWithinPartitions("shard", F.xxhash64("place", "shard", "copy"), "place", "copy").select(*row_fields(docs, "row"))
