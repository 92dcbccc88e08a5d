"""Samples of an exact size, and permutations of 0..n-1 without a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .background import uniform

#: Rounds of the permutation's Feistel network, and walks through its domain at most.
ROUNDS, WALKS = 4, 64
#: Hexadecimal digits that one histogram of the sample tells apart.
DIGITS = 4


def subsample(rows: DataFrame, n: int, key: list[str], seed: int) -> DataFrame:
    """n of the rows (all, if there are fewer): those with the smallest hash of seed and key; the same on every run.

    Histograms of the hash's digits, of 16**4 counts each, find the hash at which n rows are full; no rows are sorted. Rows equal
    in the key have one hash: of those at the cut as many as are missing are taken.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)))
    hashed, cut, missing = rows.withColumn("_h", h), "", n
    while len(cut) < 32:
        digits = F.substring("_h", len(cut) + 1, DIGITS).alias("d")
        counts = hashed.where(F.col("_h").startswith(cut)).groupBy(digits).agg(F.count("*").alias("c")).collect()  # 16**DIGITS rows at most
        for r in sorted(counts):
            if r["c"] > missing:
                cut += r["d"]
                break
            missing -= r["c"]
        else:
            return rows if not cut else _taken(hashed, cut + "g", 0)  # all that begin with the cut
        if missing == 0:
            break
    return _taken(hashed, cut, missing)


def _taken(hashed: DataFrame, cut: str, missing: int) -> DataFrame:
    before = hashed.where(F.col("_h") < cut)
    return (before.union(hashed.where(F.col("_h") == cut).limit(missing)) if missing else before).drop("_h")


def feistel_sql(x: str, side: int, seed: int) -> str:
    """SQL, in integer arithmetic that other engines share: a permutation of 0..side*side-1."""
    left, right = f"(({x}) // {side})", f"(({x}) % {side})"
    for i in range(ROUNDS):
        left, right = right, f"(({left} + {uniform([str(i), right], seed)}) % {side})"
    return f"({left} * {side} + {right})"


def permuted_sql(x: str, n: int, seed: int, fold: str) -> str:
    """SQL: where the index x of 0..n-1 goes. Values at n and above walk on through the network; of its square domain hardly any
    are. fold: how the engine folds a step over WALKS places ({start}, {step} with the name acc)."""
    side = math.isqrt(max(n - 1, 0)) + 1
    return fold.format(start=feistel_sql(x, side, seed), step=f"CASE WHEN acc < {n} THEN acc ELSE {feistel_sql('acc', side, seed)} END", walks=min(WALKS, side * side - n + 1))


#: The fold in Spark and in DuckDB.
SPARK_FOLD = "aggregate(sequence(1, {walks}), {start}, (acc, i) -> {step})"
DUCK_FOLD = "list_reduce(list_prepend({start}, range({walks})), lambda acc, i: {step})"


def permuted(x: str, n: int, seed: int) -> Column:
    """A bijection of the column x (0..n-1) onto 0..n-1, by a key; an error if a walk has not ended, which 64 steps practically exclude."""
    to = F.expr(permuted_sql(x, n, seed, SPARK_FOLD).replace("//", "div"))
    return F.when(to < n, to).otherwise(F.raise_error(F.lit("a walk has not ended")).cast("bigint"))


def shuffle_blocks(track: DataFrame, block: int, length: int, seed: int) -> DataFrame:
    """Whole blocks of the track (track, pos, value) in another order; a rest shorter than a block drops out. A projection: each
    row computes where its block goes."""
    n = length // block
    at = track.withColumn("_b", F.expr(f"(pos - 1) div {block}")).where(F.col("_b") < n)
    return at.select("track", (permuted("_b", n, seed) * block + (F.col("pos") - 1) % block + 1).alias("pos"), "value")
