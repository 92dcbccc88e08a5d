"""Samples of an exact size and permutations, against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidepool.operators import sample


@pytest.mark.parametrize("n", [0, 1, 57, 299, 300, 1000])
def test_subsample_is_exact(spark, n):
    rows = [(i % 250, "é" if i % 3 else None) for i in range(300)]  # repeated rows too
    df = spark.createDataFrame(rows, "a long, b string").repartition(3)
    got = sorted(map(str, map(tuple, sample.subsample(df, n, ["a", "b"], 5).collect())))
    by_hash = sorted(rows, key=lambda r: hashlib.md5(f"5|{r[0]}|{r[1] or ''}".encode()).hexdigest())
    assert got == sorted(map(str, by_hash[:n]))


def test_subsample_refines_a_crowded_cut(spark, monkeypatch):
    monkeypatch.setattr(sample, "DIGITS", 1)
    df = spark.range(500)
    want = sorted(range(500), key=lambda i: hashlib.md5(f"2|{i}".encode()).hexdigest())[:123]
    assert sorted(r[0] for r in sample.subsample(df, 123, ["id"], 2).collect()) == sorted(want)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 100, 101, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).orderBy("id").select(sample.permuted("id", n, 3)).collect()]
    assert sorted(got) == list(range(n))
    if n >= 97:
        assert got != sorted(got)
        assert got != [r[0] for r in spark.range(n).orderBy("id").select(sample.permuted("id", n, 4)).collect()]


def test_shuffled_blocks_need_no_exchange(spark):
    df = spark.range(100).select(F.lit("t").alias("track"), (F.col("id") + 1).alias("pos"), F.col("id").alias("value"))
    out = sample.shuffle_blocks(df, 7, 100, 1)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    at = {r["pos"]: r["value"] for r in out.collect()}
    assert sorted(at) == list(range(1, 99)) and all(at[p] - at[p - 1] == 1 for p in at if (p - 1) % 7)
