"""Tasks are sized by rows: large tables are dealt to more tasks, small ones are left to Spark, and results stay the same."""

import random

from pyspark.sql import functions as F

from tidepool.operators import coverage, peaks, pieces, regions, staged
from tidepool.streaming.coverage import CoverageStream

from .test_spread import parts_of, plan_of

READS = "sample string, replicate string, chrom string, strand string, pos long, cigar string"


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_tasks_of_many_rows_are_dealt(spark, monkeypatch):
    df = spark.range(500)
    assert parts_of(staged.dealt(df, 500, "id")) == []
    monkeypatch.setattr(staged, "PER_TASK", 100)
    assert parts_of(staged.dealt(df, 500, "id")) == [5]
    assert parts_of(staged.dealt(df, 101, "id")) == [2]
    assert staged.dealt(df, 100, "id") is df


def test_pruning_is_dealt_by_reads(spark, monkeypatch):
    pile = [("chip", "0", "1", "F", 5, "4M")] * 300 + [("chip", "0", "1", "R", 5, "4M")] * 30
    reads = spark.createDataFrame(pile + [("chip", str(i % 2), "1", "F", 6 + i // 3, "4M") for i in range(200)], READS).repartition(4)
    got = {}
    for most in (10_000, 100):
        monkeypatch.setattr(staged, "PER_TASK", most)
        for cap in (1, 2, 310):
            kept = coverage.prune_duplicates(reads, cap)
            assert parts_of(kept)[:2].count(6) == (2 if most == 100 else 0)
            got.setdefault(cap, []).append(rows_of(kept))
    for cap, (small, large) in got.items():
        assert small == large
    at_5 = {cap: [r for r in small if "'1', " in r and ", 5, " in r] for cap, (small, _) in got.items()}
    assert {cap: (sum("'F'" in r for r in rows), sum("'R'" in r for r in rows)) for cap, rows in at_5.items()} == {1: (1, 0), 2: (2, 0), 310: (300, 10)}


def test_scans_are_dealt_and_pieces_nest(spark, monkeypatch):
    rng = random.Random(5)
    data = [(k, rng.randrange(-50_000, 50_000), rng.randrange(9)) for k in "ab" for _ in range(150)] + [("c", 10**12, 1)]
    df = spark.createDataFrame(data, "k string, pos long, v long")
    measures = {"s": ("sum", F.col("v")), "m": ("max", F.struct("v", "pos"), {"itself": False}), "n": ("min", F.col("v"), {"itself": False, "after": True})}
    want = rows_of(pieces.scan(df, ("k",), measures, ties=("v",)))
    monkeypatch.setattr(staged, "PER_TASK", 50)
    for piece in (10, 100_000_000):
        assert rows_of(pieces.scan(df, ("k",), measures, ties=("v",), piece=piece)) == want
    monkeypatch.setattr(pieces, "MANY", 20)
    monkeypatch.setattr(pieces, "NESTED", 10)
    nested = pieces.scan(df, ("k",), measures, ties=("v",), piece=10)
    assert parts_of(nested)[0] == 7
    assert rows_of(nested) == want


def test_streams_are_dealt_by_rows(spark, monkeypatch, tmp_path):
    rng = random.Random(7)
    frags = sorted(((c, rng.randrange(1, 9000), rng.choice([5, 40])) for c in "xy" for _ in range(200)), key=lambda f: f[1])
    kind, seen, dealt = "chrom string, start long, len long", [], staged.dealt
    monkeypatch.setattr(staged, "PER_TASK", 50)
    monkeypatch.setattr("tidepool.streaming.coverage.dealt", lambda df, rows, *cols: seen.append(rows) or dealt(df, rows, *cols))
    stream = CoverageStream(str(tmp_path / "out"), late=100, threshold=2, gap=10)
    for i in range(2):
        stream.batch(spark.createDataFrame(frags[i * 200 : (i + 1) * 200], kind).repartition(4), i)
    stream.finish(spark, 2)
    assert seen[0] == 400 and 400 < seen[1] < 500
    profile = coverage.profile(coverage.events(spark.createDataFrame(frags, kind)))
    assert rows_of(stream.result(spark, "segments", 3)) == rows_of(coverage.segments(profile))
    assert rows_of(stream.result(spark, "peaks", 3)) == rows_of(peaks.all_threshold_peaks(profile, 10).where("thr = 2").select("chrom", "start", "end"))


def test_the_first_batch_of_a_stream_is_not_dealt_by_chromosome(spark, tmp_path):
    before = CoverageStream(str(tmp_path / "none"))._read(spark, "bounds", -1, "chrom string, last bigint, closed bigint")
    assert before.dtypes == [("chrom", "string"), ("last", "bigint"), ("closed", "bigint")]
    told = spark.range(5).select(F.lit("x").alias("chrom")).join(before.select("chrom", "closed"), "chrom", "left")
    assert "Join" not in plan_of(told)
    assert told.count() == 5


def test_merging_is_dealt_by_regions(spark, monkeypatch):
    df = spark.range(300).select(F.lit("c").alias("chrom"), (F.col("id") * 7 % 1000).alias("start"), (F.col("id") * 7 % 1000 + 3).alias("end"))
    want, seen, dealt = rows_of(regions.merge(df, 2)), [], staged.dealt
    monkeypatch.setattr(staged, "PER_TASK", 50)
    monkeypatch.setattr(regions, "dealt", lambda df, rows, *cols: seen.append((rows, cols)) or dealt(df, rows, *cols))
    assert rows_of(regions.merge(df, 2)) == want
    assert seen == [(300, ("chrom", "start"))]
