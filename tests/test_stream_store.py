"""Coverage that arrives in batches and coverage that grows by appends, against one computation over all."""

import random

from tidepool.operators import coverage, peaks
from tidepool.operators.store import CoverageStore
from tidepool.streaming.coverage import CoverageStream

FRAGMENTS = "chrom string, start long, len long"


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def made(n, seed, disorder):
    """Fragments in the order of their positions but for a bounded disorder; the chromosomes side by side."""
    rng = random.Random(seed)
    out = [(c, s, rng.choice([5, 30, 60])) for c in "xy" for s in (rng.randrange(1, 5000) for _ in range(n))]
    return sorted(out, key=lambda f: f[1] + rng.randrange(disorder))


def test_stream_equals_batch(spark, tmp_path):
    frags, batches = made(150, 3, 200), 5
    stream = CoverageStream(str(tmp_path / "out"), late=200, threshold=2, gap=10)
    step = -(-len(frags) // batches)
    states = []
    for i in range(batches):
        df = spark.createDataFrame(frags[i * step : (i + 1) * step], FRAGMENTS)
        stream.batch(df, i)
        if i == 2:
            stream.batch(df, i)  # run again: nothing counts twice
        states.append(spark.read.parquet(f"{stream.out}/state/events/{i}").count())
    stream.finish(spark, batches)
    profile = coverage.profile(coverage.events(spark.createDataFrame(frags, FRAGMENTS)))
    assert rows_of(stream.result(spark, "segments", batches + 1)) == rows_of(coverage.segments(profile))
    want = peaks.all_threshold_peaks(profile, 10).where("thr = 2").select("chrom", "start", "end")
    assert rows_of(stream.result(spark, "peaks", batches + 1)) == rows_of(want)
    assert stream.result(spark, "late", batches + 1).count() == 0
    assert spark.read.parquet(f"{stream.out}/segments/1").count() > 0
    # what is kept lies within the disorder and a fragment's length, whatever came before
    assert max(states) < 2 * len(frags) * (200 + 200 + 60) / 5000 * 2
    assert spark.read.parquet(f"{stream.out}/state/events/{batches}").count() == 0


def test_reads_that_come_too_late_are_told(spark, tmp_path):
    stream = CoverageStream(str(tmp_path / "out"), late=10)
    stream.batch(spark.createDataFrame([("x", 100, 5), ("x", 1000, 5)], FRAGMENTS), 0)
    stream.batch(spark.createDataFrame([("x", 50, 5), ("x", 995, 5), ("z", 1, 5)], FRAGMENTS), 1)
    stream.finish(spark, 2)
    assert rows_of(stream.result(spark, "late", 3)) == [repr(("x", 50, 5))]
    assert rows_of(stream.result(spark, "segments", 3)) == sorted(map(repr, [("x", 100, 105, 1), ("x", 995, 1005, 1), ("z", 1, 6, 1)]))


def test_stream_of_files(spark, tmp_path):
    frags = made(60, 5, 50)
    stream = CoverageStream(str(tmp_path / "out"), late=50)
    for i in range(2):
        spark.createDataFrame(frags[i * 60 : (i + 1) * 60], FRAGMENTS).write.mode("append").parquet(str(tmp_path / "in"))
        stream.start(spark.readStream.schema(FRAGMENTS).parquet(str(tmp_path / "in")), str(tmp_path / "c")).awaitTermination()
    stream.finish(spark, 2)
    profile = coverage.profile(coverage.events(spark.createDataFrame(frags, FRAGMENTS)))
    assert rows_of(stream.result(spark, "segments", 3)) == rows_of(coverage.segments(profile))


def test_appends_equal_one_run(spark, tmp_path):
    frags = made(80, 7, 1)
    store = CoverageStore(str(tmp_path / "s"), 1000)
    thirds = [frags[i::3] for i in range(3)]
    for i, part in enumerate(thirds):
        store.append(spark.createDataFrame(part, FRAGMENTS), i)
    want = rows_of(coverage.profile(coverage.events(spark.createDataFrame(frags, FRAGMENTS))))
    assert rows_of(store.profile(spark)) == want
    # again under its number: nothing changes, and nothing is written
    assert store.append(spark.createDataFrame(thirds[2], FRAGMENTS), 2) == 0
    assert rows_of(store.profile(spark)) == want
    # one fragment over a border: two of twelve pieces are rewritten
    assert store.append(spark.createDataFrame([("x", 1990, 20)], FRAGMENTS), 3) == 2
    assert rows_of(store.profile(spark)) == rows_of(coverage.profile(coverage.events(spark.createDataFrame([*frags, ("x", 1990, 20)], FRAGMENTS))))


def test_a_failed_append_is_finished_under_its_number(spark, tmp_path):
    store = CoverageStore(str(tmp_path / "s"), 1000)
    store.append(spark.createDataFrame([("x", 10, 5), ("x", 2500, 5)], FRAGMENTS), 0)
    # half of append 1 got through
    store.append(spark.createDataFrame([("x", 20, 5)], FRAGMENTS), 1)
    assert store.append(spark.createDataFrame([("x", 20, 5), ("x", 2600, 5)], FRAGMENTS), 1) == 1
    want = [("x", 10, 5), ("x", 20, 5), ("x", 2500, 5), ("x", 2600, 5)]
    assert rows_of(store.profile(spark)) == rows_of(coverage.profile(coverage.events(spark.createDataFrame(want, FRAGMENTS))))
