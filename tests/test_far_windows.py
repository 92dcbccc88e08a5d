"""Chromosomes with very many windows: only those with reads are drawn, none are broadcast, and all are dealt to tasks."""

import random

from tidepool import queries
from tidepool.operators import background, coverage, peaks, staged
from tidepool.plans.calls import Run, Settings
from tidepool.sources import reads as sources

from .test_dealt import rows_of
from .test_spread import parts_of


def far_reads(spark):
    rows = [("chip", "1", "c", "F", p + i, "50M") for p in (100, 5_000_000, 400_000_000_000) for i in (0, 3, 9)]
    return spark.createDataFrame(rows + [("control", "1", "c", "F", 7, "50M")], "sample string, replicate string, chrom string, strand string, pos long, cigar string")


def test_thresholds_draw_windows_with_reads_alone(spark, monkeypatch):
    drawn, simulate = [], background.simulate_windows
    monkeypatch.setattr(background, "simulate_windows", lambda reads, windows, *more: drawn.append(windows) or simulate(reads, windows, *more))
    run = Run(far_reads(spark), Settings(model="Simulated"))
    got = run.thresholds
    assert sorted(r.win for r in drawn[0].collect()) == [0, 5, 400_000]
    assert got.count() == 400_001
    given = Run(far_reads(spark), Settings(model="Simulated"), sources.full_mappability(run.fragments))
    assert rows_of(given.thresholds.where("thr > 0")) == rows_of(got.where("thr > 0")) != []


def test_peak_counts_draw_windows_with_reads_alone(spark, monkeypatch, tmp_path):
    lines = ("id AS l_orderkey", "id % 2 * 300000L + 1 AS l_partkey", "1 AS l_linenumber", "9 AS l_quantity", "if(id < 40, 'R', 'N') AS l_returnflag", "'O' AS l_linestatus")
    spark.range(44).selectExpr(*lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    drawn, simulate = [], background.simulate_windows
    monkeypatch.setattr(background, "simulate_windows", lambda reads, windows, *more: drawn.append(windows) or simulate(reads, windows, *more))
    monkeypatch.setattr(staged, "PER_TASK", 15)
    out = queries.simulated_peak_counts(spark, str(tmp_path))
    assert sorted(r.win for r in drawn[0].collect()) == [0, 90_000]
    assert parts_of(out) == [-(-4 * 40 * 10 // 15), 2]  # a read that is drawn is four rows; two windows are drawn ten times
    assert {r.win for r in out.collect()} == {0, 90_000}


def test_windows_of_a_map_are_not_broadcast(spark, monkeypatch):
    seen, keep = [], background.staged
    monkeypatch.setattr(background, "staged", lambda df, name: seen.append(df) or keep(df, name))
    reads = spark.createDataFrame([("c", w, 5) for w in (0, 7)], "chrom string, win long, n long")
    fragments = spark.createDataFrame([("c", 30_000_000_000, 50)], "chrom string, start long, len long")
    background.simulate_windows(reads, sources.full_mappability(fragments), 20, 10, 7, 15)
    assert sorted((r.win, r.n_mappable) for r in seen[0].collect()) == [(0, 1_000_000), (7, 1_000_000)]
    assert "BroadcastHashJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_windows_are_dealt_in_blocks(spark, monkeypatch):
    ends = spark.createDataFrame([("a", 25_000_000_100, 50), ("b", 100, 50), ("d", -9_000_000, 50)], "chrom string, start long, len long")
    given = spark.createDataFrame([("a", 3, 9), ("a", 25_000, 8), ("b", 0, 7)], "chrom string, win long, n_mappable long")
    for block in (10_000, 7):
        monkeypatch.setattr(sources, "BLOCK", block)
        full, filled = sources.full_mappability(ends), sources.fill_mappability(given)
        for out in (full, filled):
            assert parts_of(out) == [3 * spark.sparkContext.defaultParallelism]
            assert sorted((r.chrom, r.win) for r in out.collect()) == [("a", w) for w in range(25_001)] + [("b", 0)]
        assert full.where("n_mappable = 1000000").count() == 25_002
        assert rows_of(filled.where("n_mappable > 0")) == rows_of(given)


def test_thresholds_of_many_windows_are_dealt(spark, monkeypatch):
    rng = random.Random(3)
    sim = {("c", w, t): rng.randrange(1, 60) // t + 1 for w in range(80) for t in range(1, rng.randrange(2, 12)) if rng.random() < 0.8}
    real = {("c", w, t): rng.randrange(1, 90) for w in range(90) for t in range(1, rng.randrange(2, 12)) if rng.random() < 0.8}
    simulated = spark.createDataFrame([(*k, v) for k, v in sim.items()], "chrom string, win long, thr long, total long")
    counts = spark.createDataFrame([(c, t, w, v) for (c, w, t), v in real.items()], "chrom string, thr long, win long, n long")
    windows = spark.createDataFrame([("c", w, 0 if w % 9 == 0 else 100) for w in range(100)], "chrom string, win long, n_mappable long")
    want = {w: (0 if w % 9 == 0 else least(w, sim, real)) for w in range(100)}
    assert len(set(want.values())) > 3
    for most in (10**6, 20):
        monkeypatch.setattr(staged, "PER_TASK", most)
        got = background.simulated_thresholds(simulated, counts, windows, 10, 0.05)
        rows = len(sim) + len(real)
        assert parts_of(got) == ([] if most > 20 else [5, 5, -(-rows // 20)])
        assert {r.win: r.thr for r in got.collect()} == want


def least(w, sim, real):
    at = lambda d, t: d.get(("c", w, t), 0)
    most = max((t for d in (sim, real) for _, v, t in d if v == w), default=0) + 1
    enough = lambda t: at(real, t) > 0 and at(sim, t) <= 0.5 * at(real, t)
    if most > 1 and enough(1) and at(sim, 1) > at(sim, 2):
        return 1
    falls = [t for t in range(2, most + 1) if at(sim, t - 1) > at(sim, t)]
    return next((t for t in range(falls[0], most + 1) if at(real, t) == 0 or enough(t)), 0) if falls else 0


def test_crossings_are_dealt_by_their_number(spark, monkeypatch):
    rng = random.Random(4)
    frags = [(c, rng.randrange(1, 5000), rng.choice([5, 40])) for c in "xy" for _ in range(200)]
    profile = staged.staged(coverage.profile(coverage.events(spark.createDataFrame(frags, "chrom string, start long, len long"))), "profile")
    want = rows_of(peaks.all_threshold_peaks(profile, 10, 4))
    crossed = sum(min(max(r.height, r.prev_height), 4) - min(r.height, r.prev_height, 4) for r in profile.collect())
    monkeypatch.setattr(staged, "PER_TASK", 50)
    dealt = peaks.all_threshold_peaks(profile, 10, 4)
    assert parts_of(dealt) == [-(-crossed // 50), -(-profile.count() // 50)]  # the second deals the scan
    assert rows_of(dealt) == want
