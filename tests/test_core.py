"""Worked examples and properties of the core operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tidepool.functions.cigar import match_blocks
from tidepool.operators import background, coverage, peaks, pieces, regions, score, signal
from tidepool.plans.cli import read_config, settings_of
from tidepool.sources import reads, sinks
from tidepool.streaming import ingest


def frags(spark, pairs):
    return spark.createDataFrame([("1", a, n) for a, n in pairs], "chrom string, start long, len long")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


FIVE = [(100, 200), (150, 200), (160, 200), (500, 200), (520, 200)]


@pytest.mark.parametrize(("gap", "expected"), [(200, [(1, 100, 719), (2, 150, 699), (3, 160, 299)]), (100, [(1, 100, 359), (1, 500, 719), (2, 150, 349), (2, 520, 699), (3, 160, 299)])])
def test_peaks_example(spark, gap, expected):
    profile = coverage.profile(coverage.events(frags(spark, FIVE)))
    assert rows(peaks.all_threshold_peaks(profile, gap), "thr", "start", "end") == expected


def brute_peaks(pairs, gap):
    at = {}
    for a, n in pairs:
        for p in range(a, a + n):
            at[p] = at.get(p, 0) + 1
    out = []
    for t in range(1, max(at.values()) + 1):
        runs = []
        for p in sorted(p for p, h in at.items() if h >= t):
            if runs and p <= runs[-1][1] + 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        merged = []
        for s, e in runs:
            if merged and s <= merged[-1][1] + gap:
                merged[-1][1] = e
            else:
                merged.append([s, e])
        out += [(t, s, e) for s, e in merged]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_peaks_random(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(-50, 900), rng.randint(1, 60)) for _ in range(60)]
    profile = coverage.profile(coverage.events(frags(spark, pairs)), piece=100)  # many pieces
    for gap in (0, 5, 40):
        assert rows(peaks.all_threshold_peaks(profile, gap), "thr", "start", "end") == brute_peaks(pairs, gap)


def test_poisson(spark):
    lams = spark.createDataFrame([(x,) for x in (0.0, 0.2, 1.0, 5.0, 300.0, 900.0)], "lam double")
    assert [r[0] for r in lams.select(background.poisson_threshold(F.col("lam"), 0.05)).collect()] == [1, 1, 3, 9, 329, 950]


def test_binomial(spark):
    cases = [(1, 1, 0.0), (20, 3, -6.654343273), (500, 10, -299.601964273), (5000, 1, -3457.218509628)]
    df = spark.createDataFrame([(n, a) for n, a, _ in cases], "n long, a long")
    got = [r[0] for r in df.select(score.log_binomial_tail(F.col("n"), F.col("a"))).collect()]
    assert all(math.isclose(x, e, abs_tol=1e-8) for x, (_, _, e) in zip(got, cases, strict=True))


def test_cigar(spark):
    df = spark.createDataFrame([(100, c) for c in ("10M5N20M", "5S10M2I3M", "10M4D6M", "10M5X6M", "*", "99999999999M")], "pos long, cigar string")
    assert rows(match_blocks(df), "start", "len") == sorted([(100, 10), (115, 20), (100, 10), (110, 3), (100, 10), (114, 6), (100, 10), (110, 6), (100, 99999999999)])


def test_extend_prune_count_q(spark):
    df = spark.createDataFrame([("F", 1000, 36), ("R", 1000, 36), ("R", 1000, 250)], "strand string, start long, len long")
    assert rows(coverage.extend(df, 200), "start", "len") == [(836, 200), (1000, 200), (1000, 250)]
    copies = spark.createDataFrame([("s", "r", "1", p, k, "5M") for p, k in ((5, "F"), (5, "R"), (5, "F"), (7, "F"))], "sample string, replicate string, chrom string, pos long, strand string, cigar string")
    assert rows(coverage.prune_duplicates(copies, 2), "pos") == [(5,), (5,), (7,)]
    starts = spark.createDataFrame([("chip", "1", 10, 4), ("chip", "1", 25, 1), ("chip", "1", 9, 1)], "sample string, chrom string, start long, c long")
    region = spark.createDataFrame([("1", 30, 40)], "chrom string, start long, end long")
    assert rows(score.count_in_regions(region, starts, 20), "n_chip", "n_ctrl") == [(4, 0)]
    p = spark.createDataFrame([("1", i, i, math.log(x)) for i, x in enumerate((0.02, 0.001, 0.5))], "chrom string, start long, end long, log_p double")
    assert [round(x[0], 9) for x in rows(score.q_values(p), "q")] == [0.003, 0.03, 0.5]


def test_regions(spark):
    a = spark.createDataFrame([("1", 1, 10), ("1", 5, 20), ("1", 40, 50)], "chrom string, start long, end long")
    b = spark.createDataFrame([("1", 8, 12), ("1", 60, 70)], "chrom string, start long, end long")
    assert rows(regions.subtract(a, b), "start", "end") == [(1, 7), (13, 20), (40, 50)]
    assert rows(regions.nearest(a, b), "start", "distance") == [(1, 0), (5, 0), (40, 10)]


def random_regions(seed, n=60):
    rng = random.Random(seed)
    return [(rng.choice("12"), a, a + rng.randint(0, 40)) for a in (rng.randint(1, 900) for _ in range(n))]


def covered(spans, chrom):
    return {p for c, a, b in spans if c == chrom for p in range(a, b + 1)}


@pytest.mark.parametrize("seed", range(2))
def test_regions_in_many_pieces(spark, monkeypatch, seed):
    monkeypatch.setattr(pieces, "PIECE", 50)
    left, right = random_regions(seed), random_regions(seed + 10, 15)
    schema = "chrom string, start long, end long"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    for c in "12":
        merged = rows(regions.merge(a).where(f"chrom = '{c}'"), "chrom", "start", "end")
        assert covered(merged, c) == covered(left, c) and all(x[2] + 1 < y[1] for x, y in zip(merged, merged[1:], strict=False))
        assert covered(rows(regions.subtract(a, b), "chrom", "start", "end"), c) == covered(left, c) - covered(right, c)
    near = {(c, s, e): min(max(s2 - e, s - e2, 0) for c2, s2, e2 in right if c2 == c) for c, s, e in left}
    assert {x[:3]: x[3] for x in rows(regions.nearest(a, b), "chrom", "start", "end", "distance")} == near
    wanted = []
    for c in "12":
        own = sorted(x for x in left if x[0] == c)
        wanted += [(*x, y[1] - x[2]) for x, y in zip(own, own[1:], strict=False)] + [(*own[-1], None)]
    assert sorted(map(str, rows_of(regions.distances(a)))) == sorted(map(str, wanted))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_tracks_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(pieces, "PIECE", 7)
    rng = random.Random(8)
    track = [("t", p, float(rng.choice([1, 1, 1, 2]))) for p in sorted(rng.sample(range(1, 200), 120))]
    df = spark.createDataFrame(track, "track string, pos long, value double")
    assert rows(signal.renumber(df), "pos", "value") == sorted((i, v) for i, (_, _, v) in enumerate(track, 1))
    equal = []
    for _, p, v in track:
        if equal and equal[-1][2] == v:
            equal[-1][1] = p
        else:
            equal.append([p, p, v])
    assert rows(signal.run_lengths(df), "start", "end", "value") == sorted(map(tuple, equal))
    high = {p for _, p, v in track if v == 2}
    starts = sorted(p for p in high if p - 1 not in high)
    wanted = [(s, next(e for e in range(s, 300) if e + 1 not in high)) for s in starts]
    assert rows(signal.runs(df, F.col("value") >= 2, keep_last=True), "start", "end") == wanted
    moved = signal.permute_blocks(df, 5, 200, 3)
    assert moved.count() == df.where("pos <= 200").count() and moved.select("pos").distinct().count() == moved.count()


def test_call_end_to_end(spark, tmp_path):
    from tidepool.plans import cli

    rng = random.Random(5)
    line = lambda p: "\t".join(["r", "0", "chr1", str(p), "30", "36M", "*", "0", "0", "A", "I"]) + "\n"
    spots = [20_000 * k + 500 for k in range(1, 30)]
    ground = lambda n: [1 + int(600_000 * rng.random() ** 3) for _ in range(n)]
    for name, reads_at in (("chip", [rng.choice(spots) + rng.randint(0, 300) for _ in range(1500)] + ground(3000)), ("input", ground(3000))):
        (tmp_path / f"{name}.sam").write_text("".join(map(line, reads_at)))
        cli.main(["preprocess", "SAM", str(tmp_path / f"{name}.sam"), str(tmp_path / name)])
    config = {"Enrichment_mapped_fragment_length": 200, "target_FDR": 0.05, "max_Qvalue": 0.05, "N_Simulations": 2, "Minimum_interpeak_distance": 200, "Background_model": "Poisson", "Mappability_map_file": "none", "ChIP_Seq_reads_data_dirs": f"{tmp_path}/chip {tmp_path}/absent", "Input_reads_data_dirs": f"{tmp_path}/input", "Experiment_id": "e", "Peak_profile_output_dir": f"{tmp_path}/profiles"}
    (tmp_path / "c.txt").write_text("".join(f"{k} {v}\n" for k, v in config.items()))
    cli.main(["call", str(tmp_path / "c.txt"), str(tmp_path / "out")])
    files = list((tmp_path / "out" / "e").glob("part-*.csv"))
    lines = [f.read_text().splitlines() for f in files if f.stat().st_size]
    assert all(x[0] == sinks.title_line() for x in lines) and sinks.title_line().startswith("Chromosome      Begin        End          #_ChIP_Reads")
    found = [x.split() for y in lines for x in y[1:]]
    assert len(found) > 20 and all(len(x) == 11 and float(x[8]) < 0.05 for x in found)
    assert sum(any(s - 400 <= (int(x[1]) + int(x[2])) / 2 <= s + 700 for x in found) for s in spots) > 20
    again = reads.parse_narrowpeak(spark.read.text(str(tmp_path / "out" / "e_narrowPeak")))
    assert rows(again, "start", "end") == sorted((int(x[1]), int(x[2])) for x in found)
    assert spark.read.json(str(tmp_path / "out" / "e_runs")).first()["peaks"] == len(found)
    profiles = spark.read.parquet(str(tmp_path / "profiles"))
    tops = {(r["start"], r["end"]): r["m"] for r in profiles.groupBy("start", "end").agg(F.max("height").alias("m")).collect()}
    assert tops == {(int(x[1]), int(x[2])): int(x[10]) for x in found}
    (tmp_path / "r.bed").write_text("chr1\t100\t900\n")
    cli.main(["simulate", str(tmp_path / "r.bed"), "7", "5", "100", str(tmp_path / "s1"), str(tmp_path / "s2")])
    assert reads.parse_tagalign(spark.read.text(str(tmp_path / "s1"))).count() == 7 and reads.parse_tagalign(spark.read.text(str(tmp_path / "s2"))).count() == 5


def test_window_counts_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bed").write_text("chr1\t5\t9\tn\t0\t+\nchr1\t25\t29\tn\t0\t-\nchr1\t26\t29\tn\t0\t-\n")
    counted = ingest.window_counts(ingest.stream_reads(spark, "BED6", str(tmp_path / "in")), 20)
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("counted"), "chrom", "win", "n") == [("1", 0, 1), ("1", 1, 2)]


def test_missing_folder_is_empty(spark, tmp_path):
    assert reads.read_pool(spark, [str(tmp_path / "none")]).count() == 0


def test_preprocess_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.sam").write_text("@HD\n" + "\t".join(["r1", "16", "chr1", "7", "30", "5M", "*", "0", "0", "ACGTA", "IIIII"]) + "\n" + "\t".join(["r2", "4", "chr1", "7", "30", "5M", "*", "0", "0", "A", "I"]) + "\nbroken\n")
    for _ in range(2):
        reads.preprocess(spark, "SAM", str(src), str(tmp_path / "out"))
    assert rows(reads.read_pool(spark, [str(tmp_path / "out")]), "strand", "pos", "cigar") == [("R", 7, "5M")] * 2
    ingest.append_reads(ingest.stream_reads(spark, "SAM", str(src)), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "s")), "pos") == [(7,)]


def test_config():
    given = read_config(["# c", "target_FDR 0.1", "target_FDR 0.2", "lonely", *[f"{k} 1" for k in ("Enrichment_mapped_fragment_length", "max_Qvalue", "N_Simulations", "Minimum_interpeak_distance", "Mappability_map_file", "Experiment_id")], "Background_model Poisson", "ChIP_Seq_reads_data_dirs a b", "Input_reads_data_dirs c"])
    assert given["ChIP_Seq_reads_data_dirs"] == ["a", "b"] and settings_of(given).fdr == 0.1
    with pytest.raises(ValueError, match="missing"):
        settings_of({})


def test_entry_and_names():
    q, o = driver.queries(), driver.oracle_sql()
    assert set(o) <= set(q) and len(o) > 70
