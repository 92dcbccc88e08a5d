"""Work that few or short rows start is dealt to all cores, and gives what it gave before."""

from pyspark.sql import functions as F

from tidepool.operators import background, bins, score, simulate
from tidepool.operators.staged import PER_TASK, tasks_for


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def parts_of(df):
    return [int(line.split("RepartitionByExpression")[1].rsplit("], ", 1)[1].split()[0].rstrip(",")) for line in plan_of(df).splitlines() if "RepartitionByExpression" in line]


def test_tasks_follow_the_rows_to_be_made(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 10) == 1
    assert tasks_for(spark, PER_TASK) == 3 * cores
    assert tasks_for(spark, 1000 * PER_TASK + 1) == 1001


def test_simulated_reads_are_drawn_in_many_tasks(spark):
    reads = spark.createDataFrame([("c", 0, 9000), ("c", 1, 5)], "chrom string, win long, n long")
    mapped = spark.createDataFrame([("c", 0, 100_000), ("c", 1, 50)], "chrom string, win long, n_mappable long")
    out = background.simulate_windows(reads, mapped, 20, 10, 7, 15)
    assert parts_of(out) == [3 * spark.sparkContext.defaultParallelism]
    # against plain Python
    drawn = [r for r in placed(reads, mapped)]
    want = {}
    for win in (0, 1):
        for sim in range(10):
            starts = [p for w, s, p in drawn if (w, s) == (win, sim)]
            for thr, n in peaks_of(starts, 20, 15 + 1).items():
                want[win, thr] = want.get((win, thr), 0) + n
    assert {(r.win, r.thr): r.total for r in out.collect()} == want


def placed(reads, mapped):
    code = "(ascii(chrom) * 31 + length(chrom))"
    rows = reads.join(mapped, ["chrom", "win"]).selectExpr("*", "explode(sequence(0, 9)) AS sim").selectExpr("*", "explode(sequence(1L, n)) AS read")
    return map(tuple, rows.selectExpr("win", "sim", f"({background.uniform([code, 'win', 'sim', 'read'], 7)} * (n_mappable + 1)) div 2147483647").collect())


def peaks_of(starts, length, gap):
    """Merged runs per threshold; one that starts at 0 does not count unless it is the only one."""
    change = {}
    for s in starts:
        change[s] = change.get(s, 0) + 1
        change[s + length] = change.get(s + length, 0) - 1
    steps, height = [], 0
    for pos in sorted(change):
        height += change[pos]
        steps.append((pos, height))
    out = {}
    for thr in range(1, max(h for _, h in steps) + 1):
        found, end = [], None
        for (pos, h), (after, _) in zip(steps, [*steps[1:], (None, 0)]):
            if h >= thr:
                if end is None or pos > end + gap:
                    found.append(pos)
                end = after - 1
        out[thr] = len(found) - (1 if len(found) > 1 and found[0] <= 0 else 0)
    return out


def test_long_regions_meet_in_many_tasks(spark):
    left = spark.range(3).select(F.lit("c").alias("k"), F.lit(1).cast("long").alias("a"), (F.col("id") + 10**9).alias("b"))
    right = spark.range(200).select(F.lit("c").alias("k"), (F.col("id") * 1000).alias("c"), (F.col("id") * 1000 + 10).alias("d"))
    for met in (bins.overlap_join(left, right, ["k"], "a", "b", "c", "d"), bins.overlap_join(right, left, ["k"], "c", "d", "a", "b")):
        assert met.count() == 3 * 200
        assert parts_of(met) == [3 * spark.sparkContext.defaultParallelism]


def test_log_tails_are_taken_once_a_pair(spark):
    df = spark.createDataFrame([(i % 7 * 3, i % 5) for i in range(500)] + [(None, 3), (4, None), (5, -2), (3, 9)], "n long, upto long")
    got = score.with_log_tail(df, "n", "upto").select("n", "upto", "log_p")
    want = df.withColumn("log_p", score.log_binomial_tail(F.col("n"), F.col("upto")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "aggregate(" not in plan_of(got)  # the steps ran on pairs, not on rows


def test_fragments_are_drawn_in_many_tasks(spark):
    regions = spark.range(1000).coalesce(1).select(F.lit("c").alias("chrom"), (F.col("id") * 500).alias("start"), (F.col("id") * 500 + 99).alias("end"), F.col("id").alias("key"))
    for chip in (True, False):
        out = simulate.simulate_fragments(regions, 30, 100, 5, chip)
        assert parts_of(out) == [3 * spark.sparkContext.defaultParallelism]
        assert out.count() == 30_000
