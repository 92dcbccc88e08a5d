"""Regions ask for the thresholds of windows that peaks touch, however long the chromosome is."""

from tidepool.operators import peaks
from tidepool.plans.calls import Run, Settings


def test_only_touched_windows_take_part_in_regions(spark):
    spots = (100, 999_900, 5_000_000, 400_000_000_000)
    rows = [("chip", "1", "c", "F", p + i, "50M") for p in spots for i in (0, 3, 9)] + [("control", "1", "c", "F", p, "50M") for p in spots]
    reads = spark.createDataFrame(rows, "sample string, replicate string, chrom string, strand string, pos long, cigar string")
    run = Run(reads, Settings())
    got = run.regions
    assert sorted(r.win for r in run.touched.collect()) == [0, 1, 5, 400_000]
    assert any(p.count() == 4 for p in run._kept if "n_mappable" in p.columns)
    # as with the thresholds of all 400,001 windows
    want = peaks.stitch(run.all_peaks, run.thresholds, 200, 1_000_000)
    assert run.thresholds.count() == 400_001
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
