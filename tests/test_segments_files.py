"""Sources whose lines count, tracks as segments, the interval index and scans, against plain Python on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import background, bins, coverage, pieces, regions, segments
from tidepool.operators.staged import staged
from tidepool.sources import files, reads


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "50")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


# --- files ------------------------------------------------------------------------------------------------------------------
def fastq(folder, rng):
    want = []
    for f in range(4):
        text = ""
        for i in range(rng.choice([1, 30, 77])):
            n = rng.randrange(1, 60)
            nucs, quality = "".join(rng.choice("ACGTN") for _ in range(n)), "".join(rng.choice("@+I#5") for _ in range(n))
            text += f"@read {f}.{i}\n{nucs}\n+\n{quality}\n"
            want.append((f"reads{f}.fq", i, f"read {f}.{i}", nucs, quality))
        (folder / f"reads{f}.fq").write_text(text)
    return want


def test_fastq_of_several_files_in_many_ranges(spark, tmp_path, small_ranges):
    want = fastq(tmp_path, random.Random(1))
    (tmp_path / "empty.fq").write_text("")
    (tmp_path / "broken.fq").write_text("@whole\nAC\n+\n@@\n@half\nAC\n")
    got = files.read_fastq(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    assert rows_of(got) == sorted(map(repr, [*want, ("broken.fq", 0, "whole", "AC", "@@")]))


def test_line_numbers_with_blank_and_long_lines(spark, tmp_path, small_ranges):
    lines = {"a.txt": ["", "x" * 1000, "", "y", ""] * 20, "b.txt": ["one"], "c.txt": ["z"] * 300}
    for name, text in lines.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in text))
    got = {(r["file"].rpartition("/")[2], r["line"]): r["value"] for r in files.numbered_lines(spark, str(tmp_path)).collect()}
    assert got == {(name, i): x for name, text in lines.items() for i, x in enumerate(text)}


def test_bed_lines_and_read_ids(spark, tmp_path, small_ranges):
    (tmp_path / "r.bed").write_text("track name=x\nchr1\t4\t9\ta\t0\t+\n\nchr2\t0\t3\n")
    got = files.read_bed(spark, str(tmp_path / "r.bed")).select("line", "chrom", "start", "end", "text").collect()
    assert sorted(map(tuple, got)) == [(1, "1", 5, 9, "chr1\t4\t9\ta\t0\t+"), (3, "2", 1, 3, "chr2\t0\t3")]
    sam = spark.createDataFrame([("id7\t0\tchr1\t5\t9\t4M\t*\t0\t0\tACGT\tIIII",)], "value string")
    assert reads.parse_sam(reads.with_read_ids(sam, "SAM")).select("read_id", "pos").first() == ("id7", 5)
    with pytest.raises(ValueError, match="no read ids"):
        reads.with_read_ids(sam, "preprocessed")


def test_preprocessed_reads_lie_in_ranges(spark, tmp_path):
    """Each file holds a range of positions in order, so statistics tell which files a range of positions needs."""
    import pyarrow.parquet as pq

    rng = random.Random(5)
    (tmp_path / "r.bed").write_text("".join(f"chr{1 + i % 2}\t{p}\t{p + 30}\tn{i}\t0\t+\n" for i, p in enumerate(rng.sample(range(100_000), 4000))))
    reads.preprocess(spark, "BED6", str(tmp_path / "r.bed"), str(tmp_path / "out"), read_ids=True)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000 and back.select("read_id").distinct().count() == 4000
    for chrom in ("1", "2"):
        spans = []
        for path in (tmp_path / "out" / f"chrom={chrom}").glob("*.parquet"):
            pos = pq.read_table(path, columns=["pos"]).column("pos").to_pylist()
            assert pos == sorted(pos)
            spans.append((pos[0], pos[-1]))
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


# --- segments ---------------------------------------------------------------------------------------------------------------
def dense(rows):
    return {(t, p): v for t, s, e, v in rows for p in range(s, e + 1)}


def folded(points):
    out = []
    for (t, p), v in sorted(points.items()):
        if out and out[-1][0] == t and out[-1][2] == p - 1 and out[-1][3] == v:
            out[-1][2] = p
        else:
            out.append([t, p, p, v])
    return sorted(repr(tuple(r)) for r in out)


def numbered(points):
    out, n = {}, {}
    for t, p in sorted(points):
        n[t] = n.get(t, 0) + 1
        out[t, n[t]] = points[t, p]
    return out


SEGMENTS = "track string, start long, end long, value double"


@pytest.fixture
def tracks(spark):
    rng = random.Random(3)
    rows = []
    for t in ("a", "b", "c"):
        p = 1
        for _ in range(60):
            p += rng.choice([0, 0, 1, 7])
            n = rng.choice([1, 2, 5, 40])
            rows.append((t, p, p + n - 1, float(rng.randrange(3))))
            p += n
    return rows, staged(spark.createDataFrame(rows, SEGMENTS), "segments")


@pytest.mark.parametrize("piece", [16, 1 << 20])
def test_paint(spark, piece):
    rng = random.Random(7)
    lines = [(rng.choice("ab"), s, s + rng.choice([0, 3, 10, 400]), float(rng.randrange(4)), f"f{i % 2}", i) for i in range(150) for s in [rng.randrange(1, 500)]]
    lines += [("a", 50, 60, 9.0, "f1", 1000 + i) for i in range(30)]  # a pile
    points = {}
    for t, s, e, v, *_ in sorted(lines, key=lambda r: r[4:]):
        points |= {(t, p): v for p in range(s, e + 1)}
    df = spark.createDataFrame(lines, SEGMENTS + ", file string, line long").repartition(3)
    assert rows_of(segments.paint(df, ["file", "line"], piece)) == folded(points)


def test_one_value_over_a_chromosome_is_one_row(spark):
    df = spark.createDataFrame([("a", 1, 250_000_000, 1.0, 1), ("a", 100_000_000, 100_000_000, 2.0, 2)], SEGMENTS + ", line long")
    assert rows_of(segments.paint(df, ["line"])) == sorted(map(repr, [("a", 1, 99_999_999, 1.0), ("a", 100_000_000, 100_000_000, 2.0), ("a", 100_000_001, 250_000_000, 1.0)]))


def test_segments_equal_dense(spark, tracks):
    rows, df = tracks
    points = dense(rows)
    assert rows_of(segments.joined(df)) == folded(points)
    assert rows_of(segments.from_dense(segments.to_dense(df))) == folded(points)
    areas = [("a", 5, 20), ("a", 15, 33), ("b", 1, 1), ("c", 90, 10_000), ("a", 5, 20)]
    away = {(t, p) for t, s, e in areas for p in range(s, e + 1)}
    near = spark.createDataFrame(areas, "track string, start long, end long")
    assert rows_of(segments.joined(segments.outside(df, near))) == folded({k: v for k, v in points.items() if k not in away})
    assert rows_of(segments.joined(segments.inside(df, near))) == folded({k: v for k, v in points.items() if k in away})
    assert rows_of(segments.exclude(df, near)) == folded(numbered({k: v for k, v in points.items() if k not in away}))
    kept = {p for (t, p), v in points.items() if t == "a" and v > 0 or t == "b" and v > 1}
    assert rows_of(segments.prune_joint(df, {"a": 0, "b": 1, "c": -1000})) == folded(numbered({k: v for k, v in points.items() if k[1] in kept}))
    length = max(p for _, p in points)
    assert rows_of(segments.shift(df, 77, length)) == folded({(t, (p - 1 + 77) % length + 1): v for (t, p), v in points.items()})


# --- interval index ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("few", [250_000, -1])
@pytest.mark.parametrize("long", ["left", "right", "both", "none"])
def test_overlap_join(spark, monkeypatch, few, long):
    monkeypatch.setattr(bins, "FEW", few)
    rng = random.Random(11)

    def make(n, big):
        out = []
        for _ in range(n):
            s = rng.choice([rng.randrange(-50_000, 50_000), rng.randrange(10**9), 2**17 - 3, 2**29 - 1])
            out.append((rng.choice("xy"), s, s + (rng.choice([0, 10, 20_000, 3_000_000, 10**9, 5 * 10**9]) if big else rng.randrange(50))))
        return [*out, ("x", 5, 4), ("x", None, 9), (None, 1, 2), *out[:5]]

    left, right = make(80, long in ("left", "both")), make(80, long in ("right", "both"))
    a, b = spark.createDataFrame(left, "k string, a long, b long"), spark.createDataFrame(right, "k string, c long, d long")
    got = rows_of(bins.overlap_join(a, b, ["k"], "a", "b", "c", "d"))
    fine = lambda rows: [r for r in rows if None not in r and r[1] <= r[2]]
    assert got == sorted(repr((k, s, e, s2, e2)) for k, s, e in fine(left) for k2, s2, e2 in fine(right) if k == k2 and s <= e2 and s2 <= e)


def test_long_regions_are_few_rows(spark):
    df = spark.createDataFrame([(1, 250_000_000), (5, 5), (2**14 - 1, 2**14)], "a long, b long")
    assert bins._entries(df, "a", "b", None).groupBy("a").count().agg(F.max("count")).first()[0] <= 2


def test_region_algebra_equals_positions(spark):
    rng = random.Random(13)
    make = lambda n: [(rng.choice("xy"), s, s + rng.randrange(30)) for _ in range(n) for s in [rng.randrange(1, 2000)]]
    left, right = make(80) + [("x", 7, 9)] * 20, make(60)
    df = lambda r: spark.createDataFrame(r, "chrom string, start long, end long")
    cover = lambda r: {(c, p): 0 for c, s, e in r for p in range(s, e + 1)}
    no_value = lambda d: rows_of(d.select("chrom", "start", "end", F.lit(0)))
    assert no_value(regions.subtract(df(left), df(right))) == folded({k: 0 for k in cover(left) if k not in cover(right)})
    assert no_value(regions.merge(df(left))) == folded(cover(left))
    nearest = {(c, s, e): min(max(s2 - e, s - e2, 0) for c2, s2, e2 in right if c2 == c) for c, s, e in left}
    assert rows_of(regions.nearest(df(left), df(right))) == sorted(repr((*k, v)) for k, v in nearest.items())
    pairs = {}
    for c, s, _ in left:
        for c2, s2, _ in right:
            if c == c2 and abs(s2 // 100 - s // 100) <= 4:
                pairs[s2 // 100 - s // 100] = pairs.get(s2 // 100 - s // 100, 0) + 1
    assert rows_of(regions.distance_histogram(df(left), df(right), 100, 4)) == sorted(repr(x) for x in pairs.items())


def test_subtract_reads_each_table_twice_at_most(spark, tmp_path):
    spark.range(100).selectExpr("'x' AS chrom", "id * 10 AS start", "id * 10 + 5 AS end").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = regions.subtract(t, t.withColumn("start", F.col("start") + 3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4


def test_scan_with_both_directions(spark):
    rows = [(k, p, p % 3) for k in "ab" for p in range(0, 100, 7)]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    got = pieces.scan(df, ("k",), {"s": ("sum", F.col("v")), "n": ("min", F.col("pos"), {"itself": False, "after": True})}, piece=10)
    want = [(k, p, v, sum(x for k2, q, x in rows if k2 == k and q <= p), min((q for k2, q, _ in rows if k2 == k and q > p), default=None)) for k, p, v in rows]
    assert rows_of(got) == sorted(map(repr, want))


# --- backgrounds ------------------------------------------------------------------------------------------------------------
def poisson_by_hand(lam, fdr):
    c, t = math.exp(-lam), 0
    while True:
        t += 1
        c += math.exp(-lam + t * math.log(lam) - math.lgamma(t + 1)) if lam else 0
        if c > 1 - fdr:
            return t


@pytest.mark.parametrize("fdr", [0.05, 1e-6])
def test_thresholds_of_large_means(spark, fdr):
    lams = [0.0, 0.01, 1.0, 37.5, 999.0, 2000.0, 2950.5]
    df = spark.createDataFrame([(x,) for x in lams], "lam double")
    got = {r[0]: r[1] for r in df.select("lam", background.poisson_threshold(F.col("lam"), fdr, 5000)).collect()}
    assert got == {x: poisson_by_hand(x, fdr) for x in lams}


def test_threshold_beyond_the_range_is_an_error(spark):
    df = spark.createDataFrame([(2000.0,)], "lam double")
    with pytest.raises(Exception, match="raise Max_threshold"):
        df.select(background.poisson_threshold(F.col("lam"), 0.05)).collect()


def test_prune_counts_equal_reads_first(spark):
    rows = [("chip", "0", "1", "F", 5, "4M")] * 50 + [("chip", "0", "1", "R", 5, "4M")] * 3 + [("chip", "1", "1", "F", 5, "4M")] * 2 + [("chip", "0", "1", "F", 6, "4M")]
    df = spark.createDataFrame(rows, "sample string, replicate string, chrom string, strand string, pos long, cigar string")
    got = coverage.prune_duplicates(df, 51).groupBy("replicate", "pos", "strand").count()
    assert rows_of(got) == sorted(map(repr, [("0", 5, "F", 50), ("0", 5, "R", 1), ("1", 5, "F", 2), ("0", 6, "F", 1)]))
    assert coverage.prune_duplicates(df, 0).count() == len(rows)
