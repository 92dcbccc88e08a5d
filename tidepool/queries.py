"""Queries over the derived views, each with the DuckDB query that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cigar, logmath, strings
from .operators import background, coverage, normalize, peaks, regions, sample, score, segments, signal, simulate, store
from .operators.staged import new_path, staged
from .plans.calls import Run, Settings
from .sources import files, sinks
from .sources import reads as sources
from .streaming.coverage import CoverageStream

SET = Settings()
QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# --- derived views --------------------------------------------------------------------------------------------------------
READS = """SELECT CASE WHEN l_returnflag = 'R' THEN 'chip' ELSE 'control' END AS sample, l_linestatus AS replicate,
 'chr' || (1 + l_partkey % 2) AS chrom, CASE WHEN l_linenumber % 2 = 0 THEN 'R' ELSE 'F' END AS strand,
 1 + l_partkey * l_partkey + CASE WHEN l_returnflag = 'R' THEN (l_orderkey * 7 + l_linenumber) % (40 + 60 * (l_partkey % 5)) ELSE (l_orderkey * 7 + l_linenumber) % 1500 END AS pos,
 {cigar} AS cigar FROM {table} WHERE l_returnflag IN ('R', 'N')"""
SIMPLE = "(25 + CAST(l_quantity AS INT)) || 'M'"
SPLICED = "CASE l_linenumber % 4 WHEN 0 THEN '*' WHEN 1 THEN '5S10M2I3M' WHEN 2 THEN CAST(l_quantity AS INT) || 'M' || l_linenumber || 'N20M' ELSE '10M4D6M2X3M' END"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _reads(spark: SparkSession, sf: str, text: str = SIMPLE) -> DataFrame:
    return spark.sql(READS.replace("{table}", "{t}").replace("{cigar}", text), t=_table(spark, sf, "lineitem"))


def _run(spark: SparkSession, sf: str, **more) -> Run:
    return Run(_reads(spark, sf), Settings(**more))


def _cte(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names) + "\n"


_X = "try_cast(replace(cigar, 'M', '') AS BIGINT)"
CTE = {
    "r": READS.format(table="lineitem", cigar=SIMPLE),
    "fr": f"SELECT sample, chrom, CASE WHEN strand = 'R' AND {_X} < 200 THEN pos + {_X} - 200 ELSE pos END AS start, greatest({_X}, 200) AS len FROM r",
    "ev": "SELECT chrom, pos, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT chrom, start AS pos, 1 AS d FROM fr WHERE sample = 'chip' UNION ALL SELECT chrom, start + len, -1 FROM fr WHERE sample = 'chip') GROUP BY ALL HAVING sum(d) <> 0",
    "pr": "SELECT chrom, pos, CAST(sum(delta) OVER w AS BIGINT) AS height, CAST(sum(delta) OVER w - delta AS BIGINT) AS prev_height, lag(pos) OVER w AS prev_pos FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY pos)",
    "cr": "SELECT chrom, pos, height > prev_height AS up, unnest(range(least(height, prev_height) + 1, least(greatest(height, prev_height), 1000) + 1)) AS thr FROM pr",
    "isl": "SELECT chrom, thr, pos AS s, e FROM (SELECT *, lead(pos) OVER (PARTITION BY chrom, thr ORDER BY pos) - 1 AS e FROM cr) WHERE up",
    "isk": "SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, thr ORDER BY s) AS k FROM (SELECT *, lag(e) OVER (PARTITION BY chrom, thr ORDER BY s) AS pe FROM isl)",
    "pk": 'SELECT chrom, thr, min(s) AS start, max(e) AS "end" FROM isk GROUP BY chrom, thr, k',
    "wc": 'SELECT chrom, thr, win, count(*) AS n FROM (SELECT chrom, thr, unnest(range(start // 1000000, "end" // 1000000 + 1)) AS win FROM pk) GROUP BY ALL',
    "mp": "SELECT chrom, unnest(range(max(start + len) // 1000000 + 1)) AS win, 1000000 AS n_mappable FROM fr GROUP BY chrom",
    "rw": "SELECT chrom, CAST(trunc(start / 1000000) AS BIGINT) AS win, count(*) AS n FROM fr WHERE sample = 'chip' GROUP BY ALL",
    "lam": "SELECT mp.chrom, mp.win, coalesce(n, 0) * 200 / CAST(n_mappable AS DOUBLE) AS lam FROM mp LEFT JOIN rw USING (chrom, win)",
    "pt": "SELECT chrom, win, CAST(coalesce(min(t) FILTER (WHERE c > 1 - 0.05), 0) AS BIGINT) AS thr FROM (SELECT chrom, win, t, sum(CASE WHEN lam = 0 THEN CASE WHEN t = 0 THEN 1 ELSE 0 END ELSE exp(-lam + t * ln(lam) - lgamma(t + 1)) END) OVER (PARTITION BY chrom, win ORDER BY t) AS c FROM lam, range(0, 1001) x(t)) WHERE t >= 1 GROUP BY chrom, win",
    "pc": 'SELECT pk.chrom, greatest(start, p.win * 1000000) AS s, least("end", (p.win + 1) * 1000000 - 1) AS e FROM pk JOIN {thr} p ON p.chrom = pk.chrom AND p.thr = pk.thr AND p.thr > 0 AND p.win BETWEEN start // 1000000 AND "end" // 1000000',
    "sk": "SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s) AS k FROM (SELECT *, lag(e) OVER (PARTITION BY chrom ORDER BY s) AS pe FROM pc)",
    "rg": 'SELECT chrom, min(s) AS start, max(e) AS "end" FROM sk GROUP BY chrom, k',
    "bn": "SELECT chrom, start // 10000 AS bin, count(DISTINCT start) FILTER (WHERE sample = 'control') AS x, count(DISTINCT start) FILTER (WHERE sample = 'chip') AS y FROM fr WHERE start >= 0 GROUP BY ALL HAVING x > 0 AND y > 0",
    "sl": "SELECT chrom, round(regr_slope(y, x), 12) AS slope, round(sum(x * y) / CAST(sum(x * x) AS DOUBLE), 12) AS slope_origin, round(corr(x, y), 9) AS pearson FROM bn GROUP BY chrom",
    "st": "SELECT sample, chrom, start, least(count(*), 3) AS c FROM fr GROUP BY ALL",
    "c1": """SELECT rg.chrom, rg.start, "end", coalesce(sum(c) FILTER (WHERE sample = 'chip'), 0) AS n_chip, coalesce(sum(c) FILTER (WHERE sample = 'control'), 0) AS n_ctrl FROM rg LEFT JOIN st ON st.chrom = rg.chrom AND st.start <= rg."end" AND st.start + 200 >= rg.start GROUP BY ALL""",
    "c2": """SELECT rg.chrom, rg.start, "end", coalesce(sum(c), 0) AS wide FROM rg LEFT JOIN st ON st.sample = 'control' AND st.chrom = rg.chrom AND st.start <= rg."end" + 2000 AND st.start + 200 >= CASE WHEN rg.start > 2000 THEN rg.start - 2000 ELSE 1 END GROUP BY ALL""",
    "sc0": 'SELECT c1.*, slope, CASE WHEN "end" - start > 1000 THEN n_ctrl ELSE greatest(n_ctrl, wide * ("end" - start + 1) / CAST("end" - start + 4001 AS DOUBLE)) END AS ctrl FROM c1 JOIN c2 USING (chrom, start, "end") JOIN sl USING (chrom) WHERE slope > 0',
    "sc1": 'SELECT chrom, start, "end", CAST(n_chip AS BIGINT) AS n_chip, CASE WHEN ctrl = 0 THEN 1.0 ELSE ctrl END AS n_ctrl, CAST(greatest(ceil(round(ctrl * slope, 9)), 1) AS BIGINT) AS n_ctrl_adj, slope FROM sc0',
    "sc": 'SELECT chrom, start, "end", n_chip, n_ctrl, n_ctrl_adj, n_chip - n_ctrl_adj AS excess, n_chip / (n_ctrl * slope) AS enrichment, (SELECT max(v) + ln(sum(exp(v - m))) FROM (SELECT v, max(v) OVER () AS m FROM (SELECT lgamma(n_ctrl_adj + n_chip + 1) - lgamma(i + 1) - lgamma(n_ctrl_adj + n_chip - i + 1) AS v FROM range(n_ctrl_adj + 1) x(i)))) - (n_ctrl_adj + n_chip) * ln(2.0) AS log_p FROM sc1',
    "qv": 'SELECT *, row_number() OVER (ORDER BY round(log_p, 9), chrom, start, "end") AS rank, count(*) OVER () AS n_all FROM sc',
    "sg": "SELECT chrom, prev_pos AS p, pos AS q, prev_height AS h FROM pr WHERE prev_height <> 0",
    "sm": 'SELECT chrom, start, "end", h AS max_height, greatest(p, start) AS summit_start, least(q - 1, "end") AS summit_end FROM (SELECT rg.chrom, start, "end", p, q, h, row_number() OVER (PARTITION BY rg.chrom, start, "end" ORDER BY h DESC, p) AS k FROM rg JOIN sg ON sg.chrom = rg.chrom AND p <= "end" AND q > start) WHERE k = 1',
    "cd": """SELECT *, exp(log_p) * n_all / rank AS q, CASE WHEN (summit_start + summit_end) // 2 > start THEN "end" - start ELSE (summit_start + summit_end) // 2 - start END AS summit FROM qv JOIN sm USING (chrom, start, "end")""",
}
CTE["pc"] = CTE["pc"].replace("{thr}", "pt")
BASE = ("r", "fr")
PROFILE = (*BASE, "ev", "pr")
PEAKS = (*PROFILE, "cr", "isl", "isk", "pk")
POISSON = (*PEAKS, "mp", "rw", "lam", "pt")
REGIONS = (*POISSON, "pc", "sk", "rg")
SCORED = (*REGIONS, "bn", "sl", "st", "c1", "c2", "sc0", "sc1", "sc")
CALLED = (*SCORED, "qv", "sg", "sm", "cd")


@query(CTE["r"])
def reads_view(spark, sf):
    return _reads(spark, sf)


@query(_cte(*BASE) + "SELECT * FROM fr")
def fragments_extended(spark, sf):
    return _run(spark, sf).fragments


def _blocks_sql() -> str:
    return "WITH RECURSIVE r AS (" + READS.format(table="lineitem", cigar=SPLICED) + """),
d AS (SELECT DISTINCT cigar FROM r WHERE regexp_full_match(cigar, '([0-9]+[MIDNSHPX=])+')),
s AS (SELECT cigar, regexp_extract_all(cigar, '([0-9]+)[MIDNSHPX=]', 1) AS n, regexp_extract_all(cigar, '[0-9]+([MIDNSHPX=])', 1) AS o FROM d),
t AS (SELECT cigar, i, CAST(n[i] AS BIGINT) AS n, o[i] AS o FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM s)),
b AS (SELECT cigar, i, n, o, coalesce(sum(CASE WHEN o IN ('D', 'M', 'N') THEN n ELSE 0 END) OVER (PARTITION BY cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t)
"""


@query(_blocks_sql() + "SELECT sample, chrom, strand, CAST(pos + off AS BIGINT) AS start, n AS len FROM r JOIN b USING (cigar) WHERE o = 'M'")
def cigar_blocks(spark, sf):
    return cigar.match_blocks(_reads(spark, sf, SPLICED).select("sample", "chrom", "strand", "pos", "cigar"))


@query(_blocks_sql() + "SELECT cigar, regexp_full_match(cigar, '([0-9]+[MIDNSHPX=])+') AS valid, CAST(coalesce(sum(n) FILTER (WHERE o IN ('D', 'M', 'N')), 0) AS BIGINT) AS on_genome, CAST(coalesce(sum(n) FILTER (WHERE o IN ('S', 'M', 'I')), 0) AS BIGINT) AS on_read FROM (SELECT DISTINCT cigar FROM r) LEFT JOIN t USING (cigar) GROUP BY cigar")
def cigar_span(spark, sf):
    c = F.col("cigar")
    return _reads(spark, sf, SPLICED).select("cigar").distinct().select("cigar", cigar.is_valid(c).alias("valid"), cigar.advance(c, cigar.ON_GENOME).alias("on_genome"), cigar.advance(c, cigar.ON_READ).alias("on_read"))


@query(_cte("r") + "SELECT sample, replicate, chrom, pos, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sample, replicate, chrom, pos ORDER BY strand, cigar) AS k FROM r) WHERE k <= 1 GROUP BY ALL")
def prune_duplicates(spark, sf):
    return coverage.prune_duplicates(_reads(spark, sf), 1).groupBy("sample", "replicate", "chrom", "pos").agg(F.count("*").alias("n"))


@query(_cte(*BASE) + "SELECT sample, chrom, CAST(trunc(start / 1000000) AS BIGINT) AS win, count(*) AS n FROM fr GROUP BY ALL")
def reads_per_window(spark, sf):
    return coverage.reads_per_window(_run(spark, sf).fragments, SET.window)


@query(_cte(*BASE, "bn") + "SELECT * FROM bn")
def bin_counts(spark, sf):
    return normalize.bin_counts(_run(spark, sf).fragments)


@query(_cte(*BASE) + "SELECT chrom, greatest(CAST(trunc(start / 10000) AS BIGINT), 0) AS bin, count(DISTINCT start) FILTER (WHERE sample = 'control') AS x, count(DISTINCT start) FILTER (WHERE sample = 'chip') AS y FROM fr WHERE start >= 0 OR sample = 'control' GROUP BY ALL HAVING x > 0 AND y > 0")
def bin_counts_compat(spark, sf):
    return normalize.bin_counts(_run(spark, sf).fragments, compat=True)


@query(_cte(*BASE, "bn", "sl") + "SELECT chrom, slope FROM sl")
def scaling_factor(spark, sf):
    return _run(spark, sf).slopes.select("chrom", "slope")


@query(_cte(*BASE, "bn", "sl") + "SELECT chrom, slope_origin FROM sl")
def slope_origin(spark, sf):
    return _run(spark, sf).slopes.select("chrom", "slope_origin")


@query(_cte(*BASE, "bn", "sl") + "SELECT chrom, pearson FROM sl")
def pearson_bins(spark, sf):
    return _run(spark, sf).slopes.select("chrom", "pearson")


@query(_cte(*BASE, "ev") + "SELECT * FROM ev")
def coverage_events(spark, sf):
    return _run(spark, sf).events


@query(_cte(*PROFILE) + "SELECT * FROM pr")
def coverage_profile(spark, sf):
    return _run(spark, sf).profile


@query(_cte(*PROFILE) + "SELECT * FROM pr")
def coverage_appended(spark, sf):
    """Three appends, by a hash of the fragments, give the profile of all."""
    chip = staged(_run(spark, sf).chip.select("chrom", "start", "len"), "chip")
    stored = store.CoverageStore(new_path(spark, "store"))
    for i in range(3):
        stored.append(chip.where(F.pmod(F.xxhash64("chrom", "start", "len"), F.lit(3)) == i), i)
    return stored.profile(spark)


def _streamed(spark, sf, name):
    """The chip fragments in three batches of rising positions, each read as it arrives, and the end."""
    chip = staged(_run(spark, sf).chip.select("chrom", "start", "len"), "chip")
    end = (chip.agg(F.max("start")).first()[0] or 0) + 1
    stream, arriving = CoverageStream(new_path(spark, "stream"), late=2000, threshold=3), new_path(spark, "arriving")
    for i in range(3):
        chip.where(F.greatest(F.floor(F.col("start") * 3 / end), F.lit(0)) == i).write.mode("append").parquet(arriving)
        stream.start(spark.readStream.schema(chip.schema).parquet(arriving), f"{arriving}-checkpoint").awaitTermination()
    stream.finish(spark, 3)
    return stream.result(spark, name, 4)


@query(_cte(*PROFILE, "sg") + "SELECT chrom, p AS pos, q AS next_pos, h AS height FROM sg")
def coverage_streamed(spark, sf):
    return _streamed(spark, sf, "segments")


@query(_cte(*PEAKS) + 'SELECT chrom, start, "end" FROM pk WHERE thr = 3')
def peaks_streamed(spark, sf):
    return _streamed(spark, sf, "peaks")


@query(_cte(*PROFILE, "sg") + "SELECT chrom, p AS pos, q AS next_pos, h AS height FROM sg WHERE q >= 10000 AND p < 200000")
def profile_slice(spark, sf):
    return coverage.profile_slice(coverage.segments(_run(spark, sf).profile), 10_000, 200_000)


@query(_cte(*PEAKS) + "SELECT * FROM pk")
def peaks_all_thresholds(spark, sf):
    return _run(spark, sf).all_peaks


@query(_cte(*PEAKS, "wc") + "SELECT * FROM wc")
def peak_counts_per_window(spark, sf):
    return _run(spark, sf).counts


@query(_cte(*PEAKS) + 'SELECT chrom, thr, count(*) AS n FROM pk WHERE start <= 500000 AND "end" >= 100000 GROUP BY ALL')
def peaks_in_range(spark, sf):
    return peaks.peaks_in_range(_run(spark, sf).all_peaks, 100_000, 500_000)


@query(_cte(*BASE, "mp") + "SELECT chrom, win, CASE WHEN win % 3 = 1 AND win < (SELECT max(win) FROM mp m WHERE m.chrom = mp.chrom) THEN 0 ELSE 100000 + ((win * 37 + 5) % 10) * 100000 END AS n_mappable FROM mp")
def mappability_filled(spark, sf):
    full = sources.full_mappability(_run(spark, sf).fragments)
    last = full.groupBy("chrom").agg(F.max("win").alias("last"))
    given = full.join(last, "chrom").where("win % 3 <> 1 OR win = last").select("chrom", "win", F.expr("100000 + ((win * 37 + 5) % 10) * 100000").alias("n_mappable"))
    return sources.fill_mappability(given)


@query(_cte(*POISSON) + "SELECT * FROM pt")
def poisson_thresholds(spark, sf):
    return _run(spark, sf).thresholds


_CODE = "(ascii(chrom) * 31 + length(chrom))"
_SIM = {
    "dr": f"SELECT chrom, win, sim, CAST(({background.uniform([_CODE, 'win', 'sim', 'read'], SET.seed)} * (n_mappable + 1)) // 2147483647 AS BIGINT) AS b FROM (SELECT rw.chrom, rw.win, n_mappable, sim, unnest(range(1, n + 1)) AS read FROM rw JOIN mp USING (chrom, win), range(10) x(sim) WHERE n > 0 AND n_mappable > 0)",
    "sev": "SELECT chrom, win, sim, pos, sum(d) AS d FROM (SELECT chrom, win, sim, b AS pos, 1 AS d FROM dr UNION ALL SELECT chrom, win, sim, b + 200, -1 FROM dr) GROUP BY ALL HAVING sum(d) <> 0",
    "spr": "SELECT *, CAST(sum(d) OVER w AS BIGINT) AS h, CAST(sum(d) OVER w - d AS BIGINT) AS h0 FROM sev WINDOW w AS (PARTITION BY chrom, win, sim ORDER BY pos)",
    "scr": "SELECT chrom, win, sim, pos, h > h0 AS up, unnest(range(least(h, h0) + 1, greatest(h, h0) + 1)) AS thr FROM spr",
    "sis": "SELECT * FROM (SELECT *, pos AS s, lead(pos) OVER (PARTITION BY chrom, win, sim, thr ORDER BY pos) - 1 AS e FROM scr) WHERE up",
    "ssk": "SELECT *, CASE WHEN pe IS NULL OR s > pe + 201 THEN 1 ELSE 0 END AS o FROM (SELECT *, lag(e) OVER (PARTITION BY chrom, win, sim, thr ORDER BY s) AS pe FROM sis)",
    "sct": "SELECT chrom, win, sim, thr, sum(o) - CASE WHEN sum(o) > 1 AND min(s) <= 0 THEN 1 ELSE 0 END AS c FROM ssk GROUP BY ALL",
    "stt": "SELECT chrom, win, thr, CAST(sum(c) AS BIGINT) AS total FROM sct GROUP BY ALL",
    "gr": "SELECT chrom, win, unnest(range(1, least(max(thr) + 1, 1000) + 1)) AS thr FROM (SELECT chrom, win, thr FROM stt UNION ALL SELECT chrom, win, thr FROM wc) GROUP BY chrom, win",
    "de": "SELECT *, lag(total) OVER w AS before, lead(total) OVER w AS after FROM (SELECT gr.*, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM gr LEFT JOIN stt USING (chrom, win, thr) LEFT JOIN wc USING (chrom, win, thr)) WINDOW w AS (PARTITION BY chrom, win ORDER BY thr)",
    "fl": "SELECT *, min(CASE WHEN before > total THEN thr END) OVER (PARTITION BY chrom, win) AS t0 FROM de",
    "ch": "SELECT chrom, win, min(thr) AS thr FROM fl WHERE (thr = 1 AND n > 0 AND total <= 0.5 * n AND total > after) OR (thr >= t0 AND (n = 0 OR total <= 0.5 * n)) GROUP BY ALL",
    "tt": "SELECT mp.chrom, mp.win, CAST(coalesce(thr, 0) AS BIGINT) AS thr FROM mp LEFT JOIN ch USING (chrom, win)",
}
CTE |= _SIM
SIMULATED = (*PEAKS, "wc", "mp", "rw", *_SIM)


@query(_cte(*PEAKS, "wc", "mp", "rw", *list(_SIM)[:8]) + "SELECT * FROM stt")
def simulated_peak_counts(spark, sf):
    return _run(spark, sf).simulated()


@query(_cte(*SIMULATED) + "SELECT * FROM tt")
def simulated_thresholds(spark, sf):
    return _run(spark, sf, model="Simulated").thresholds


@query(_cte(*REGIONS) + "SELECT * FROM rg")
def selected_regions(spark, sf):
    return _run(spark, sf).regions


@query(_cte(*REGIONS, "st", "c1") + 'SELECT chrom, start, "end", CAST(n_chip AS BIGINT) AS n_chip, CAST(n_ctrl AS BIGINT) AS n_ctrl FROM c1')
def region_read_counts(spark, sf):
    run = _run(spark, sf)
    found = run.regions  # makes the fragments a table, which the starts then read
    starts = run.fragments.groupBy("sample", "chrom", "start").agg(F.count("*").alias("c"))
    return score.count_in_regions(found, starts, SET.ext)


@query(_cte(*SCORED) + 'SELECT chrom, start, "end", n_chip, round(n_ctrl, 6) AS n_ctrl, n_ctrl_adj, excess, round(enrichment, 6) AS enrichment, round(log_p, 6) AS log_p FROM sc')
def region_scores(spark, sf):
    return _run(spark, sf).scored().withColumn("n_ctrl", F.round("n_ctrl", 6)).withColumn("enrichment", F.round("enrichment", 6)).withColumn("log_p", F.round("log_p", 6))


@query("SELECT p_partkey, n, upto, round((SELECT max(v) + ln(sum(exp(v - m))) FROM (SELECT v, max(v) OVER () AS m FROM (SELECT lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) AS v FROM range(upto + 1) x(i)))) - n * ln(2.0), 6) + 0.0 AS log_p FROM (SELECT p_partkey, CAST(p_size * 20 AS BIGINT) AS n, CAST(p_partkey % (p_size * 20 + 1) AS BIGINT) AS upto FROM part)")
def binomial_log_p(spark, sf):
    n = _table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 20).cast("bigint").alias("n")).withColumn("upto", (F.col("p_partkey") % (F.col("n") + 1)).cast("bigint"))
    return score.with_log_tail(n, "n", "upto").withColumn("log_p", F.round("log_p", 6) + 0.0)


@query(_cte(*REGIONS, "sg", "sm") + "SELECT * FROM sm")
def region_summits(spark, sf):
    run = _run(spark, sf)
    return score.summits(run.regions, coverage.segments(run.profile))


_Q = 'chrom, start, "end", n_chip, n_ctrl_adj, round(log_p, 6) AS log_p, round(q, 6) AS q'


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in ("log_p", "q", "enrichment") else F.col(c) for c in columns))


@query(_cte(*CALLED) + f"SELECT {_Q}, rank FROM cd")
def peak_qvalues(spark, sf):
    run = _run(spark, sf)
    rounded = run.scored().withColumn("_log_p", F.col("log_p")).withColumn("log_p", F.round("log_p", 9))
    return _rounded(score.q_values(rounded), "chrom", "start", "end", "n_chip", "n_ctrl_adj", "log_p", "q", "rank")


@query(_cte(*CALLED) + f"SELECT {_Q}, round(enrichment, 6) AS enrichment, max_height, summit FROM cd WHERE q < 0.05")
def call_peaks_poisson(spark, sf):
    return _rounded(_run(spark, sf).called(), "chrom", "start", "end", "n_chip", "n_ctrl_adj", "log_p", "q", "enrichment", "max_height", "summit")


@query((_cte(*SIMULATED, *(n for n in CALLED if n not in SIMULATED and n not in ("lam", "pt"))) + f"SELECT {_Q}, round(enrichment, 6) AS enrichment, max_height, summit FROM cd WHERE q < 0.05").replace("JOIN pt p ON", "JOIN tt p ON"))
def call_peaks_simulated(spark, sf):
    return _rounded(_run(spark, sf, model="Simulated").called(), "chrom", "start", "end", "n_chip", "n_ctrl_adj", "log_p", "q", "enrichment", "max_height", "summit")


@query(_cte(*CALLED) + """SELECT chrom, start - 1 AS chrom_start, "end" AS chrom_end, '.' AS name, 0 AS score, '.' AS strand, round(enrichment, 3) AS enrichment, round(-log_p / ln(10.0), 6) AS neg_log10_p, round(q, 6) AS q, summit FROM cd WHERE q < 0.05""")
def narrowpeak_rows(spark, sf):
    return sinks.narrowpeak_rows(_run(spark, sf).called())


@query(_cte(*CALLED) + 'SELECT chrom AS chromosome, start AS begin, "end", n_chip, n_ctrl_adj AS n_control, excess, round(enrichment, 3) AS enrichment, round(log_p, 3) AS log_p, round(q, 3) AS q, summit AS max_position, max_height FROM cd WHERE q < 0.05')
def result_rows(spark, sf):
    return sinks.result_rows(_run(spark, sf).called())


@query(_cte(*CALLED) + """SELECT printf('%-15s %-12d %-12d %-11d %-11d %-6d %-12.3f %-15.3f %-8.3f %-12d %-10d', chrom, start, "end", n_chip, n_ctrl_adj, excess, round(enrichment, 3), round(log_p, 3), round(q, 3), summit, max_height) AS line FROM cd WHERE q < 0.05""")
def result_lines(spark, sf):
    return sinks.result_lines(_run(spark, sf).called()).toDF("line")


@query(_cte(*REGIONS, "sg") + 'SELECT rg.chrom, start, "end", greatest(p, start) AS pos, h AS height FROM rg JOIN sg ON sg.chrom = rg.chrom AND p <= "end" AND q > start')
def peak_profiles(spark, sf):
    run = _run(spark, sf)
    return sinks.peak_profiles(run.regions, coverage.segments(run.profile))


@query(_cte("r") + "SELECT chrom, count(*) AS n FROM r GROUP BY chrom")
def reads_per_chromosome(spark, sf):
    return sources.reads_per_chromosome(_reads(spark, sf))


@query(_cte(*BASE) + "SELECT chrom, start, start + len - 1 AS \"end\", '.' AS name, 1000 AS score, CASE strand WHEN 'F' THEN '+' ELSE '-' END AS strand FROM (SELECT chrom, pos AS start, CAST(replace(cigar, 'M', '') AS BIGINT) AS len, strand FROM r)")
def tagalign_rows(spark, sf):
    return sinks.tagalign_rows(cigar.match_blocks(_reads(spark, sf).select("chrom", "strand", "pos", "cigar")))


# --- regions --------------------------------------------------------------------------------------------------------------
PART = "SELECT 'chr' || (1 + p_partkey % 2) AS chrom, p_partkey * 100 AS start, p_partkey * 100 + p_size * 5 AS \"end\", CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand FROM part"
SUPP = "SELECT 'chr' || (1 + s_suppkey % 2) AS chrom, s_suppkey * 1300 AS start, s_suppkey * 1300 + s_nationkey * 40 AS \"end\", CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '+' END AS strand FROM supplier"
REG = f"WITH a AS ({PART}), b AS ({SUPP})"
MERGED = 'SELECT chrom, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 + {gap} THEN 1 ELSE 0 END AS o FROM {t})) GROUP BY chrom, k'


def _a(spark, sf):
    return spark.sql(PART.replace("FROM part", "FROM {t}").replace('"', "`"), t=_table(spark, sf, "part"))


def _b(spark, sf):
    return spark.sql(SUPP.replace("FROM supplier", "FROM {t}").replace('"', "`"), t=_table(spark, sf, "supplier"))


@query(REG + 'SELECT a.chrom, a.start, a."end", b.start AS start2, b."end" AS end2, least(a."end", b."end") - greatest(a.start, b.start) + 1 AS l_overlap FROM a JOIN b ON a.chrom = b.chrom AND a.start <= b."end" AND b.start <= a."end"')
def region_intersect(spark, sf):
    return regions.intersect(_a(spark, sf), _b(spark, sf))


@query(REG + 'SELECT a.chrom, a.start, a."end", b.start AS start2, b."end" AS end2, least(a."end", b."end") - greatest(a.start, b.start) + 1 AS l_overlap FROM a JOIN b ON a.chrom = b.chrom AND a.strand = b.strand AND a.start <= b."end" AND b.start <= a."end"')
def region_intersect_stranded(spark, sf):
    return regions.intersect(_a(spark, sf), _b(spark, sf), strands=True)


#: Every 40th of the first regions reaches over its chromosome.
_LONG = 'SELECT chrom, CASE WHEN start % 4000 = 0 THEN 1 ELSE start END AS start, CASE WHEN start % 4000 = 0 THEN 1000000000 ELSE "end" END AS "end" FROM a'


@query(REG + f', l AS ({_LONG}) SELECT l.chrom, l.start, l."end", b.start AS start2, b."end" AS end2, least(l."end", b."end") - greatest(l.start, b.start) + 1 AS l_overlap FROM l JOIN b ON l.chrom = b.chrom AND l.start <= b."end" AND b.start <= l."end"')
def region_intersect_long(spark, sf):
    long = F.col("start") % 4000 == 0
    left = _a(spark, sf).withColumns({"start": F.when(long, F.lit(1)).otherwise(F.col("start")), "end": F.when(long, F.lit(1_000_000_000)).otherwise(F.col("end"))})
    return regions.intersect(left.withColumns({c: F.col(c).cast("bigint") for c in ("start", "end")}), _b(spark, sf))


@query(REG + 'SELECT chrom, start, "end", start2, end2, least("end", end2) - greatest(start, start2) + 1 AS l_overlap FROM (SELECT a.chrom, a.start, a."end", b.start AS start2, b."end" AS end2, row_number() OVER (PARTITION BY a.chrom, a.start, a."end" ORDER BY b.start, b."end") AS k FROM a JOIN b ON a.chrom = b.chrom AND a.start <= b."end" AND b.start <= a."end") WHERE k = 1')
def region_intersect_first(spark, sf):
    return regions.intersect(_a(spark, sf), _b(spark, sf), first_only=True)


@query(REG + ' SELECT b.start // 1000 - a.start // 1000 AS distance, count(*) AS n FROM a JOIN b USING (chrom) WHERE abs(b.start // 1000 - a.start // 1000) <= 50 GROUP BY 1')
def region_distance_histogram(spark, sf):
    return regions.distance_histogram(_a(spark, sf), _b(spark, sf), 1000, 50)


@query(REG + MERGED.format(t="a", gap=30))
def region_merge(spark, sf):
    return regions.merge(_a(spark, sf), 30)


@query(REG + """, p AS (SELECT chrom, unnest(range(start, "end" + 1)) AS pos FROM a EXCEPT SELECT chrom, unnest(range(start, "end" + 1)) FROM b),
g AS (SELECT chrom, pos, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS k FROM p) SELECT chrom, min(pos) AS start, max(pos) AS "end" FROM g GROUP BY chrom, k""")
def region_subtract(spark, sf):
    return regions.subtract(_a(spark, sf), _b(spark, sf))


@query(REG + 'SELECT a.chrom, a.start, a."end", min(greatest(b.start - a."end", a.start - b."end", 0)) AS distance FROM (SELECT DISTINCT chrom, start, "end" FROM a) a JOIN b USING (chrom) GROUP BY ALL')
def region_nearest(spark, sf):
    return regions.nearest(_a(spark, sf), _b(spark, sf))


@query(REG + """ SELECT chrom, count(DISTINCT pos) AS covered FROM (SELECT chrom, unnest(range(start, "end" + 1)) AS pos FROM a) GROUP BY chrom""")
def region_coverage(spark, sf):
    return regions.coverage(_a(spark, sf))


@query(REG + """ SELECT chrom, 'left' AS side, greatest(start - 50, 1) AS start, start - 1 AS "end" FROM a WHERE start > 1 UNION ALL SELECT chrom, 'right', "end" + 1, "end" + 50 FROM a""")
def region_flanks(spark, sf):
    return regions.flanks(_a(spark, sf), 50)


@query(REG + ' SELECT chrom, start, "end", lead(start) OVER (PARTITION BY chrom ORDER BY start, "end") - "end" AS distance FROM a')
def region_distances(spark, sf):
    return regions.distances(_a(spark, sf))


@query(REG + """ SELECT chrom, greatest(1, start - CASE WHEN strand = '-' THEN 20 ELSE 10 END) AS start, "end" + CASE WHEN strand = '-' THEN 10 ELSE 20 END AS "end", strand FROM a""")
def region_extend(spark, sf):
    return regions.extend_ends(_a(spark, sf), 10, 20)


# --- tracks ---------------------------------------------------------------------------------------------------------------
TRACK = "SELECT event_type AS track, {hour} AS pos, round(sum(value), 6) AS value FROM {t} GROUP BY 1, 2"
DUCK_TRACK = "WITH s AS (" + TRACK.format(hour="CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) + 1 AS BIGINT)", t="events") + ")"
TRACK_LENGTH = 4000


def _track(spark, sf):
    return spark.sql(TRACK.replace("{hour}", "CAST(timestampdiff(HOUR, TIMESTAMP '2024-01-01', date_trunc('HOUR', ts)) + 1 AS BIGINT)"), t=_table(spark, sf, "events"))


@query(DUCK_TRACK + "SELECT track, pos, CASE WHEN value >= 200 THEN 200.0 WHEN value >= 50 THEN 50.0 WHEN value >= 10 THEN 10.0 ELSE -1e9 END AS value FROM s")
def track_quantize(spark, sf):
    return _track(spark, sf).withColumn("value", signal.quantize(F.col("value"), [-1e9, 10, 50, 200]))


@query(DUCK_TRACK + "SELECT track, pos, round(ln(greatest(value, 0) + 1) / ln(2.0), 6) AS value FROM s")
def track_log1p(spark, sf):
    return _track(spark, sf).withColumn("value", F.round(signal.log1p_base(F.greatest("value", F.lit(0.0)), 2.0), 6))


@query(DUCK_TRACK + "SELECT track, pos, floor(value) AS value FROM s")
def track_floor(spark, sf):
    return _track(spark, sf).withColumn("value", F.floor("value").cast("double"))


@query(DUCK_TRACK + "SELECT track, row_number() OVER (PARTITION BY track ORDER BY pos) AS pos, value FROM s WHERE pos IN (SELECT pos FROM s WHERE track = 'click' AND value > 60 OR track = 'view' AND value > 90)")
def track_prune_joint(spark, sf):
    return signal.prune_joint(_track(spark, sf), {"click": 60, "view": 90, "purchase": -1000})


@query(DUCK_TRACK + "SELECT track, row_number() OVER (PARTITION BY track ORDER BY pos) AS pos, value FROM s WHERE NOT (pos BETWEEN 10 AND 30 OR pos BETWEEN 100 AND 250)")
def track_exclude(spark, sf):
    return signal.exclude(_track(spark, sf), spark.createDataFrame([(10, 30), (100, 250)], "start long, end long"))


@query(DUCK_TRACK + f"SELECT track, (pos - 1 + 777) % {TRACK_LENGTH} + 1 AS pos, value FROM s")
def track_shift(spark, sf):
    return signal.shift(_track(spark, sf), 777, TRACK_LENGTH)


@query(DUCK_TRACK + f", o AS (SELECT b, row_number() OVER (ORDER BY md5('7|' || b), b) - 1 AS t FROM range({TRACK_LENGTH // 24}) x(b)) SELECT track, t * 24 + (pos - 1) % 24 + 1 AS pos, value FROM s JOIN o ON b = (pos - 1) // 24")
def track_block_permute(spark, sf):
    return signal.permute_blocks(_track(spark, sf), 24, TRACK_LENGTH, 7)


@query(DUCK_TRACK + f"SELECT track, {sample.permuted_sql('(pos - 1) // 24', TRACK_LENGTH // 24, 7, sample.DUCK_FOLD)} * 24 + (pos - 1) % 24 + 1 AS pos, value FROM s WHERE (pos - 1) // 24 < {TRACK_LENGTH // 24}")
def track_block_shuffle(spark, sf):
    return sample.shuffle_blocks(_track(spark, sf), 24, TRACK_LENGTH, 7)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (ORDER BY md5('11|' || l_orderkey || '|' || l_linenumber)) AS k FROM lineitem) WHERE k <= 1000")
def subsample(spark, sf):
    return sample.subsample(_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), 1000, ["l_orderkey", "l_linenumber"], 11)


@query(DUCK_TRACK + "SELECT track, pos - 99 AS pos, value FROM s WHERE pos BETWEEN 100 AND 300")
def track_slice(spark, sf):
    return signal.slice_(_track(spark, sf), 100, 300)


#: Positions to segments of equal values.
_PAINTED = """, f AS (SELECT *, sum(o) OVER (PARTITION BY track ORDER BY pos) AS k FROM (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(value) OVER w = value THEN 0 ELSE 1 END AS o FROM {t} WINDOW w AS (PARTITION BY track ORDER BY pos))) SELECT track, min(pos) AS start, max(pos) AS "end", value FROM f GROUP BY track, k, value"""
#: The track in steps of 50, so that neighbours are often equal.
_STEPS = DUCK_TRACK + ", v AS (SELECT track, pos, floor(value / 50) AS value FROM s)"


def _segments(spark, sf):
    return segments.from_dense(_track(spark, sf).withColumn("value", F.floor(F.col("value") / 50).cast("double")))


@query(_STEPS + _PAINTED.format(t="v"))
def segments_of_track(spark, sf):
    return _segments(spark, sf)


@query(_STEPS + ", d AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY pos) AS pos, value FROM v WHERE NOT (pos BETWEEN 10 AND 30 OR pos BETWEEN 100 AND 250))" + _PAINTED.format(t="d"))
def segments_exclude(spark, sf):
    areas = _track(spark, sf).select("track").distinct().select("track", F.inline(F.expr("array(struct(10L as start, 30L as end), struct(100L as start, 250L as end))")))
    return segments.exclude(_segments(spark, sf), areas)


@query(_STEPS + ", d AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY pos) AS pos, value FROM v WHERE track IN ('click', 'view', 'purchase') AND pos IN (SELECT pos FROM v WHERE track = 'click' AND value > 1 OR track = 'view' AND value > 2))" + _PAINTED.format(t="d"))
def segments_prune_joint(spark, sf):
    return segments.prune_joint(_segments(spark, sf), {"click": 1, "view": 2, "purchase": -1000})


@query(_STEPS + f", d AS (SELECT track, (pos - 1 + 777) % {TRACK_LENGTH} + 1 AS pos, value FROM v)" + _PAINTED.format(t="d"))
def segments_shift(spark, sf):
    return segments.shift(_segments(spark, sf), 777, TRACK_LENGTH)


@query(_STEPS + """, i AS (SELECT track, pos, pos - row_number() OVER (PARTITION BY track ORDER BY pos) AS k FROM v WHERE value >= 1), j AS (SELECT track, min(pos) AS start, max(pos) AS "end" FROM i GROUP BY track, k)
 SELECT j.* FROM j WHERE "end" - start >= 1 AND "end" < (SELECT max(pos) FROM v WHERE v.track = j.track)""")
def segments_peaks(spark, sf):
    return segments.runs(_segments(spark, sf), F.col("value") >= 1, least=2)


@query(DUCK_TRACK + "SELECT track, min(value) AS low, max(value) AS high FROM s GROUP BY track")
def track_extrema(spark, sf):
    return signal.extrema(_track(spark, sf))


def _runs_sql(test: str) -> str:
    return DUCK_TRACK + f", i AS (SELECT track, pos, pos - row_number() OVER (PARTITION BY track ORDER BY pos) AS k FROM s WHERE {test}), j AS (SELECT track, min(pos) AS start, max(pos) AS \"end\" FROM i GROUP BY track, k) SELECT j.* FROM j WHERE \"end\" < (SELECT max(pos) FROM s WHERE s.track = j.track)"


@query(_runs_sql("value >= 50"))
def track_peaks(spark, sf):
    return signal.peaks(_track(spark, sf), 50)


@query(_runs_sql("value <= 40"))
def track_valleys(spark, sf):
    return signal.valleys(_track(spark, sf), 40)


@query(DUCK_TRACK + """, f AS (SELECT track, pos, floor(value / 50) AS value FROM s), g AS (SELECT *, sum(o) OVER (PARTITION BY track ORDER BY pos) AS k FROM (SELECT *, CASE WHEN value <> lag(value) OVER (PARTITION BY track ORDER BY pos) THEN 1 ELSE 0 END AS o FROM f)) SELECT track, value, min(pos) AS start, max(pos) AS "end" FROM g GROUP BY track, k, value""")
def track_rle(spark, sf):
    return signal.run_lengths(_track(spark, sf).withColumn("value", F.floor(F.col("value") / 50).cast("double")))


# --- strings and logarithms -----------------------------------------------------------------------------------------------
def _part(spark, sf):
    return _table(spark, sf, "part")


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_name || '#' || p_brand, '[ #]'), lambda t: t <> ''), '|') AS tokens, CAST(len(list_filter(regexp_split_to_array(p_name || '#' || p_brand, '[ #]'), lambda t: t <> '')) AS BIGINT) AS n, array_to_string(list_filter(regexp_split_to_array(p_name || '#' || p_brand, '[ #]'), lambda t: t <> '')[1:2], '|') AS first_two FROM part")
def str_tokenize(spark, sf):
    s = F.concat("p_name", F.lit("#"), "p_brand")
    return _part(spark, sf).select("p_partkey", F.array_join(strings.tokenize_chars(s, " #"), "|").alias("tokens"), strings.count_tokens(s, " #").alias("n"), F.array_join(strings.first_tokens(s, " #", 2), "|").alias("first_two"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(p_type, 'A'), lambda t: t <> ''), '|') AS tokens FROM part")
def str_tokenize_text(spark, sf):
    return _part(spark, sf).select("p_partkey", F.array_join(strings.tokenize_text(F.col("p_type"), "A"), "|").alias("tokens"))


@query("SELECT p_partkey, regexp_replace(p_brand || '-' || p_type, '[^A-Za-z0-9]', '', 'g') AS alnum, substr(p_type, 3, 4) AS sub, upper(p_name) AS up, reverse(p_name) AS rev, replace(replace(p_brand, '#', '_'), 'B', '_') AS replaced FROM part")
def str_alphanumeric(spark, sf):
    return _part(spark, sf).select("p_partkey", strings.alphanumeric(F.concat("p_brand", F.lit("-"), "p_type")).alias("alnum"), strings.substring(F.col("p_type"), 2, 5).alias("sub"), F.upper("p_name").alias("up"), F.reverse("p_name").alias("rev"), strings.replace_chars(F.col("p_brand"), "#B", "_").alias("replaced"))


@query("SELECT p_partkey, regexp_full_match(p_name, '[0-9,]*\\.?[0-9,]*') AS name_number, regexp_full_match(CAST(p_size AS VARCHAR), '[0-9,]*\\.?[0-9,]*') AS size_number, regexp_full_match(p_type, '[ \\t\\r\\n]*') AS blank FROM part")
def str_is_number(spark, sf):
    return _part(spark, sf).select("p_partkey", strings.is_number(F.col("p_name")).alias("name_number"), strings.is_number(F.col("p_size").cast("string")).alias("size_number"), strings.is_blank(F.col("p_type")).alias("blank"))


@query("SELECT c_custkey, CAST(coalesce(list_sum(list_transform(regexp_extract_all(c_name || ' 12x7', '[0-9]+'), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS total FROM customer")
def str_integers(spark, sf):
    found = strings.integers(F.concat("c_name", F.lit(" 12x7")))
    return _table(spark, sf, "customer").select("c_custkey", F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT s, CASE s WHEN '(a[b]{c})' THEN true WHEN '(a[b)]' THEN false WHEN '' THEN true WHEN '((' THEN false WHEN 'x)' THEN false ELSE true END AS balanced, n FROM (SELECT ['(a[b]{c})', '(a[b)]', '', '((', 'x)'][1 + p_partkey % 5] AS s, count(*) AS n FROM part GROUP BY 1)")
def str_balanced(spark, sf):
    texts = F.array(*(F.lit(x) for x in ("(a[b]{c})", "(a[b)]", "", "((", "x)")))
    return _part(spark, sf).select(F.element_at(texts, (1 + F.col("p_partkey") % 5).cast("int")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).withColumn("balanced", strings.is_balanced(F.col("s")))


@query("SELECT p_partkey, to_base(p_partkey, 2) AS binary_text, upper(to_base(p_partkey, 16)) AS hex_text, p_partkey AS back FROM part")
def str_base_conversion(spark, sf):
    n = F.col("p_partkey")
    return _part(spark, sf).select("p_partkey", strings.to_base(n, 2).alias("binary_text"), strings.to_base(n, 16).alias("hex_text"), strings.from_base(strings.to_base(n, 8), 8).alias("back"))


@query("SELECT p_partkey, starts_with(p_type, 'S') AS s, starts_with(upper(p_type), 'STANDARD') AS s_ci, ends_with(p_type, 'R') AS e, strpos(upper(p_type), 'AN') - 1 AS at, upper(p_name) = upper(p_brand) AS same, starts_with(p_type, left(p_type, 3)) AS prefix FROM part")
def str_prefix(spark, sf):
    t = F.col("p_type")
    return _part(spark, sf).select("p_partkey", strings.starts_with(t, "S").alias("s"), strings.starts_with(t, "standard", False).alias("s_ci"), strings.ends_with(t, "R").alias("e"), strings.find_ci(t, "an").cast("bigint").alias("at"), strings.equal_ci(F.col("p_name"), F.col("p_brand")).alias("same"), strings.prefix_matches(t, F.substring(t, 1, 3)).alias("prefix"))


@query("SELECT n_regionkey, array_to_string(list(n_name ORDER BY length(n_name), n_name), '|') AS names, list_position(list(n_name ORDER BY length(n_name), n_name), 'CHINA') - 1 AS china, count(*) AS size FROM nation GROUP BY n_regionkey")
def str_lists(spark, sf):
    grouped = _table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("l"), F.count("*").alias("size"))
    names = strings.sort_texts(F.col("l"))
    at = strings.position(names, F.lit("CHINA"))
    return grouped.select("n_regionkey", F.array_join(names, "|").alias("names"), F.when(at < F.col("size"), at).cast("int").alias("china"), "size")


_LOGS = "SELECT event_id, ln(abs(value) + 0.5) AS a, CASE WHEN event_id % 7 = 0 THEN -1073741824.0 ELSE ln((event_id % 5) + 0.25) END AS b FROM {t}"


def _logs(spark, sf):
    return spark.sql(_LOGS, t=_table(spark, sf, "events"))


@query("WITH l AS (" + _LOGS.format(t="events") + ") SELECT event_id, round(CASE WHEN b <= -1073741824 THEN a ELSE ln(exp(a) + exp(b)) END, 6) AS sum_log, round(CASE WHEN b <= -1073741824 THEN b ELSE a + b END, 6) AS product_log, round(ln(exp(a) + 1), 6) AS plus_one FROM l")
def log_add(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _logs(spark, sf).select("event_id", F.round(logmath.add(a, b), 6).alias("sum_log"), F.round(logmath.mul(a, b), 6).alias("product_log"), F.round(logmath.increment(a), 6).alias("plus_one"))


@query("WITH l AS (" + _LOGS.format(t="events") + ") SELECT event_id, round(CASE WHEN b <= -1073741824 THEN greatest(a, b) WHEN abs(a - b) <= 1e-10 THEN -1073741824 ELSE ln(exp(greatest(a, b)) - exp(least(a, b))) END, 6) AS difference, round(2.5 * a, 6) AS power FROM l")
def log_sub(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _logs(spark, sf).select("event_id", F.round(logmath.sub(F.greatest(a, b), F.least(a, b)), 6).alias("difference"), F.round(logmath.power(a, F.lit(2.5)), 6).alias("power"))


@query("WITH l AS (" + _LOGS.format(t="events") + ") SELECT event_id, CASE WHEN abs(a - b) <= 1e-10 THEN 0 WHEN a > b THEN 1 ELSE -1 END AS sign, round(greatest(a, b), 6) AS larger FROM l")
def log_compare(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _logs(spark, sf).select("event_id", logmath.compare(a, b).alias("sign"), F.round(F.greatest(a, b), 6).alias("larger"))


# --- formats: lines made from lineitem, parsed again ---------------------------------------------------------------------------
_POS = "1 + l_partkey * 50"
_LEN = "CAST(l_quantity AS INT)"
_SEQ = f"repeat('A', {_LEN})"
_ID = "l_orderkey || '_' || l_linenumber"
_FLAG = "CASE WHEN l_linenumber % 5 = 0 THEN 4 WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END"
_SIGN = "CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END"
_CHR = "'chr' || (1 + l_partkey % 2)"


def _lines(spark, sf, parts: list[str], sep: str) -> DataFrame:
    text = ", ".join(f"CAST({p} AS STRING)" for p in parts)
    return spark.sql(f"SELECT concat_ws('{sep}', {text}) AS value FROM {{t}}", t=_table(spark, sf, "lineitem"))


def _expected(pos: str, length: str, strand: str = f"CASE {_SIGN} WHEN '-' THEN 'R' ELSE 'F' END", where: str = "true") -> str:
    return f"SELECT CAST(1 + l_partkey % 2 AS VARCHAR) AS chrom, {strand} AS strand, CAST({pos} AS BIGINT) AS pos, {length} || 'M' AS cigar FROM lineitem WHERE {where}"


@query(_expected(_POS, _LEN, "CASE WHEN l_linenumber % 2 = 0 THEN 'R' ELSE 'F' END", "l_linenumber % 5 <> 0"))
def parse_sam(spark, sf):
    return sources.parse_sam(_lines(spark, sf, [_ID, _FLAG, _CHR, _POS, "30", f"{_LEN} || 'M'", "'*'", "0", "0", _SEQ, _SEQ], "\\t"))


@query(_expected(_POS, _LEN))
def parse_eland(spark, sf):
    return sources.parse_eland(_lines(spark, sf, [_ID, _SEQ, _SEQ, "0", "0", "0", _CHR, _POS, _SIGN], " "))


@query(_expected(_POS, f"({_LEN} + 1)"))
def parse_tagalign(spark, sf):
    return sources.parse_tagalign(_lines(spark, sf, [_CHR, _POS, f"{_POS} + {_LEN}", "'N'", "1000", _SIGN], " "))


@query(_expected(f"{_POS} + 1", _LEN))
def parse_bowtie(spark, sf):
    return sources.parse_bowtie(_lines(spark, sf, [_ID, _SIGN, _CHR, _POS, _SEQ], "\\t"))


@query(_expected(f"{_POS} + 1", _LEN))
def parse_bed4(spark, sf):
    return sources.parse_bed4(_lines(spark, sf, [_CHR, _POS, f"{_POS} + {_LEN}", "'N'", _SIGN], " "))


@query(_expected(f"{_POS} + 1", _LEN))
def parse_bed6(spark, sf):
    return sources.parse_bed6(_lines(spark, sf, [_CHR, _POS, f"{_POS} + {_LEN}", "'N'", "0", _SIGN], " "))


@query(_expected(_POS, _LEN))
def parse_preprocessed(spark, sf):
    return sources.parse_preprocessed(_lines(spark, sf, [_CHR, _POS, f"{_LEN} || 'M'", _SIGN], " "))


@query(f"SELECT CAST(1 + l_partkey % 2 AS VARCHAR) AS chrom, CAST({_POS} + 1 AS BIGINT) AS start, CAST({_POS} + {_LEN} AS BIGINT) AS \"end\", {_ID} AS name, 7 AS score, {_SIGN} AS strand FROM lineitem")
def parse_bed(spark, sf):
    return sources.parse_bed(_lines(spark, sf, [_CHR, _POS, f"{_POS} + {_LEN}", _ID, "7", _SIGN], "\\t"))


@query(f"SELECT CAST(1 + l_partkey % 2 AS VARCHAR) AS chrom, CAST({_POS} + 1 AS BIGINT) AS start, CAST({_POS} + 40 AS BIGINT) AS \"end\", {_ID} AS name FROM lineitem UNION ALL SELECT CAST(1 + l_partkey % 2 AS VARCHAR), {_POS} + 61, {_POS} + 100, {_ID} FROM lineitem")
def parse_bed12(spark, sf):
    parsed = sources.parse_bed12(_lines(spark, sf, [_CHR, _POS, f"{_POS} + 100", _ID, "7", _SIGN, _POS, f"{_POS} + 100", "0", "2", "'40,40,'", "'0,60,'"], "\\t"))
    return regions.exons(parsed).select("chrom", "start", "end", "name")


@query("WITH l AS (SELECT p_partkey * 3 AS s, p_partkey * 3 + 1 + p_size % 9 AS e, CAST(p_size AS DOUBLE) AS v, p_partkey AS line FROM part), x AS (SELECT line, v, unnest(range(s + 1, e + 1)) AS pos FROM l) SELECT pos, arg_max(v, line) AS value FROM x GROUP BY pos")
def parse_bedgraph(spark, sf):
    lines = spark.sql("SELECT p_partkey AS line, concat_ws(' ', 'chr1', CAST(p_partkey * 3 AS STRING), CAST(p_partkey * 3 + 1 + p_size % 9 AS STRING), CAST(p_size AS STRING)) AS value FROM {t}", t=_part(spark, sf))
    return sources.parse_bedgraph(lines)


@query("SELECT p_partkey AS record, 'r' || p_partkey AS id, repeat('ACGT', p_size) AS nucs, repeat('IIII', p_size) AS quality FROM part")
def parse_fastq(spark, sf):
    lines = spark.sql("SELECT p_partkey * 4 + i AS line, CASE i WHEN 0 THEN '@r' || p_partkey WHEN 1 THEN repeat('ACGT', p_size) WHEN 2 THEN '+' ELSE repeat('IIII', p_size) END AS value FROM {t} LATERAL VIEW explode(array(0, 1, 2, 3)) x AS i", t=_part(spark, sf))
    return sources.parse_fastq(lines)


def _written(spark: SparkSession, lines: DataFrame, name: str, files: int = 4) -> str:
    """The lines (value) as text files, dealt by ``key`` and each in the order of ``key``; read again by the file sources."""
    path = new_path(spark, name)
    lines.repartitionByRange(files, "key").sortWithinPartitions("key").select("value").write.text(path)
    return path


@query("SELECT 'r' || p_partkey AS id, repeat('ACGT', p_size) AS nucs, '@' || repeat('IIII', p_size - 1) || 'III' AS quality FROM part")
def fastq_files(spark, sf):
    """Several files, whose quality lines begin with @."""
    text = spark.sql("SELECT p_partkey AS key, concat_ws('\\n', concat('@r', p_partkey), repeat('ACGT', p_size), '+', concat('@', repeat('IIII', p_size - 1), 'III')) AS value FROM {t}", t=_part(spark, sf))
    return files.read_fastq(spark, _written(spark, text, "fastq")).select("id", "nucs", "quality")


_GRAPH = "SELECT p_partkey AS key, '1' AS track, p_partkey * 3 AS s, p_partkey * 3 + 1 + p_size % 9 + CASE WHEN p_partkey % 50 = 0 THEN 400 ELSE 0 END AS e, CAST(p_size AS DOUBLE) AS value FROM part"


@query(f"WITH l AS ({_GRAPH}), x AS (SELECT key, track, value, unnest(range(s + 1, e + 1)) AS pos FROM l), d AS (SELECT track, pos, arg_max(value, key) AS value FROM x GROUP BY track, pos)" + _PAINTED.format(t="d"))
def bedgraph_files(spark, sf):
    """Several files of overlapping lines; the order is that of the files' names and their lines."""
    lines = spark.sql(f"SELECT key, concat_ws('\\t', concat('chr', track), s, e, value) AS value FROM ({_GRAPH.replace('FROM part', 'FROM {t}')})", t=_part(spark, sf))
    return segments.paint(files.read_bedgraph(spark, _written(spark, lines, "bedgraph")), ["file", "line"])


@query("SELECT CAST(1 + p_partkey % 2 AS VARCHAR) AS chrom, p_partkey * 3 + 1 AS start, p_partkey * 3 + 5 + p_size AS \"end\", '.' AS name, 0 AS score, '+' AS strand, row_number() OVER (ORDER BY p_partkey) - 1 AS line FROM part")
def bed_lines(spark, sf):
    """One file, so that the line numbers are those of the table's order."""
    lines = spark.sql("SELECT p_partkey AS key, concat_ws('\\t', concat('chr', 1 + p_partkey % 2), p_partkey * 3, p_partkey * 3 + 5 + p_size) AS value FROM {t}", t=_part(spark, sf))
    return files.read_bed(spark, _written(spark, lines, "bed", 1)).select("chrom", "start", "end", "name", "score", "strand", "line")


_BAD = "CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE CAST(p_partkey * 3 AS STRING) END"
_PART_REGION = "CAST(1 + p_partkey % 2 AS VARCHAR) AS chrom, p_partkey * 3 + 1 AS start, p_partkey * 3 + 5 + p_size AS \"end\""


def _part_lines(spark, sf, parts: list[str], sep: str = "\\t") -> DataFrame:
    text = ", ".join(f"CAST({p} AS STRING)" for p in parts)
    return spark.sql(f"SELECT concat_ws('{sep}', {text}) AS value FROM {{t}}", t=_part(spark, sf))


_PART_CHR, _PART_END = "'chr' || (1 + p_partkey % 2)", "p_partkey * 3 + 5 + p_size"


@query(f"SELECT {_PART_REGION}, p_size + 0.5::DOUBLE AS enrichment, 3.25::DOUBLE AS p, 1e-3::DOUBLE AS q, p_size % 5 + 0::BIGINT AS summit FROM part WHERE p_partkey % 7 <> 0")
def parse_narrowpeak(spark, sf):
    return sources.parse_narrowpeak(_part_lines(spark, sf, [_PART_CHR, _BAD, _PART_END, "'.'", "0", "'.'", "p_size || '.5'", "'3.25'", "'1.0e-3'", "p_size % 5"]))


@query(f"SELECT {_PART_REGION}, p_size + 0.5::DOUBLE AS enrichment, 3.25::DOUBLE AS p, CASE WHEN p_partkey % 3 <> 0 THEN -1.0::DOUBLE END AS q FROM part WHERE p_partkey % 7 <> 0")
def parse_broadpeak(spark, sf):
    """A field that is no number is null; a line without a place is dropped."""
    return sources.parse_broadpeak(_part_lines(spark, sf, [_PART_CHR, _BAD, _PART_END, "'.'", "0", "'.'", "p_size || '.5'", "'3.25'", "CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE '-1' END"]))


@query("SELECT 'n' || p_partkey AS name, CAST(1 + p_partkey % 2 AS VARCHAR) AS chrom, p_partkey * 3 + 1 AS start, p_partkey * 3 + 2 AS \"end\" FROM part UNION ALL SELECT 'n' || p_partkey, CAST(1 + p_partkey % 2 AS VARCHAR), p_partkey * 3 + 5, p_partkey * 3 + 5 + p_size FROM part")
def parse_interval(spark, sf):
    parsed = sources.parse_interval(_part_lines(spark, sf, ["'n' || p_partkey", _PART_CHR, "'+'", "p_partkey * 3", _PART_END, "2", "concat_ws(',', p_partkey * 3, p_partkey * 3 + 4)", f"concat_ws(',', p_partkey * 3 + 2, {_PART_END})"]))
    return regions.exons(parsed).select("name", "chrom", "start", "end")


@query("SELECT 'n' || p_partkey AS name, CAST(1 + p_partkey % 2 AS VARCHAR) AS chrom, '+' AS strand, p_partkey * 3 AS start, p_partkey * 3 + 5 + p_size AS \"end\", 2 AS blocks, (p_partkey * 3) || ',' || (p_partkey * 3 + 4) AS starts, (p_partkey * 3 + 2) || ',' || (p_partkey * 3 + 5 + p_size) AS ends FROM part")
def interval_rows(spark, sf):
    return sinks.interval_rows(sources.parse_interval(_part_lines(spark, sf, ["'n' || p_partkey", _PART_CHR, "'+'", "p_partkey * 3", _PART_END, "2", "concat_ws(',', p_partkey * 3, p_partkey * 3 + 4)", f"concat_ws(',', p_partkey * 3 + 2, {_PART_END})"])))


@query("SELECT CAST(1 + p_partkey % 2 AS VARCHAR) AS chrom, p_partkey * 3 AS pos, p_size / 4.0::DOUBLE AS value FROM part WHERE p_partkey % 7 <> 0")
def parse_sgr(spark, sf):
    return sources.parse_sgr(_part_lines(spark, sf, [_PART_CHR, _BAD, "p_size / 4.0D"], " "))


@query("SELECT CAST(1 + p_partkey AS VARCHAR) AS chrom, p_partkey * 3 AS length FROM part WHERE p_partkey % 7 <> 0")
def parse_lengths(spark, sf):
    return sources.parse_lengths(_part_lines(spark, sf, ["'chr' || (1 + p_partkey)", _BAD]))


@query(f"SELECT {_ID} AS id, {_SEQ} AS nucs, {_SEQ} AS quality FROM lineitem")
def parse_sam_sequences(spark, sf):
    return sources.parse_sam_sequences(_lines(spark, sf, [_ID, _FLAG, _CHR, _POS, "30", f"{_LEN} || 'M'", "'*'", "0", "0", _SEQ, _SEQ], "\\t"))


@query(REG + """ SELECT chrom, start - 1 AS start, "end", '.' AS name, "end" - start AS score, strand FROM a""")
def bed_rows(spark, sf):
    return sinks.bed_rows(_a(spark, sf).withColumn("q", F.col("end") - F.col("start")), stranded=True, value="q").withColumnRenamed("q", "score")


@query(REG + """ SELECT chrom, 'made' AS source, 'site' AS feature, start, "end", '.' AS score, '.' AS strand, '.' AS frame FROM a""")
def gff_rows(spark, sf):
    return sinks.gff_rows(_a(spark, sf).drop("strand"), "made", "site")


@query(REG + """, r AS (SELECT *, 'g' || start AS name FROM a WHERE "end" - start >= 10) SELECT chrom, 'made' AS source, 'gene' AS feature, start, "end", '.' AS score, strand, '.' AS frame, 'ID=' || name AS attributes FROM r
 UNION ALL SELECT chrom, 'made', 'exon', CASE i WHEN 1 THEN start ELSE "end" - 4 END, CASE i WHEN 1 THEN start + 4 ELSE "end" END, '.', strand, '.', 'ID=' || name || '.' || i || ';Parent=' || name FROM r, (SELECT unnest([1, 2]) AS i)""")
def gff_exons(spark, sf):
    long = _a(spark, sf).where("end - start >= 10").withColumn("name", F.concat(F.lit("g"), "start"))
    ends = F.array(F.struct("start", (F.col("start") + 4).alias("end")), F.struct((F.col("end") - 4).alias("start"), "end"))
    return sinks.gff_rows(long.withColumn("intervals", ends), "made", "gene", child="exon")


@query("""SELECT p_partkey AS start_1, p_partkey - 1 AS start_bed, p_partkey + p_size AS end_bed, p_partkey - 1 AS start_bowtie, p_partkey + p_size - 1 AS end_bowtie, p_partkey + 1 AS start_back FROM part""")
def coordinates_translated(spark, sf):
    start, end = F.col("p_partkey"), F.col("p_partkey") + F.col("p_size")
    return _part(spark, sf).select(
        sources.translate_start(start, "bed", "bed").alias("start_1"), sources.translate_start(start, "codebase", "bed").alias("start_bed"), sources.translate_end(end, "gff", "bed").alias("end_bed"), sources.translate_start(start, "sam", "bowtie").alias("start_bowtie"), sources.translate_end(end, "sam", "bowtie").alias("end_bowtie"), sources.translate_start(start, "bed", "codebase").alias("start_back")
    )


_RECORDS = "SELECT 'r' || p_partkey AS id, repeat('ACGT', p_size) AS nucs, repeat('I', p_size) || repeat('5', 3 * p_size) AS quality FROM {t}"


@query("SELECT '@' || id || chr(10) || nucs || chr(10) || '+' || id || chr(10) || quality AS value FROM (" + _RECORDS.format(t="part") + ")")
def fastq_lines(spark, sf):
    return sinks.fastq_lines(spark.sql(_RECORDS, t=_part(spark, sf)))


@query("SELECT i - 1 AS place, quality[i] AS letter, count(*) AS n FROM (SELECT quality, unnest(range(1, len(quality) + 1)) AS i FROM (" + _RECORDS.format(t="part") + ")) GROUP BY ALL")
def phred_distribution(spark, sf):
    return sinks.phred_distribution(spark.sql(_RECORDS, t=_part(spark, sf)))


@query(DUCK_TRACK + """, f AS (SELECT track, pos, floor(value / 50) AS value FROM s), g AS (SELECT *, sum(o) OVER (PARTITION BY track ORDER BY pos) AS k FROM (SELECT *, CASE WHEN value <> lag(value) OVER (PARTITION BY track ORDER BY pos) THEN 1 ELSE 0 END AS o FROM f)) SELECT track, value, min(pos) - 1 AS start, max(pos) AS "end" FROM g GROUP BY track, k, value""")
def bedgraph_rows(spark, sf):
    return sinks.bedgraph_rows(signal.run_lengths(_track(spark, sf).withColumn("value", F.floor(F.col("value") / 50).cast("double"))))


@query("SELECT p_partkey, array_to_string(CASE WHEN p_size % 2 = 0 THEN ['a', 'x', 'b', 'y', 'c'] ELSE ['x', 'a', 'y', 'b', 'c'] END, '') AS turns, array_to_string([string_split(p_name, ' ')[1:2], string_split(p_name, ' ')[3:4]][1 + p_partkey % 2], '|') AS part FROM (SELECT p_partkey, p_size, 'a b c ' || p_size AS p_name FROM part)")
def str_interleave(spark, sf):
    long, short = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "xy"))
    words = F.split(F.concat(F.lit("a b c "), F.col("p_size").cast("string")), " ")
    half = F.element_at(strings.batches(words, 2), (1 + F.col("p_partkey") % 2).cast("int"))
    return _part(spark, sf).select("p_partkey", F.array_join(F.when(F.col("p_size") % 2 == 0, strings.interleave(long, short)).otherwise(strings.interleave(short, long)), "").alias("turns"), F.array_join(half, "|").alias("part"))


@query(f"SELECT chrom, start + least(CAST(ceil((sqrt(8.0 * 100 * u + 1) - 1) / 2) AS BIGINT), 99) % w AS start, 100 AS len, CASE WHEN v > 1073741823 THEN 'F' ELSE 'R' END AS strand FROM (SELECT chrom, start, \"end\" - start + 1 AS w, {background.uniform(['key', 'read'], SET.seed)} / 2147483647.0::DOUBLE AS u, {background.uniform(['key', 'read'], SET.seed + 1)} AS v FROM (SELECT 'chr' || (1 + p_partkey % 2) AS chrom, p_partkey * 100 AS start, p_partkey * 100 + p_size * 5 AS \"end\", p_partkey AS key, unnest(range(1, 6)) AS read FROM part))")
def simulate_control(spark, sf):
    return simulate.simulate_fragments(_a(spark, sf).withColumn("key", F.expr("start div 100")), 5, 100, SET.seed, chip=False)


@query(f"""WITH c AS (SELECT sum(w) OVER (ORDER BY i) / sum(w) OVER () AS c FROM (SELECT i, exp(-power(i - 50, 2) / 8.0) AS w FROM range(100) x(i))),
d AS (SELECT chrom, start, "end" - start + 1 AS w, {background.uniform(['key', 'read'], SET.seed)} / 2147483647.0::DOUBLE AS u, {background.uniform(['key', 'read'], SET.seed + 1)} AS v FROM (SELECT 'chr' || (1 + p_partkey % 2) AS chrom, p_partkey * 100 AS start, p_partkey * 100 + p_size * 5 AS "end", p_partkey AS key, unnest(range(1, 6)) AS read FROM part))
SELECT chrom, start + (SELECT count(*) FROM c WHERE c <= u) % 100 % w AS start, 100 AS len, CASE WHEN v > 1073741823 THEN 'F' ELSE 'R' END AS strand FROM d""")
def simulate_fragments(spark, sf):
    return simulate.simulate_fragments(_a(spark, sf).withColumn("key", F.expr("start div 100")), 5, 100, SET.seed, chip=True)
