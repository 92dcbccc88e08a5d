"""Per-window thresholds from a Poisson or a simulated background."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .coverage import events
from .peaks import MAX_THRESHOLD
from .staged import dealt, staged, tasks_for


def too_high(most: int) -> Column:
    """An error in place of a threshold beyond the range, as 0 would leave the window out without a word."""
    return F.raise_error(F.lit(f"a window needs a threshold above {most}: raise Max_threshold")).cast("int")


def poisson_threshold(lam: Column, fdr: float, most: int = MAX_THRESHOLD) -> Column:
    """Smallest t from 1 on with CDF(t) > 1 - fdr; an error if it is above ``most``. Terms run in logarithms, so a large mean
    stays finite. They end where Bernstein's bound leaves less than ``fdr`` of the tail, so no threshold lies further on."""
    tail = -math.log(fdr)
    last = F.ceil(lam + 2 / 3 * tail + F.sqrt(2 * tail * lam)).cast("int") + 2
    start = F.struct(F.exp(-lam).alias("c"), (-lam).alias("lt"), F.lit(0).alias("thr"))

    def step(acc, t):
        lt = acc["lt"] + F.ln(F.greatest(lam, F.lit(1e-300))) - F.ln(t.cast("double"))
        c = acc["c"] + F.exp(lt)
        return F.when(acc["thr"] > 0, acc).otherwise(F.struct(c.alias("c"), lt.alias("lt"), F.when(c > 1 - fdr, t).otherwise(0).alias("thr")))

    found = F.aggregate(F.sequence(F.lit(1), F.least(last, F.lit(most))), start, step)["thr"]
    return F.when(found > 0, found).otherwise(too_high(most))


def poisson_thresholds(reads: DataFrame, mappability: DataFrame, ext: int, fdr: float, most: int = MAX_THRESHOLD) -> DataFrame:
    """reads: chrom, win, n. Windows without mappable positions get threshold 0; one that needs more than ``most`` is an error."""
    joined = mappability.join(reads, ["chrom", "win"], "left")
    lam = (F.coalesce("n", F.lit(0)) * ext).cast("double") / F.col("n_mappable")
    return joined.select("chrom", "win", F.when(F.col("n_mappable") > 0, poisson_threshold(lam, fdr, most)).otherwise(0).cast("bigint").alias("thr"))


def _minstd(x: str) -> str:
    """One step of the Lehmer generator (fixed constants), in SQL that other engines share."""
    return f"(({x}) * 48271 % 2147483647)"


def uniform(parts: list[str], seed: int) -> str:
    """SQL: a number in 1..2147483646 from a seed and integer expressions, the same in any order of rows."""
    x = f"CAST({seed} AS BIGINT)"
    for p in parts:
        x = _minstd(f"1 + (({x}) + 40692 * (1 + ({p}))) % 2147483646")
    return _minstd(_minstd(x))


def simulate_windows(reads: DataFrame, mappability: DataFrame, ext: int, sims: int, seed: int, gap: int, most: int = MAX_THRESHOLD) -> DataFrame:
    """chrom, win, thr, total: peaks at each threshold summed over the simulations (thresholds that occur).

    Each simulation of a window places its reads uniformly on the mappable positions; a counter-based generator stands for
    a sequential one, so the numbers do not depend on the order of tasks. Peaks merge over a gap one larger than real ones.
    """
    # windows made of a row a chromosome look like few to Spark, which would broadcast them all
    joined = staged(reads.join(mappability.hint("merge"), ["chrom", "win"]).where("n > 0 AND n_mappable > 0"), "drawn")
    # a window is a short row that becomes many: tasks are cut by what will be drawn, not by the size of these rows, and a read
    # that is drawn is four rows, two changes of the height and the thresholds they cross
    n, windows = joined.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    parts = tasks_for(joined.sparkSession, 4 * n * sims)
    spread = dealt(joined, windows * sims, "win", "chrom")
    drawn = spread.select("chrom", "n_mappable", "n", "win", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim"))
    keys = ("win", "sim", "chrom")  # numbers first, as sorts compare these at once
    placed = drawn.repartition(parts, *keys).select(*keys, "n_mappable", F.explode(F.expr("sequence(1L, n)")).alias("read"))
    code = "(ascii(chrom) * 31 + length(chrom))"
    at = F.expr(f"({uniform([code, 'win', 'sim', 'read'], seed)} * (n_mappable + 1)) div 2147483647").cast("bigint")
    profile = events(placed.select(*keys, at.alias("start"), F.lit(ext).cast("bigint").alias("len")), keys)
    by = W.partitionBy(*keys).orderBy("pos")
    heights = profile.withColumn("height", F.sum("delta").over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("prev_height", F.col("height") - F.col("delta"))
    low, high = F.least("height", "prev_height"), F.greatest("height", "prev_height")
    crossings = heights.where(low < most).select(*keys, "pos", (F.col("height") > F.col("prev_height")).alias("up"), F.explode(F.sequence(low + 1, F.least(high, F.lit(most).cast("bigint")))).alias("thr"))
    # ups and downs of a threshold take turns: a run opens a peak unless the fall before it lies within the gap
    fall = F.lag("pos").over(W.partitionBy(*keys, "thr").orderBy("pos"))
    opened = crossings.withColumn("_new", F.coalesce((F.col("pos") > fall + gap).cast("int"), F.lit(1))).where("up")
    # a merged peak that starts at 0 does not count unless it is the only one
    each = opened.groupBy(*keys, "thr").agg((F.sum("_new") - F.when((F.sum("_new") > 1) & (F.min("pos") <= 0), 1).otherwise(0)).alias("c"))
    return each.groupBy("chrom", "win", "thr").agg(F.sum("c").alias("total"))


def simulated_thresholds(simulated: DataFrame, counts: DataFrame, mappability: DataFrame, sims: int, fdr: float, most: int = MAX_THRESHOLD) -> DataFrame:
    """chrom, win, thr: the least threshold whose mean simulated count is at most ``fdr`` of the real one, from where the
    means start to fall. counts: chrom, thr, win, n. A window that has peaks at ``most`` and finds none is an error."""
    none = F.lit(0).cast("bigint")
    both = simulated.select("chrom", "win", "thr", "total", none.alias("n")).union(counts.select("chrom", "win", "thr", none, "n"))
    told = dealt(both, simulated.count() + counts.count(), "chrom", "win").groupBy("chrom", "win", "thr").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    by = W.partitionBy("chrom", "win").orderBy("thr")
    # the thresholds between, and the one after the highest, are rows without peaks
    since = F.when(F.lag("thr").over(by).isNull(), 1).otherwise(F.col("thr"))
    upto = F.coalesce(F.lead("thr").over(by) - 1, F.least(F.col("thr") + 1, F.lit(most)))
    rows = told.withColumns({"_since": since, "_upto": upto}).select("chrom", "win", F.col("thr").alias("_at"), "total", "n", F.explode(F.expr("sequence(_since, _upto)")).alias("thr"))
    here = F.col("thr") == F.col("_at")
    dense = rows.withColumns({"total": F.when(here, F.col("total")).otherwise(0), "n": F.when(here, F.col("n")).otherwise(0)})
    near = dense.withColumn("before", F.lag("total").over(by)).withColumn("after", F.lead("total").over(by))
    falls = near.withColumn("from_thr", F.min(F.when(F.col("before") > F.col("total"), F.col("thr"))).over(W.partitionBy("chrom", "win")))
    enough = (F.col("n") > 0) & (F.col("total") <= F.lit(fdr * sims) * F.col("n"))
    first = (F.col("thr") == 1) & enough & (F.col("total") > F.col("after"))
    later = (F.col("thr") >= F.col("from_thr")) & ((F.col("n") == 0) | enough)
    chosen = falls.groupBy("chrom", "win").agg(F.min(F.when(first | later, F.col("thr"))).alias("thr"), F.max("_at").alias("_high"))
    found = F.coalesce("thr", F.when(F.col("_high") >= most, too_high(most)), F.lit(0))
    n, at = mappability.count(), ["chrom", "win"]
    return dealt(mappability, n, *at).join(dealt(chosen, n, *at), at, "left").select("chrom", "win", F.when(F.col("n_mappable") > 0, found).otherwise(0).cast("bigint").alias("thr"))
