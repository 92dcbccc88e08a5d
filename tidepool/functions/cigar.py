"""CIGAR texts as column expressions: validity, steps, and match blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID = r"^([0-9]+[MIDNSHPX=])+$"
ON_GENOME = ("D", "M", "N")
ON_READ = ("S", "M", "I")


def is_valid(cigar: Column) -> Column:
    return F.coalesce(cigar.rlike(VALID), F.lit(False))


def steps(cigar: Column) -> Column:
    """array<struct<n: bigint, op: string>>; an invalid text has no steps."""
    text = F.when(is_valid(cigar), cigar).otherwise(F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(r"([0-9]+)([MIDNSHPX=])"), F.lit(1)).cast("array<bigint>")
    kinds = F.regexp_extract_all(text, F.lit(r"([0-9]+)([MIDNSHPX=])"), F.lit(2))
    return F.zip_with(numbers, kinds, lambda n, k: F.struct(n.alias("n"), k.alias("op")))


def advance(cigar: Column, kinds: tuple[str, ...]) -> Column:
    """Positions consumed by steps of the given kinds."""
    return F.aggregate(steps(cigar), F.lit(0).cast("bigint"), lambda a, s: a + F.when(s["op"].isin(*kinds), s["n"]).otherwise(F.lit(0)))


def match_blocks(reads: DataFrame) -> DataFrame:
    """One row per M step: start and len in place of cigar (start: pos plus what precedes it on the genome)."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.array().cast("array<struct<off:bigint,len:bigint>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        block = F.array(F.struct(acc["at"].alias("off"), s["n"].alias("len")))
        moved = acc["at"] + F.when(s["op"].isin(*ON_GENOME), s["n"]).otherwise(zero)
        return F.struct(moved.alias("at"), F.when(s["op"] == "M", F.concat(acc["out"], block)).otherwise(acc["out"]).alias("out"))

    single = F.col("cigar").rlike("^[0-9]+M$")  # the usual case needs no fold
    one = F.array(F.struct(zero.alias("off"), F.expr("try_cast(rtrim('M', cigar) AS bigint)").alias("len")))
    blocks = F.when(single, one).otherwise(F.aggregate(steps(F.col("cigar")), start, step)["out"])
    rest = [c for c in reads.columns if c not in ("cigar", "pos")]
    return reads.select(*rest, "pos", F.explode(blocks).alias("_b")).select(*rest, (F.col("pos") + F.col("_b.off")).alias("start"), F.col("_b.len").alias("len"))
