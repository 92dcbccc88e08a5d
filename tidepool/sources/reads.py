"""Text formats of mapped reads, regions and tracks, each as a projection of lines; a registry names the read formats.

Every parser takes a DataFrame with a column ``value`` (a line) and keeps other columns, such as a replicate. Lines that do
not parse are dropped. Positions come out 1-based and inclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staged import staged, tasks_for

#: Windows of a chromosome that are dealt to tasks together.
BLOCK = 10_000
#: Bases of (start, end) in each format (fixed values).
BASES = {"codebase": (1, 1), "vcf": (1, 1), "bed": (0, 1), "interval": (0, 1), "gff": (1, 1), "eland": (1, 1), "tagalign": (1, 1), "bowtie": (0, 0), "sam": (1, 1)}


def translate_start(c: Column, source: str, target: str) -> Column:
    return c + F.lit(BASES[target][0] - BASES[source][0])


def translate_end(c: Column, source: str, target: str) -> Column:
    return c + F.lit(BASES[target][1] - BASES[source][1])


def normalize_chrom(c: Column) -> Column:
    return F.regexp_replace(c, "^(chr|Chr|CHR)", "")


def _fields(lines: DataFrame, sep: str, least: int, make: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """The columns that ``make`` builds of a line's fields. The fields are bound once per line, and as a generator makes the
    rows, no filter on the columns is pushed below it to split the line again."""
    value = F.col("value") if sep == "\t" else F.trim(F.col("value"))
    whole = F.filter(F.array(F.split(value, sep)), lambda f: F.size(f) >= least)
    made = F.transform(whole, lambda f: F.struct(*(c.alias(name) for name, c in make(f).items())))
    return lines.select(*(c for c in lines.columns if c != "value"), F.inline(made))


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def _reads(lines: DataFrame, sep: str, least: int, make: Callable[[Column], tuple[Column, Column, Column, Column]]) -> DataFrame:
    """make: chromosome, strand, position and CIGAR of the fields."""

    def columns(f: Column) -> dict[str, Column]:
        chrom, strand, pos, cigar = make(f)
        return {"chrom": normalize_chrom(chrom), "strand": strand, "pos": pos, "cigar": cigar}

    return _fields(lines, sep, least, columns).where("pos >= 1 AND chrom <> '' AND strand IS NOT NULL AND cigar IS NOT NULL")


def _sign(c: Column) -> Column:
    return F.when(c == "-", "R").when(c == "+", "F")


def _m(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit("M"))


def _no_header(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("value").startswith("@"))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Unmapped reads (flag 4) are dropped; flag 16 is the reverse strand."""
    bit = lambda f, n: _long(f[1]).bitwiseAND(F.lit(n)) != 0
    strand = lambda f: F.when(~bit(f, 4), F.when(bit(f, 16), "R").otherwise("F"))
    return _reads(_no_header(lines), "\t", 11, lambda f: (f[2], strand(f), _long(f[3]), f[5]))


def parse_eland(lines: DataFrame) -> DataFrame:
    """A strand of ``-`` is reverse, anything else forward."""
    return _reads(lines, r"\s+", 9, lambda f: (f[6], F.when(f[8].startswith("-"), "R").otherwise("F"), _long(f[7]), _m(F.length(f[1]))))


def parse_tagalign(lines: DataFrame) -> DataFrame:
    return _reads(lines, r"\s+", 6, lambda f: (f[0], _sign(f[5]), _long(f[1]), _m(_long(f[2]) - _long(f[1]) + 1)))


def parse_bowtie(lines: DataFrame) -> DataFrame:
    return _reads(lines, "\t", 5, lambda f: (f[2], _sign(f[1]), _long(f[3]) + 1, _m(F.length(f[4]))))


def parse_bed4(lines: DataFrame) -> DataFrame:
    return _reads(lines, r"\s+", 5, lambda f: (f[0], _sign(f[4]), _long(f[1]) + 1, _m(_long(f[2]) - _long(f[1]))))


def parse_bed6(lines: DataFrame) -> DataFrame:
    return _reads(lines, r"\s+", 6, lambda f: (f[0], _sign(f[5]), _long(f[1]) + 1, _m(_long(f[2]) - _long(f[1]))))


def parse_preprocessed(lines: DataFrame) -> DataFrame:
    """chrom, pos, cigar, sign."""
    return _reads(_no_header(lines), r"\s+", 4, lambda f: (f[0], _sign(f[3]), _long(f[1]), f[2]))


#: Formats by name. A new format is one more entry.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"SAM": parse_sam, "ELAND": parse_eland, "tagAlign": parse_tagalign, "bowtie": parse_bowtie, "BED4": parse_bed4, "BED6": parse_bed6, "preprocessed": parse_preprocessed}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


#: Formats whose lines name the read, and the field that does.
READ_IDS = {"SAM": ("\t", 0), "ELAND": (r"\s+", 0), "bowtie": ("\t", 0), "BED4": (r"\s+", 3), "BED6": (r"\s+", 3), "tagAlign": (r"\s+", 3)}


def with_read_ids(lines: DataFrame, fmt: str) -> DataFrame:
    """lines with a column read_id, which every parser keeps."""
    if fmt not in READ_IDS:
        raise ValueError(f"{fmt} has no read ids")
    sep, field = READ_IDS[fmt]
    return lines.withColumn("read_id", F.get(F.split("value", sep), F.lit(field)))


def preprocess(spark: SparkSession, fmt: str, path: str, out_dir: str, read_ids: bool = False) -> None:
    """Parse a file of reads into Parquet by chromosome; a second run appends (pools).

    Reads are dealt by ranges of chromosome and position and lie in order, so a file's statistics tell a query for a range of
    positions which files and row groups it can leave out. ``read_ids`` keeps the reads' names.
    """
    lines = read_lines(spark, path)
    parsed = PARSERS[fmt](with_read_ids(lines, fmt) if read_ids else lines)
    parsed.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.mode("append").partitionBy("chrom").parquet(out_dir)


def read_pool(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """Reads of several preprocessed folders with the folder as replicate; only chromosomes of the first count. A folder that is
    not there, or holds nothing, has no reads."""
    schema = "strand string, pos bigint, cigar string, chrom string"
    each = [(spark.read.schema(schema).parquet(d) if _exists(spark, d) else spark.createDataFrame([], schema)).withColumn("replicate", F.lit(str(i))) for i, d in enumerate(dirs)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.join(each[0].select("chrom").distinct(), "chrom", "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def reads_per_chromosome(reads: DataFrame) -> DataFrame:
    return reads.groupBy("chrom").agg(F.count("*").alias("n"))


def _checked(regions: DataFrame) -> DataFrame:
    return regions.withColumn("start", F.when(F.col("start") > F.col("end"), F.raise_error(F.lit("a region starts after its end"))).otherwise(F.col("start"))).where("start IS NOT NULL AND end IS NOT NULL")


def _or(f: Column, i: int, default: str) -> Column:
    return F.coalesce(F.get(f, F.lit(i)), F.lit(default))


def parse_bed(lines: DataFrame) -> DataFrame:
    """Regions: tab fields chrom, start, end and perhaps name, score, strand; start above end is an error."""
    told = lines.where("value <> '' AND NOT startswith(value, '#') AND NOT startswith(value, 'track')")
    return _checked(_fields(told, "\t", 3, lambda f: {"chrom": normalize_chrom(f[0]), "start": _long(f[1]) + 1, "end": _long(f[2]), "name": _or(f, 3, "."), "score": _or(f, 4, "0").try_cast("int"), "strand": _or(f, 5, "+")}))


def parse_bed12(lines: DataFrame) -> DataFrame:
    """Regions with their blocks as ``intervals``."""
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), _long)
    blocks = lambda f: F.zip_with(numbers(f[11]), numbers(f[10]), lambda s, n: F.struct((_long(f[1]) + 1 + s).alias("start"), (_long(f[1]) + s + n).alias("end")))
    return _fields(lines, "\t", 12, lambda f: {"chrom": normalize_chrom(f[0]), "start": _long(f[1]) + 1, "end": _long(f[2]), "name": f[3], "strand": f[5], "intervals": blocks(f)}).where("start IS NOT NULL AND end IS NOT NULL")


def parse_interval(lines: DataFrame) -> DataFrame:
    """Regions with blocks: name, chrom, strand, start, end, number of blocks, their starts and ends (commas between)."""
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), _long)
    blocks = lambda f: F.zip_with(numbers(f[6]), numbers(f[7]), lambda s, e: F.struct((s + 1).alias("start"), e.alias("end")))
    return _fields(lines, r"\s+", 8, lambda f: {"chrom": normalize_chrom(f[1]), "start": _long(f[3]) + 1, "end": _long(f[4]), "name": f[0], "strand": f[2], "intervals": blocks(f)}).where("start IS NOT NULL AND end IS NOT NULL")


def _double(c: Column) -> Column:
    return c.try_cast("double")


def parse_broadpeak(lines: DataFrame) -> DataFrame:
    return _checked(_fields(lines, r"\s+", 9, lambda f: {"chrom": normalize_chrom(f[0]), "start": _long(f[1]) + 1, "end": _long(f[2]), "enrichment": _double(f[6]), "p": _double(f[7]), "q": _double(f[8])}))


def parse_narrowpeak(lines: DataFrame) -> DataFrame:
    return _checked(_fields(lines, r"\s+", 10, lambda f: {"chrom": normalize_chrom(f[0]), "start": _long(f[1]) + 1, "end": _long(f[2]), "enrichment": _double(f[6]), "p": _double(f[7]), "q": _double(f[8]), "summit": _long(f[9])}))


def parse_lengths(lines: DataFrame) -> DataFrame:
    """Chromosomes and their lengths."""
    return _fields(lines, r"\s+", 2, lambda f: {"chrom": normalize_chrom(f[0]), "length": _long(f[1])}).where("length IS NOT NULL")


def parse_sgr(lines: DataFrame) -> DataFrame:
    """A height per position: chrom, pos, value."""
    return _fields(lines, r"\s+", 3, lambda f: {"chrom": normalize_chrom(f[0]), "pos": _long(f[1]), "value": _double(f[2])}).where("pos IS NOT NULL AND value IS NOT NULL")


def bedgraph_lines(lines: DataFrame) -> DataFrame:
    """track (chromosome), start, end (from 1, inclusive) and value of lines that have four fields; headers drop out."""
    rows = _fields(lines, r"\s+", 4, lambda f: {"track": normalize_chrom(f[0]), "start": _long(f[1]) + 1, "end": _long(f[2]), "value": _double(f[3])})
    return rows.where("end >= start AND value IS NOT NULL")


def parse_bedgraph(lines: DataFrame) -> DataFrame:
    """A dense track (pos, value): later lines win. Needs a column ``line`` with the line's number. ``files.read_bedgraph`` and
    ``segments.paint`` do the same from files and without a row per position."""
    rows = _fields(lines, r"\s+", 4, lambda f: {"s": _long(f[1]), "e": _long(f[2]), "value": _double(f[3])}).where("e > s")
    return rows.select("line", "value", F.explode(F.sequence(F.col("s") + 1, F.col("e"))).alias("pos")).groupBy("pos").agg(F.max_by("value", "line").alias("value"))


def parse_fastq(lines: DataFrame) -> DataFrame:
    """Records of four lines. Needs a column ``line`` (from 0), counted per file; all other columns, such as the file, tell the
    files apart and stay. Records that are not whole, or do not begin with @, drop out."""
    apart = [c for c in lines.columns if c not in ("line", "value")]
    record = lines.groupBy(*apart, F.expr("line div 4").alias("record")).agg(*(F.max(F.when(F.col("line") % 4 == i, F.col("value"))).alias(n) for i, n in enumerate(("id", "nucs", "plus", "quality"))))
    return record.where("startswith(id, '@') AND quality IS NOT NULL").select(*apart, "record", F.expr("substring(id, 2)").alias("id"), "nucs", "quality")


def parse_sam_sequences(lines: DataFrame) -> DataFrame:
    """Sequences and qualities as they stand, of mapped and unmapped reads."""
    return _fields(_no_header(lines), "\t", 11, lambda f: {"id": f[0], "nucs": f[9], "quality": f[10]})


def fill_mappability(given: DataFrame) -> DataFrame:
    """chrom, win, n_mappable with the windows that a map skips at 0."""
    grid = _windows(given.groupBy("chrom").agg(F.max("win").alias("last")))
    return grid.join(given, ["chrom", "win"], "left").select("chrom", "win", F.coalesce("n_mappable", F.lit(0)).cast("bigint").alias("n_mappable"))


def full_mappability(fragments: DataFrame, window: int = 1_000_000) -> DataFrame:
    """Without a map every window up to the chromosome's end counts in full."""
    ends = fragments.groupBy("chrom").agg(F.max(F.col("start") + F.col("len")).alias("e"))
    return _windows(ends.selectExpr("chrom", f"e div {window} AS last")).withColumn("n_mappable", F.lit(window).cast("bigint"))


def _windows(lasts: DataFrame) -> DataFrame:
    """chrom, win from 0 to the chromosome's ``last``. A chromosome is one row that may become very many, so blocks of its windows
    are dealt by the number of all windows; no array is longer than a block, or the number of blocks."""
    table = staged(lasts, "lasts").where("last >= 0")
    blocks = table.select("chrom", "last", F.explode(F.expr(f"sequence(0L, last div {BLOCK})")).alias("_block"))
    spread = blocks.repartition(tasks_for(table.sparkSession, table.agg(F.sum(F.col("last") + 1)).first()[0] or 0), "chrom", "_block")
    return spread.select("chrom", F.explode(F.expr(f"sequence(_block * {BLOCK}, least(last, _block * {BLOCK} + {BLOCK - 1}))")).alias("win"))
