"""What the corpus operators share: word rule, table reading, staged tables, CRC in SQL."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of code points other than ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a narrow table that are broadcast at most; more are joined by a shuffle.
FEW = 250_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


#: Rows of an Arrow batch. Spark's default of 10,000 texts of a few KB takes hundreds of MB in the executor and its workers.
BATCH_ROWS = "1000"
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, after seeing to it that the session sends rows to Python in small batches (a size that the user chose is left alone)."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) == "10000":
        conf.set(_BATCH_KEY, BATCH_ROWS)
    return df


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows, so that a task holds the Python values of no more than that."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def whole_row(df: DataFrame) -> Column:
    """All columns of a row in one struct, so that their names meet no inner ones."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def row_fields(df: DataFrame, struct: str, *new: str) -> list[Column]:
    """The columns of ``df`` out of that struct, but for those that new ones replace."""
    return [F.col(struct)[c].alias(c) for c in df.columns if c not in new]


def hash_bucket(hex_hash: Column, buckets: Column) -> Column:
    """Bucket 0..buckets-1 in the order of a hexadecimal hash (its first 32 bits scaled)."""
    return F.floor(F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("double") * buckets / F.lit(4294967296.0)).cast("long")


def tasks_for(rows: int, each: int = 20_000) -> int:
    """Tasks for a table of so many rows: a small one is not cut into as many parts as the session has for large ones."""
    return max(1, -(-rows // each))


def meet(df: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner", few: int | None = None) -> DataFrame:
    """df joined with a narrow table that is cheap to count (staged): broadcast up to ``FEW`` rows, beyond that by a shuffle."""
    few = FEW if few is None else few
    return df.join(other.hint("broadcast" if other.limit(few + 1).count() <= few else "merge"), on, how)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where it is unset and all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies in."""
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


class Staging:
    """Tables written once to the shared folder, so that a lost executor costs no recomputation of what led to them.

    ``put`` writes and rereads; ``drop`` deletes a table that nothing reads any more. What is left goes at exit.
    """

    def __init__(self, spark: SparkSession):
        self.token = uuid.uuid4().hex
        self.spark, self.root = spark, f"{shared_dir(spark)}/staged-{self.token}"
        self._n, self._live = 0, {}
        atexit.register(self._clean)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def put(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """df as a table. rows: how many there are at most, where that is known; a small table is made by few tasks."""
        path = self.path(name)
        (df if rows is None else df.coalesce(tasks_for(rows))).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at = path
        self._live[path] = None
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in {getattr(t, "staged_at", None) for t in tables} & self._live.keys():
            remove(self.spark, path)
            del self._live[path]

    def drop_all_but(self, *tables: DataFrame) -> None:
        for path in self._live.keys() - {t.staged_at for t in tables}:
            remove(self.spark, path)
            del self._live[path]

    def _clean(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the session has ended; the cluster's own cleaning of the shared folder remains
            pass


def crc32_sql(text: str) -> str:
    """DuckDB: CRC-32 (reflected, polynomial 0xEDB88320) of a text's UTF-8, byte by byte; for the oracle only."""
    ones = []
    for j in range(8):
        c = 1 << j
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        ones.append(c)
    step = "a >> 8"
    for j, c in enumerate(ones):
        step = f"xor({step}, ((xor(a, b) >> {j}) & 1) * {c})"
    x = f"hex(encode({text}))"
    data = f"list_transform(string_split(regexp_replace({x}, '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, b: {step}), 4294967295::BIGINT)"
