"""Tables between the stages of a plan: written once to the folder that driver and executors share.

A stage that several others read is written and read back, so it is computed once, plans stay small however many stages
follow each other, and a lost executor costs no recomputation of what led to the table.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process by application.
_ROOTS: dict[str, str] = {}
#: Rows that one task makes at most where they come of few, and rows that one task makes alone.
PER_TASK, SMALL = 1_000_000, 20_000
#: Tables of the scopes that are open.
_SCOPES: list[list[DataFrame]] = []


def _root(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir; of our own where that is unset and all run on one machine."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", app)
        _ROOTS[app] = f"{path.rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(_clean, spark, _ROOTS[app])
    return _ROOTS[app]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the session has ended; the cluster's own cleaning of the shared folder remains
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; gone at exit."""
    return f"{_root(spark)}/{uuid.uuid4().hex[:12]}-{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table. A table that this function made stays as it is."""
    if is_staged(df):
        return df
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    for scope in _SCOPES[-1:]:
        scope.append(out)
    return out


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for work that makes so many rows of few: a million a task at most, and enough to keep every core busy."""
    return max(3 * spark.sparkContext.defaultParallelism if rows > SMALL else 1, -(-rows // PER_TASK))


def dealt(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """df of about so many rows by a hash of cols, a million rows a task; as it is if one task may hold them all.

    Spark itself sizes tasks by compressed bytes, or has a fixed number of them, so their rows grow with the table. There are
    never fewer tasks than Spark's own, as a join would shuffle these rows again.
    """
    if rows <= PER_TASK:
        return df
    return df.repartition(max(-(-rows // PER_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *cols)


@contextmanager
def scope() -> Iterator[None]:
    """Tables made inside are deleted at its end; results must be written before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        drop(*_SCOPES.pop())


def is_staged(df: DataFrame) -> bool:
    return "staged_at" in vars(df)


def drop(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more."""
    for t in tables:
        if is_staged(t):
            _remove(t.sparkSession, t.staged_at)
