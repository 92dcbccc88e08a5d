"""Vector code compression: product quantisation whose codebooks are learned by Lloyd's rounds on integers, kept up by deltas.

Components become integers floor(256 * x), vectors are cut into equal parts, and each part position has its own codebook.
A round assigns every part to its nearest entry. The integer sums and counts of the entries run on from round to round: a part
that changed its entry counts plus one at the new and minus one at the old entry, others move nothing. Assignments of a round
are written beside the vectors, so the next round knows what changed and a lost executor costs no earlier round. A task adds
its contributions up before the shuffle, so a round shuffles parts x entries rows a task at most, whatever its rows; sums and
codebooks (parts x entries x width, bounded by the parameters) are all that the driver sees.

Edge cases: rows whose vector is null, or holds a null or non-finite component, drop out. So do those whose length is not the
length of the first kept one (the smallest id whose vector's length is a positive multiple of the number of parts), as they
have no such parts. Scaled components beyond 2**24 are taken as that bound, so that all distances are exact integers. Rows of
one id are coded each on its own; the first codebook takes the smallest rows by id and then vector, without null ids. Fewer
rows than entries give smaller codebooks; with none but null ids there is no codebook and no row. Ties go to the lower entry.
Null labels count together. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import FEW, Staging

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, LIMIT = 256, 1 << 24
#: Vectors whose distances a task holds at once.
SLICE = 4096


def scaled(flat: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x: (rows, parts, width); books: (parts, entries, width). Nearest entries (the lower of equal ones) and squared distances.

    Float products are exact as long as all sums stay below 2**53; otherwise integers are multiplied.
    """
    most = 2 * max(np.abs(x).max(initial=0), np.abs(books).max(initial=0))
    kind = np.float64 if float(most) ** 2 * x.shape[2] < 2**53 else np.int64
    a, c = x.transpose(1, 0, 2).astype(kind), books.astype(kind)
    d = (a * a).sum(2)[:, :, None] - 2 * (a @ c.transpose(0, 2, 1)) + (c * c).sum(2)[:, None, :]
    codes = d.argmin(2)
    return codes.T, np.take_along_axis(d, codes[:, :, None], 2)[:, :, 0].T.astype(np.int64)


class Totals:
    """Counts and sums of what parts contribute to their entries."""

    def __init__(self, parts: int, entries: int, width: int):
        self.shape = (parts, entries, width)
        self.n, self.sums = np.zeros((parts, entries), np.int64), np.zeros(self.shape, np.int64)

    def add(self, x: np.ndarray, codes: np.ndarray, which: np.ndarray, sign: int) -> None:
        """x and codes of the parts in ``which`` (rows, parts), with plus or minus one."""
        parts, entries, width = self.shape
        at = (np.arange(parts) * entries + codes)[which]
        self.n += sign * np.bincount(at, minlength=parts * entries).reshape(parts, entries)
        cells = (at[:, None] * width + np.arange(width)).ravel()
        # at most SLICE rows of 2**24: exact in floats
        self.sums += sign * np.bincount(cells, x[which].ravel().astype(np.float64), parts * entries * width).astype(np.int64).reshape(self.shape)

    def rows(self) -> list[tuple[int, int, int, list[int]]]:
        """Entries that something changed at."""
        touched = np.argwhere((self.n != 0) | (self.sums != 0).any(2))
        return [(int(p), int(e), int(self.n[p, e]), self.sums[p, e].tolist()) for p, e in touched]

    def entries(self, before: np.ndarray) -> np.ndarray:
        """The codebooks: floor of the mean; what nothing is assigned to stays as before."""
        used = self.n > 0
        return np.where(used[:, :, None], self.sums // np.maximum(self.n, 1)[:, :, None], before)


_DELTA = "part int, entry int, n long, sums array<long>"
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))


def _slices(batches: Iterator[pa.RecordBatch], vec: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            s = b.slice(i, SLICE)
            yield s, s.column(vec).flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, -1)


def _round(rows: DataFrame, books: np.ndarray, known: bool, keep: bool) -> DataFrame:
    """One assignment of rows (id, label, vec, and codes if ``known``): the deltas of the sums, and the rows with their codes if ``keep``."""
    kept = StructType([*rows.select("id", "label").schema.fields]).add("vec", ArrayType(IntegerType())).add("codes", "binary")
    schema = StructType([*kept.fields, *StructType.fromDDL(_DELTA).fields]) if keep else StructType.fromDDL(_DELTA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        totals = Totals(parts, entries, width)
        for b, flat in _slices(batches, 2):
            x = flat.astype(np.int64) if known else scaled(flat)
            x = x.reshape(len(x), parts, width)
            codes, _ = nearest(x, books)
            if known:
                before = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(codes.shape).astype(np.int64)
                changed = codes != before
                totals.add(x, before, changed, -1)
            else:
                changed = np.ones(codes.shape, bool)
            totals.add(x, codes, changed, 1)
            if keep:
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * parts * width, parts * width, dtype=np.int32)[: len(x) + 1]), pa.array(x.ravel().astype(np.int32)))
                raw = codes.astype(np.uint8).tobytes()
                columns = [b.column(0), b.column(1), vec, pa.array([raw[i * parts : (i + 1) * parts] for i in range(len(x))], pa.binary())]
                yield pa.record_batch([*columns, *(pa.nulls(len(x), t) for t in _TYPES)], names=schema.names)
        found = totals.rows()
        delta = [pa.array([r[i] for r in found], t) for i, t in enumerate(_TYPES)]
        if keep:
            own = [pa.nulls(len(found), to_arrow_type(f.dataType)) for f in kept.fields]
            yield pa.record_batch([*own, *delta], names=schema.names)
        else:
            yield pa.record_batch(delta, names=schema.names)

    return rows.mapInArrow(run, schema)



def learn(staging: Staging, kept: DataFrame, books: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """The rows with integer vectors as a table, and the codebooks after the rounds. kept: id, label, vec (doubles)."""
    parts, entries, width = books.shape
    totals, rows, known = Totals(parts, entries, width), kept, False
    for i in range(rounds):
        keep = i == 0 or i < rounds - 1  # the last assignment is made anew after the last update
        made = _round(rows, books, known, keep)
        if keep:
            made = staging.put(made, "assigned")
        moved = made.where("part IS NOT NULL").groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)))
        for r in moved.collect():  # parts x entries at most
            totals.n[r["part"], r["entry"]] += r["n"]
            totals.sums[r["part"], r["entry"]] += np.array(r[3:], np.int64)
        if keep:
            if known:
                staging.drop(table)
            table, known = made, True
            rows = table.where("part IS NULL").select("id", "label", "vec", "codes")
        books = totals.entries(books)
    return rows, books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (hexadecimal) and error of rows with integer vectors."""
    schema = StructType([*rows.select("id", "label").schema.fields]).add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for b, flat in _slices(batches, 2):
            codes, d = nearest(flat.astype(np.int64).reshape(len(flat), parts, width), books)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * parts
            yield pa.record_batch([b.column(0), b.column(1), pa.array([text[i * step : (i + 1) * step] for i in range(len(flat))], pa.string()), pa.array(d.sum(1), pa.int64())], names=schema.names)

    return rows.select("id", "label", "vec").mapInArrow(run, schema)


def with_group_sum(rows: DataFrame, group: str, value: str, name: str, few: int = FEW) -> DataFrame:
    """rows (staged) with the sum of ``value`` over equal groups, nulls together.

    Sums are broadcast up to ``few`` of them. Of more, those of the groups that hold over 1/few of all rows are (there are not
    more than ``few``); the others are small and joined by a shuffle.
    """
    sums = rows.groupBy(F.col(group).alias("_g")).agg(F.sum(value).alias(name), F.count("*").alias("_c"))
    n, every = sums.agg(F.count("*"), F.coalesce(F.sum("_c"), F.lit(0))).first()
    meet = lambda side, hint: rows.join(side.hint(hint), rows[group].eqNullSafe(side["_g"])).select(*rows.columns, name)
    if n <= few:
        return meet(sums, "broadcast")
    return meet(sums.where(F.col("_c") * few > every), "broadcast").union(meet(sums.where(F.col("_c") * few <= every), "merge"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every kept row as a table, and the codebooks (parts, entries, width). entries: 256 at most, rounds: 1 at least."""
    spark = vectors.sparkSession
    staging = Staging(spark)
    whole = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = whole.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("vec") > 0) & (F.size("vec") % parts == 0))
    first = fine.where("id IS NOT NULL").orderBy("id", "vec")
    head = first.select("vec").first()
    width = len(head["vec"]) if head else 0
    kept = fine.where(F.size("vec") == width)
    starts = [r["vec"] for r in first.where(F.size("vec") == width).select("vec").limit(entries).collect()] if head else []
    if not starts:
        nothing = kept.where("false").select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return staging.put(nothing, "coded"), np.zeros((parts, 0, 0), np.int64)
    books = scaled(np.array(starts)).reshape(len(starts), parts, width // parts).transpose(1, 0, 2)
    rows, books = learn(staging, kept, np.ascontiguousarray(books), rounds)
    out = staging.put(coded(rows, books), "coded")
    staging.drop_all_but(out)
    return out, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_group_sum(rows, "label", "error", "label_error")
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assign(r: int) -> str:
    return f"""a{r} AS (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, p.part, entry, CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{r} c USING (part)) GROUP BY r, part)"""


def _update(r: int) -> str:
    return f"""s{r} AS (SELECT part, entry, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT p.part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM p JOIN a{r} USING (r, part)) GROUP BY part, entry, i),
c{r + 1} AS (SELECT part, entry, coalesce(n.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS v FROM s{r} GROUP BY part, entry) n USING (part, entry))"""


ORACLE = f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, vec_id, part, list_transform(e[part * (len(e) // {PARTS}) + 1:(part + 1) * (len(e) // {PARTS})], lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM k, (SELECT unnest(range({PARTS})) AS part)),
c0 AS (SELECT part, n - 1 AS entry, v FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS n FROM p WHERE vec_id IS NOT NULL) WHERE n <= {ENTRIES}),
{", ".join(f"{_assign(r)}, {_update(r)}" for r in range(ROUNDS))},
{_assign(ROUNDS)},
o AS (SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256 FROM k JOIN o USING (r)
"""
