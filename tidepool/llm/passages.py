"""Substring deduplication: removes every word that lies in a window of words that also starts elsewhere.

Anchors: each document's words are cut into blocks of ``block`` words that do not overlap, with 2 * block - 1 <= window,
so every window holds a whole block. The blocks are the index; all rolling windows of ``block`` words probe it. A repeated
window therefore holds a position whose probe meets a block that stands elsewhere. Extension: around such hits the
windows of full length are compared by 96 further bits of hash; a maximal exact repeat is the union of its windows.

Exchange: documents are dealt into chunks by a hash of id and text. A chunk sends each bucket of the hash space one row: its
distinct probes (32 bits beside the bucket's), packed, those it has twice, and its blocks. A bucket answers each
chunk with its hits. So a passage that very many documents share is one probe per chunk, and no pair of its places is ever
made. Documents are shuffled once (the three passes reuse that exchange).

Numbers of chunks and buckets follow the total size of the texts, so that what one task holds stays bounded. Rows equal in id
and text (128 bits of hash) would share a chunk: where they are too many for one, all their windows repeat, so each is answered
where it is read, and two of them stand for all in the chunks.

Edge cases: null texts have no words; texts shorter than a window lose nothing; a very long text is held whole by its chunk's
task. A row is a text of its own: of repeated rows all windows repeat. Null ids are ids like others. An empty table gives no rows.
Other columns are not read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents
from .hashing import Words

WINDOW = 35
BLOCK = 18
CHUNK_BYTES = 6 << 20
BUCKET_WORDS = 2_000_000
#: Marks of repeated rows that are broadcast at most (16 bytes each); more are joined by a shuffle.
FEW = 250_000
_PACKED = "bucket long, chunk long, once binary, twice binary, blocks binary"


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, byte by byte of equal rank, so that the shuffle's compression finds the zeros."""
    gaps = np.diff(sorted_values, prepend=np.uint32(0)).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
    return np.cumsum(gaps, dtype=np.uint32)


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _texts(t: pa.Table | pa.RecordBatch) -> list[bytes]:
    return [(x or "").encode() for x in t.column("text").to_pylist()]


def _probes(texts: list[bytes], block: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, rolling hashes, where they count, and where a block starts."""
    w = Words(texts)
    h = w.windows(w.hashes(), block)
    inside = w.inside(block)
    first = np.repeat(w.bounds[:-1], np.diff(w.bounds))
    return w, h, inside, inside & ((np.arange(len(w)) - first) % block == 0)


def _ask(table: pa.Table, block: int, buckets: int) -> pa.Table:
    """Step 1, per chunk: its blocks and probes for each bucket."""
    _, h, inside, starts = _probes(_texts(table), block)
    keys, counts = np.unique(h[inside], return_counts=True)
    blocks = np.unique(h[starts])
    chunk, parts = table.column("chunk")[0].as_py(), []
    filled = np.unique(_buckets(keys, buckets))  # the others' buckets are among these
    for x in (keys, keys[counts > 1], blocks):
        b = _buckets(x, buckets)
        parts.append([pack(np.sort(x[i:j].astype(np.uint32))) for i, j in zip(np.searchsorted(b, filled), np.searchsorted(b, filled, "right"), strict=True)])
    rows = [(int(b), chunk, *p) for b, *p in zip(filled, *parts, strict=True)]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "chunk", "once", "twice", "blocks"])


def _answer(table: pa.Table) -> pa.Table:
    """Step 2, per bucket: which probes meet a block that stands elsewhere, for each chunk."""
    chunks = table.column("chunk").to_pylist()
    once = [unpack(x) for x in table.column("once").to_pylist()]
    every = np.concatenate([*once, *(unpack(x) for x in table.column("twice").to_pylist())])
    values, counts = np.unique(every, return_counts=True)
    blocks = np.unique(np.concatenate([unpack(x) for x in table.column("blocks").to_pylist()]))
    hits = np.intersect1d(values[counts > 1], blocks, assume_unique=True)
    bucket = table.column("bucket")[0].as_py()
    rows = [(c, bucket, pack(found)) for c, o in zip(chunks, once, strict=True) if len(found := np.intersect1d(o, hits))]
    columns = zip(*rows, strict=True) if rows else [[], [], []]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["chunk", "bucket", "hits"])


def _candidates(table: pa.Table, replies: pa.Table, window: int, block: int, buckets: int):
    """The chunk's words, and of its windows that hold a hit: start, first and second hash."""
    w, h, inside, _ = _probes(_texts(table), block)
    none = np.zeros(0, np.uint64)
    if not replies.num_rows:
        return w, np.zeros(0, np.int64), none, none
    key = lambda b, low: (b.astype(np.uint64) << np.uint64(32)) | low
    hits = np.concatenate([key(np.uint64(b), unpack(x).astype(np.uint64)) for b, x in zip(replies.column("bucket").to_pylist(), replies.column("hits").to_pylist(), strict=True)])
    hit = inside & np.isin(key(_buckets(h, buckets), h & np.uint64(0xFFFFFFFF)), hits)
    upto = np.concatenate([[0], np.cumsum(hit)])
    starts = np.flatnonzero(w.inside(window))
    starts = starts[upto[starts + window - block + 1] > upto[starts]]
    if not len(starts):
        return w, starts, none, none
    return w, starts, w.windows(w.hashes(), window)[starts], w.windows(w.hashes(1), window, 1)[starts]


def _groups(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each entry, the same for entries equal in both values."""
    order = np.lexsort((a, b))
    new = np.concatenate([[0], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(a)]
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def _joined(columns: list, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(columns), kind)


_WINDOWS = "bucket long, chunk long, a binary, b binary, twice binary"
_REPEATS = "chunk long, bucket long, a binary, b binary"


def _extend(table: pa.Table, replies: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    """Step 3, per chunk: the full windows around hits for each bucket, distinct, and whether it has them twice."""
    rows = []
    if table.num_rows and replies.num_rows:
        chunk = table.column("chunk")[0].as_py()
        _, _, a, b = _candidates(table, replies, window, block, buckets)
        bucket, a = _buckets(a, buckets), a.astype(np.uint32)  # both empty if no window of full length holds a hit
        group = _groups(a, b)
        _, first, counts = np.unique(group, return_index=True, return_counts=True)
        order = np.argsort(bucket[first], kind="stable")
        first, twice = first[order], (counts > 1)[order]
        filled, at = np.unique(bucket[first], return_index=True)
        ends = np.append(at, len(first))[1:]
        rows = [(int(k), chunk, a[first[i:j]].tobytes(), b[first[i:j]].tobytes(), twice[i:j].tobytes()) for k, i, j in zip(filled, at, ends, strict=True)]
    columns = zip(*rows, strict=True) if rows else [[] for _ in range(5)]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "a", "b", "twice"])


def _confirm(table: pa.Table) -> pa.Table:
    """Step 4, per bucket: which windows stand in two places, for each chunk."""
    each_a, each_b = table.column("a").to_pylist(), table.column("b").to_pylist()
    a, b, twice = _joined(each_a, "<u4"), _joined(each_b, "<u8"), _joined(table.column("twice").to_pylist(), "?")
    group = _groups(a, b)
    repeated = (np.bincount(group, weights=1 + twice) > 1)[group]
    ends = np.cumsum([0, *(len(x) // 8 for x in each_b)])
    bucket, rows = table.column("bucket")[0].as_py(), []
    for c, i, j in zip(table.column("chunk").to_pylist(), ends[:-1], ends[1:], strict=True):
        if repeated[i:j].any():
            rows.append((c, bucket, a[i:j][repeated[i:j]].tobytes(), b[i:j][repeated[i:j]].tobytes()))
    columns = zip(*rows, strict=True) if rows else [[] for _ in range(4)]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "bucket", "a", "b"])


def _removed(table: pa.Table, replies: pa.Table, repeats: pa.Table, window: int, block: int, buckets: int) -> tuple[Words, np.ndarray]:
    w, starts, a, b = _candidates(table, replies, window, block, buckets)
    cover = np.zeros(len(w) + 1, np.int64)
    if repeats.num_rows and len(starts):
        known_a, known_b = _joined(repeats.column("a").to_pylist(), "<u4"), _joined(repeats.column("b").to_pylist(), "<u8")
        group = _groups(np.concatenate([a.astype(np.uint32), known_a]), np.concatenate([b, known_b]))
        repeated = np.zeros(group.max() + 1, bool)
        repeated[group[len(a) :]] = True
        s = starts[repeated[group[: len(a)]]]
        np.add.at(cover, s, 1)
        np.add.at(cover, s + window, -1)
    return w, np.cumsum(cover[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept (words left, joined by a space; if with_text), kept_sha256 of every row."""
    block = (window + 1) // 2
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("mark"), F.xxhash64(F.lit(1), text_col, id_col).alias("other"), F.lit(False).alias("stands_in"))
    alike = marked.groupBy("mark", "other", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).agg(F.count("*").alias("c")).withColumn("weight", F.col("c") * F.col("size"))
    total, heaviest = alike.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max(F.when(F.col("c") > 1, F.col("weight"))), F.lit(0))).first()
    chunks, buckets = max(1, -(-total // CHUNK_BYTES)), max(1, -(-total // (6 * BUCKET_WORDS)))
    hot = None
    if heaviest > CHUNK_BYTES:
        many = alike.where((F.col("c") > 1) & (F.col("weight") > CHUNK_BYTES)).select("mark", "other")
        many = F.broadcast(many) if many.count() <= FEW else many.hint("merge")
        hot = marked.join(many, ["mark", "other"], "left_semi")
        twice = hot.groupBy("mark", "other").agg(F.first("text").alias("text")).select(F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), "text", "mark", "other", F.explode(F.array(F.lit(True), F.lit(True))).alias("stands_in"))
        marked = marked.join(many, ["mark", "other"], "left_anti").unionByName(twice)
    rows = marked.select(F.pmod("mark", F.lit(chunks)).alias("chunk"), "id", "text", "stands_in")
    answers = "chunk long, bucket long, hits binary"

    asked = rows.groupBy("chunk").applyInArrow(lambda t: _ask(t, block, buckets), _PACKED)
    hits = asked.groupBy("bucket").applyInArrow(_answer, answers)
    extended = rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(lambda t, r: _extend(t, r, window, block, buckets), _WINDOWS)
    repeats = extended.groupBy("bucket").applyInArrow(_confirm, _REPEATS)
    both = hits.unionByName(repeats, allowMissingColumns=True)
    out = docs.select(F.col(id_col)).schema.add("n_words", "long").add("n_removed", "long")
    out = (out.add("kept", "string") if with_text else out).add("kept_sha256", "string")

    def rows_out(ids, texts: list[bytes], drops: list[np.ndarray]) -> list:
        n, cut, kept, sha = [], [], [], []
        for text, drop in zip(texts, drops, strict=True):
            left = b" ".join(compress(text.split(), ~drop))
            n.append(len(drop))
            cut.append(int(drop.sum()))
            kept.append(left.decode() if with_text else None)
            sha.append(hashlib.sha256(left).hexdigest())
        return [ids, pa.array(n, pa.int64()), pa.array(cut, pa.int64()), *([pa.array(kept, pa.string())] if with_text else []), pa.array(sha, pa.string())]

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        confirmed = replies.column("a").is_valid()
        w, gone = _removed(table, replies.filter(replies.column("hits").is_valid()), replies.filter(confirmed), window, block, buckets)
        drops = [gone[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        done = pa.table(rows_out(table.column("id"), _texts(table), drops), names=out.names)
        return done.filter(pc.invert(table.column("stands_in")))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b)
            drops = [np.full(n, n >= window) for n in (len(t.split()) for t in texts)]
            yield pa.record_batch(rows_out(b.column("id"), texts, drops), names=out.names)

    done = rows.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, out)
    return done if hot is None else done.union(hot.select("id", "text").mapInArrow(repeated, out))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)


ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 1))) AS i, w FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM r),
x AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, len(w) AS n, coalesce(len(gone), 0) AS cut, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept FROM w LEFT JOIN x USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(cut AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
