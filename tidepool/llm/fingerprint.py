"""Document fingerprints by Lempel-Ziv phrases and minimum hashes, and their comparison along the order of ids.

A text's UTF-8 is parsed into the phrases of a growing dictionary (LZ78: the longest known phrase and one byte more is the
next phrase). The phrases are hashed, and the ``HASHES`` smallest 32-bit hashes of the set are the signature. Two
signatures are compared by the share of common hashes among the smallest of both together, an estimate of the Jaccard
similarity of the phrase sets. A phrase set grows in a new passage as a compressor's dictionary does, so likeness follows
what compression of one text with the other would save.

Comparing each text with the next one by id needs neighbours, not a global sort in one task: ids are cut at quantiles that
are ids themselves, each slice also receives the row that starts the next slice (the last slice that of the first), and
slices are sorted and streamed. The texts are shuffled once; a task holds two texts at a time.

Edge cases: null texts count as empty; an empty text has an empty fingerprint, alike (1.0) to another empty one and to no
other (0.0). A null id stands before all others. Repeated ids are ordered by text; each row is the next of the one before.
One single row is its own next row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

HASHES = 128
#: Rows per slice in the mean, and the most slices (their starts go with the tasks: 8 bytes each).
SLICE_ROWS = 4000
MAX_SLICES = 100_000
_BASE = 0x9E3779B97F4A7C15 | 1
_NULL = -(2**63)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64), dtype=np.uint64)


class Parser:
    """LZ78 parsing that can be forked: ``ends`` has the end of each phrase so far."""

    def __init__(self):
        self.trie: dict[int, int] = {}
        self.ends: list[int] = []
        self.node = 0

    def fork(self) -> Parser:
        other = Parser()
        other.trie, other.ends, other.node = self.trie.copy(), self.ends.copy(), self.node
        return other

    def feed(self, data: bytes, offset: int) -> Parser:
        trie, node, add = self.trie, self.node, self.ends.append
        get, fresh = trie.get, (len(trie) + 1) << 8
        for at, c in enumerate(data, offset + 1):
            known = get(node + c)
            if known is None:
                trie[node + c] = fresh
                fresh += 256
                node = 0
                add(at)
            else:
                node = known
        self.node = node
        return self

    def signature(self, data: bytes) -> np.ndarray:
        """The smallest hashes of the phrases of ``data``, all of which has been fed (sorted, distinct)."""
        ends = np.array(self.ends if self.node == 0 else [*self.ends, len(data)], np.int64)
        if not len(ends):
            return np.zeros(0, np.uint32)
        starts = np.concatenate([[0], ends[:-1]])
        within = np.arange(len(data)) - np.repeat(starts, ends - starts)
        powers = _POWERS if within.max() < len(_POWERS) else np.cumprod(np.full(int(within.max()) + 1, _BASE, np.uint64), dtype=np.uint64)
        h = np.add.reduceat((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * powers[within], starts)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h = h.astype(np.uint32)
        if len(h) > 4 * HASHES:
            h = h[h <= np.partition(h, 2 * HASHES)[2 * HASHES]]  # equal hashes may repeat: keep more than asked for
        u = np.unique(h)
        return u[:HASHES]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    k = HASHES if len(a) == HASHES or len(b) == HASHES else len(a) + len(b)
    both = np.union1d(a, b)[:k]
    return float(np.intersect1d(np.intersect1d(a, b, True), both, True).size / both.size)


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    return Parser().feed(data, 0).signature(data)


class _Doc:
    """A text with its parse up to the edit and its signature."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.n = doc_id, text, len(text)
        self.head = text[: self.n - self.n // 2].encode()
        self.data = text.encode()
        self.parsed = Parser().feed(self.head, 0)
        rest = self.parsed.fork().feed(self.data[len(self.head) :], len(self.head))
        self.signature = rest.signature(self.data)

    def against(self, other: _Doc) -> tuple:
        put = other.text[: self.n // 2].encode()
        edited = self.head + put
        signature = self.parsed.feed(put, len(self.head)).signature(edited)  # the fork is used up here
        return (self.doc_id, self.n, hashlib.sha256(edited).hexdigest(), to_hex(self.signature), to_hex(signature), likeness(self.signature, signature), likeness(self.signature, other.signature))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row (see above)."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("k"))
    n = ids.count()
    slices = max(1, min(MAX_SLICES, n // SLICE_ROWS))
    cut = ids.agg(F.min("k").alias("first"), F.percentile_approx("k", [i / slices for i in range(1, slices)] or [0.5], 100 * slices).alias("cuts")).first()
    starts = np.unique(np.array([] if cut["first"] is None else [cut["first"], *(cut["cuts"] if slices > 1 else [])], np.int64))

    def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = pc.fill_null(b.column(0).cast(pa.int64()), _NULL).to_numpy()
            at = np.searchsorted(starts, key, "right") - 1
            guest = np.flatnonzero(starts[at] == key)  # what starts a slice also ends the slice before
            rows = np.concatenate([np.arange(len(key)), guest])
            s = np.concatenate([at, (at[guest] - 1) % len(starts)])
            is_guest = np.arange(len(rows)) >= len(key)
            yield pa.record_batch([pa.array(s, pa.int32()), pa.array(is_guest), pa.array(key[rows]), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], names=["slice", "guest", "k", "id", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    sliced = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(slices_of, f"slice int, guest boolean, k long, id {kind}, text string")
    out = f"{id_col} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(id_col, pa.from_numpy_dtype(np.dtype({"int": "i4", "bigint": "i8"}.get(kind, "i8")))), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        now, before = None, None
        for b in batches:
            rows = []
            for s, guest, doc_id, text in zip(b.column(0), b.column(1), b.column(3), b.column(4), strict=True):
                s, guest = s.as_py(), guest.as_py()
                if s != now:
                    now, before = s, None
                if guest and before is None:
                    continue  # further rows of a repeated id
                doc = _Doc(doc_id.as_py(), text.as_py())
                if before is not None:
                    rows.append(before.against(doc))
                before = None if guest else doc
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return sliced.repartition("slice").sortWithinPartitions("slice", "guest", "k", "text").mapInArrow(walk, out)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(documents(spark, sf_dir))
