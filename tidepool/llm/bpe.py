"""Byte-level BPE by longest matches and backtracking.

A piece's bytes are mapped to Latin-1, so that an Aho-Corasick automaton over all tokens (pyahocorasick) finds the longest
token at each position in one pass. Tokens are laid from left to right, longest first; one is kept if it and its left
neighbour are compatible, that is, if merging the bytes of just these two by rank gives these two again. If not, the next
shorter token that is a prefix is tried; if none is left, the position is closed for good and the token before is taken
back. A sequence in which all neighbours are compatible is the one that merging by rank gives, so the result is exact; as
each position is closed once at most, time is linear in the piece's length. Compatibility is memoised per pair.

Tokens are never trained here; ``ranks_path`` is a parameter. Each Python worker builds its tables once and keeps the
pieces it has met, ``CACHE`` at most.

Edge cases: null texts count as empty (0 tokens, hashes of the empty string). Very long texts are encoded whole, and time stays
linear within a piece of any length. Repeated rows are encoded alike. An empty table gives no rows. Other columns are not read,
so they may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from .common import documents, in_slices, small_batches

CACHE = 500_000
CACHED_LENGTH = 64


class ByteBpe:
    """Encoder and decoder for one table of ranks (bytes -> id; the id is the merge's rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self._compatible: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int | None] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank, for pairs of tokens and for tests."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            known = self._compatible[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def shorter(self, t: int) -> int | None:
        """The longest token that is a proper prefix of t."""
        if t not in self._shorter:
            b = self.bytes_of[t]
            self._shorter[t] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), None)
        return self._shorter[t]

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest, lengths = [0] * n, [0] * n
        for end, (size, t) in self.automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > lengths[start]:
                lengths[start], longest[start] = size, t
        open_, out, pos = bytearray(b"\1") * (n + 1), [], 0
        token: int | None = longest[0]
        while pos < n:
            while token is not None:
                end = pos + len(self.bytes_of[token])
                if open_[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter(token)
            if token is None:  # nothing fits here: close the position and shorten the token before
                open_[pos] = 0
                last = out.pop()
                pos -= len(self.bytes_of[last])
                token = self.shorter(last)
            else:
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else None
        return out

    def encode(self, text: str) -> list[int]:
        pieces, known = self.pattern.findall(text), self._pieces
        for p in set(pieces):
            if p not in known:
                ids = tuple(self.encode_bytes(p.encode()))
                if len(p) > CACHED_LENGTH:
                    return [*chain.from_iterable(known[q] if q in known else self.encode_bytes(q.encode()) for q in pieces)]
                known[p] = ids
        out = [*chain.from_iterable(map(known.__getitem__, pieces))]
        if len(known) > CACHE:
            known.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def encoder(ranks_path: str, pattern: str) -> ByteBpe:
    """One encoder per worker process and table."""
    return ByteBpe(read_ranks(ranks_path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids (array<int>, if with_ids), ids_sha256, decoded_sha256 of every row.

    ``ranks_path`` is a file that every executor has, as a tokenizer package installed there gives it.
    """
    schema = docs.select(id_col).schema.add("n_tokens", "long")
    schema = (schema.add("ids", ArrayType(IntegerType())) if with_ids else schema).add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        names = [str(i) for i in range(max(bpe.bytes_of) + 1)]
        for b in in_slices(batches):
            n, all_ids, ids_sha, text_sha = [], [], [], []
            for text in b.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                if with_ids:
                    all_ids.append(ids)
                ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [b.column(0), pa.array(n, pa.int64()), *([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.record_batch(columns, names=schema.names)

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spark, documents(spark, sf_dir), sf_dir)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
