"""Media columns: texts as lossless 8-bit images in archives, read back by a custom Spark data source.

Write: each task appends its members to archives of its own, ``ARCHIVE_BYTES`` each (tar files, and beside each an index of
member offsets), and the commit names the archives that count in a manifest, with the members that start every ``RANGE_BYTES``;
what a failed or repeated attempt wrote is never read.
Read: the planner cuts archives into byte ranges at these marks. The reader of a range reads its own slice of the index,
then the members one after another by offset, and yields Arrow batches of bounded size. A
member that can't be read or whose checksum is wrong is fetched again from its offset, with a new file handle, without the
others being read anew; after ``RETRIES`` times the task fails and Spark repeats it elsewhere. No row is given up.

Archives lie in the folder that all executors share; any file system that pyarrow opens by its address will do.

The medium is an 8-bit greyscale PNG, 64 samples wide, whose samples are the payload: the UTF-8 text with zeros up to a positive
multiple of 64. Equal payloads give equal media. Features are taken from the samples that were read back.

Edge cases: null and empty texts are 64 zeros. Repeated rows become a member each. Null ids stay null. An empty table writes
an empty manifest and reads as no rows. Only the id and text columns are read, so others may have any name. A text must fit
into a task's memory about five times (text, bytes, payload, filtered and packed samples).
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import Staging, documents, in_slices, small_batches

WIDTH = 64
RANGE_BYTES = 8 << 20
ARCHIVE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20
RETRIES = 4
_MAGIC = b"\x89PNG\r\n\x1a\n"  # fixed value: the format's signature
_ENTRY = np.dtype([("offset", "<i8"), ("size", "<i8"), ("id", "<i8"), ("null", "<i8"), ("bytes", "<i8"), ("crc", "<i8")])
SCHEMA = "doc_id long, n_bytes long, media binary"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale image without filters, as written here."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, data, shape = 8, b"", None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("not 8-bit greyscale")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].reshape(-1)


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


@dataclass
class _Archives(WriterCommitMessage):
    marks: dict[str, list[list[int]]]  # of each archive: offset and number of the member that starts a range, and the ends


@dataclass
class _Range(InputPartition):
    """Bytes start..stop of an archive, which hold the members first..last."""

    archive: str
    start: int
    stop: int
    first: int
    last: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class MediaArchive(DataSource):
    """format("media_archive"), option path: a folder of archives. Columns: doc_id, n_bytes (of the text), media."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)), int(self.options.get("retries", RETRIES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return MediaWriter(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)), int(self.options.get("archivebytes", ARCHIVE_BYTES)))


class _Growing:
    """An archive that is being written."""

    def __init__(self, files: fs.FileSystem, root: str, range_bytes: int):
        files.create_dir(root, recursive=True)
        self.files, self.name, self.range_bytes = files, f"{uuid.uuid4().hex}.tar", range_bytes
        self.path = f"{root}/{self.name}"
        self.out, self.at, self.index, self.marks = files.open_output_stream(self.path), 0, bytearray(), [[0, 0]]

    def add(self, doc_id: int | None, n: int, media: bytes) -> None:
        members = len(self.index) // _ENTRY.itemsize
        if self.at >= self.marks[-1][0] + self.range_bytes:
            self.marks.append([self.at, members])
        info = tarfile.TarInfo(f"{doc_id}.{n}.png")
        info.size = len(media)
        block = info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % tarfile.BLOCKSIZE)
        self.out.write(block)
        self.index += struct.pack("<6q", self.at, len(media), doc_id or 0, doc_id is None, n, zlib.crc32(media))
        self.at += len(block)

    def close(self) -> list[list[int]]:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()
        with self.files.open_output_stream(f"{self.path}.index") as f:
            f.write(bytes(self.index))
        return [*self.marks, [self.at, len(self.index) // _ENTRY.itemsize]]


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, path: str, range_bytes: int = RANGE_BYTES, archive_bytes: int = ARCHIVE_BYTES):
        self.path, self.range_bytes, self.archive_bytes = path, range_bytes, archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _open(self.path)
        done, archive = {}, None
        for b in iterator:
            for member in zip(*(c.to_pylist() for c in b.columns), strict=True):
                archive = archive or _Growing(files, root, self.range_bytes)
                archive.add(*member)
                if archive.at >= self.archive_bytes:
                    done[archive.name] = archive.close()
                    archive = None
        if archive:
            done[archive.name] = archive.close()
        return _Archives(done)

    def commit(self, messages: list[_Archives | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps({name: marks for m in messages if m for name, marks in m.marks.items()}).encode())

    def abort(self, messages: list[_Archives | None]) -> None:
        files, root = _open(self.path)
        for m in messages:
            for name in m.marks if m else ():
                files.delete_file(f"{root}/{name}")
                files.delete_file(f"{root}/{name}.index")


class MediaReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, retries: int):
        self.path, self.range_bytes, self.retries = path, range_bytes, retries

    def partitions(self) -> list[InputPartition]:
        files, root = _open(self.path)
        with files.open_input_stream(f"{root}/manifest.json") as f:
            archives = json.loads(f.read())
        ranges = []
        for name, marks in sorted(archives.items()):
            (start, first), *later = marks
            for at, member in later:
                if at - start >= self.range_bytes or [at, member] == later[-1]:
                    ranges.append(_Range(name, start, at, first, member))
                    start, first = at, member
        return ranges or [_Range("", 0, 0, 0, 0)]

    def fetch(self, files: fs.FileSystem, path: str, handle, offset: int, size: int, crc: int):
        """The member at an offset and the handle to go on with. Each attempt after the first opens the archive anew."""
        for attempt in range(self.retries + 1):
            try:
                if handle is None:
                    handle = files.open_input_file(path)
                media = handle.read_at(size, offset + tarfile.BLOCKSIZE)
                if len(media) == size and zlib.crc32(media) == crc:
                    return media, handle
                problem: Exception = OSError(f"wrong checksum of the member at {offset} of {path}")
            except OSError as e:
                problem = e
            if handle is not None:
                handle.close()
            handle = None
            time.sleep(0.05 * 2**attempt)
        raise problem

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, root = _open(self.path)
        path, handle = f"{root}/{partition.archive}", None
        with files.open_input_file(f"{path}.index") as f:
            index = np.frombuffer(f.read_at((partition.last - partition.first) * _ENTRY.itemsize, partition.first * _ENTRY.itemsize), _ENTRY)
        rows, held = [], 0
        for e in index:
            media, handle = self.fetch(files, path, handle, int(e["offset"]), int(e["size"]), int(e["crc"]))
            rows.append((None if e["null"] else int(e["id"]), int(e["bytes"]), media))
            held += len(media)
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)
        if handle is not None:
            handle.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, sizes, media = zip(*rows, strict=True)
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            rows, held = [], 0
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                data = (text.as_py() or "").encode()
                rows.append((doc_id.as_py(), len(data), encode_png(payload_of(data))))
                held += len(rows[-1][2])
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, SCHEMA)


def features(samples: np.ndarray) -> str:
    """Size, mean, deviation and entropy of the samples."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    return f"{WIDTH}x{len(samples) // WIDTH};mean={samples.mean():.4f};std={samples.std():.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f}"


def describe(media: DataFrame) -> DataFrame:
    """The payloads read back: sizes, hashes and features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            rows = []
            for m in b.column(2):
                m = m.as_py()
                samples = decode_png(m)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), features(samples)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names[2:]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return media.mapInArrow(run, schema)


def write_archive(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    docs.sparkSession.dataSource.register(MediaArchive)
    to_media(docs, id_col, text_col).write.format("media_archive").option("path", path).mode("append").save()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("path", path).load()


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Staging(spark).path("media")
    write_archive(documents(spark, sf_dir), path)
    return describe(read_archive(spark, path))
