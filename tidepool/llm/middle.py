"""Fill-in-the-middle transformation by overlapping chunks.

A text is cut into units (white space and the word behind it). A unit ends after a character that is not white space and is
followed by white space, and at the text's end; so a unit's end shows in two adjacent characters, wherever a text is cut.
White space is ASCII, so adjacent UTF-8 bytes tell the same as adjacent characters.

1. Every text of a batch is cut into chunks of ``CHUNK`` bytes that overlap the next by one byte. The ends in all chunks are
   counted at once, each chunk on its own.
2. Prefix sums of the counts tell the number of units of each text and the chunk that owns each cut's rank.
3. Only the owning chunks are read again, for the place of the cut.

Chunks stay in the task that reads their text: its output has to hold the whole text in any case, and a chunk is counted
faster than it is sent. So nothing is shuffled, and tasks are as large as the scan's splits.

Edge cases: null texts are empty texts, with no units and the form ``plain``. Texts of white space alone are one unit. Texts
that hold a mark stay plain, so that every output can be undone. A very long text is held by its task with its output, and
its bits of ends in groups of ``GROUP`` bytes. Repeated rows give repeated results; ties between the cuts give an empty middle.
A null id draws by the word ``null``. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_slices, small_batches

#: Marks of prefix, suffix and middle (fixed values).
P, S, M = "<P>", "<S>", "<M>"
CHUNK = 1 << 16
#: Bytes whose ends are counted at once.
GROUP = 1 << 22
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def unit_ends(data: np.ndarray, a: int, b: int, end: int) -> np.ndarray:
    """Which bytes of data[a:b] end a unit within a text that ends at ``end`` (its last byte doesn't count). Reads one byte more."""
    white = _SPACE[data[a : min(b + 1, end)]]
    out = np.zeros(b - a, bool)
    out[: len(white) - 1] = ~white[:-1] & white[1:]
    return out


class Chunks:
    """The chunks of the texts of a batch. data: their bytes, one text behind the other; bounds: where each begins, and the end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, chunk: int = CHUNK):
        self.data, self.bounds = data, bounds
        length = np.diff(bounds)
        per = -(-length // chunk)
        self.first = np.concatenate([[0], np.cumsum(per)])  # each text's first chunk
        text = np.repeat(np.arange(len(length)), per)
        self.start = bounds[text] + (np.arange(len(text)) - self.first[text]) * chunk
        self.end = np.minimum(self.start + chunk, bounds[text + 1])
        self.upto = np.concatenate([[0], np.cumsum(self._counts())])
        self.units = self.upto[self.first[1:]] - self.upto[self.first[:-1]] + (length > 0)

    def _counts(self) -> np.ndarray:
        """Ends per chunk, in groups of chunks that lie side by side."""
        out, i, lasts = np.zeros(len(self.start), np.int64), 0, self.bounds[1:] - 1
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + GROUP, "right")))
            a, b = int(self.start[i]), int(self.end[j - 1])
            ends = unit_ends(self.data, a, b, len(self.data))
            ends[lasts[np.searchsorted(lasts, a) : np.searchsorted(lasts, b)] - a] = False  # the next byte is another text's
            out[i:j] = np.add.reduceat(ends, self.start[i:j] - a, dtype=np.int64)
            i = j
        return out

    def cut(self, text: int, rank: int) -> int:
        """Where the unit of that rank (from 1; 0: the beginning) of a text ends, in bytes of data."""
        if rank in (0, self.units[text]):
            return int(self.bounds[text + (rank > 0)])
        wanted = self.upto[self.first[text]] + rank
        owner = int(np.searchsorted(self.upto, wanted)) - 1
        a, b = int(self.start[owner]), int(self.end[owner])
        ends = np.flatnonzero(unit_ends(self.data, a, b, int(self.bounds[text + 1])))
        return a + int(ends[wanted - self.upto[owner] - 1]) + 1


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and the id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row."""
    schema = docs.select(id_col).schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [m.encode() for m in (P, S, M)]
        for b in in_slices(batches):
            data, bounds = _bytes_of(b.column(1))
            chunks = Chunks(data, bounds, chunk)
            marked = [pc.fill_null(pc.match_substring(b.column(1), m), False).to_numpy(zero_copy_only=False) for m in (P, S, M)]
            h1, h2, h3, h4 = (b.column(i).to_numpy() for i in range(2, 6))
            plain = np.logical_or.reduce(marked) | (chunks.units == 0) | (h3 % 100 >= fim_percent)
            spm = h4 % 100 < spm_percent
            forms, prefixes, middles, outputs = [], [], [], []
            for i, n in enumerate(chunks.units.tolist()):
                a, z = int(bounds[i]), int(bounds[i + 1])
                if plain[i]:
                    row = ("plain", None, None, data[a:z].tobytes())
                else:
                    x, y = sorted((int(h1[i]) % (n + 1), int(h2[i]) % (n + 1)))
                    c, d = chunks.cut(i, x), chunks.cut(i, y)
                    prefix, middle, suffix = data[a:c].tobytes(), data[c:d].tobytes(), data[d:z].tobytes()
                    order = (marks[1], suffix, marks[0], prefix, marks[2], middle) if spm[i] else (marks[0], prefix, marks[1], suffix, marks[2], middle)
                    row = ("spm" if spm[i] else "psm", _chars(data[a:c]), _chars(data[c:d]), b"".join(order))
                for column, value in zip((forms, prefixes, middles, outputs), row, strict=True):
                    column.append(value)
            yield pa.record_batch([b.column(0), pa.array(chunks.units, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())], names=schema.names)

    return small_batches(docs).select(id_col, text_col, *_draws(id_col, seed)).mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The exact text that an output of that form was made of. No text with a mark was moved, so each mark is found once."""
    between = lambda left, right: F.substring_index(F.substring_index(output, right, 1), left, -1)
    middle = F.substring_index(output, M, -1)
    return F.when(form == "psm", F.concat(between(P, S), middle, between(S, M))).when(form == "spm", F.concat(between(P, M), middle, between(S, P))).otherwise(output)


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_SHARES = ", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
r AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, {_SHARES} FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '{P}') OR contains(t, '{S}') OR contains(t, '{M}') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y FROM r),
p AS (SELECT *, array_to_string(u[:x], '') AS prefix, array_to_string(u[x + 1:y], '') AS middle, array_to_string(u[y + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{P}' || prefix || '{S}' || suffix || '{M}' || middle ELSE '{S}' || suffix || '{P}' || prefix || '{M}' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
