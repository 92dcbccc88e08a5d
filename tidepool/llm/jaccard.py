"""Jaccard self-join over word shingles, exact, in size-banded tiles with hashed bitmap signatures.

Documents with equal sets are one node, known by its set's hash; everything below is about nodes.

Candidate keys, of two kinds; neither loses a link.

* Segments (similarity of about 0.9 and more). Sizes are cut into bands; a pair belongs to the band of its larger set. In a
  band two linked sets differ in d elements at most, so each set is cut by hash range into m > d segments, of which m - d at
  least are equal in both. Each set emits one key per segment with at least ``RICH`` elements. Equal segments beyond one are
  surplus; a set leaves out half of the surplus that it is sure of. A set with so many poor segments that all the equal ones
  might be poor (rare) also emits the smallest hashes of its prefix. A segment holds a few elements spread over the whole
  document, so documents that merely share a passage hardly ever share one.
* Prefixes (below that, where segments would hold too few elements to tell documents apart). Elements have one order for all
  documents, rarest first; two linked sets share one of the first size - least overlap + 1. How common an element is, is
  counted over all documents as far as a task's slice of them repeats it, and the ``FREQUENT`` commonest are sent to all
  tasks. Only the order depends on these counts, so they decide about speed and not about links.

Checking. Nodes that share a key make a group.

1. Stars: each node of a group is paired with one leader of the group, so a group of any size gives as many pairs as nodes. Pairs
   whose bitmaps allow it are intersected exactly. What is linked is one part from then on. Groups of more than one tile that
   still hold several parts try a second leader.
2. Tiles: groups that still hold several parts are cut by size bands, and large ones into blocks, every two blocks a tile. A
   tile gets ids and bitmaps only: a bit of A that B lacks proves an element of A outside B, so bit counts bound the overlap
   from above. Nodes with a partner of another part within the bound are fetched with their texts and intersected exactly
   (sorted arrays), while they are not yet connected within the tile. So a tile returns a spanning forest, never all pairs.
   Groups with the same members are tiled once.

Tiles of a group are still quadratic in the number of its nodes if it falls into many parts; the key kinds above are there to
keep such groups small.

Edge cases: null texts and texts without words have the empty set and no links. Texts with fewer words than a shingle have the
whole sequence as their one shingle. A very long text is held whole by the task that reads it, with 8 bytes a word. Rows with
a null id count shingles but have no component (null). Rows with the same id are one document for links: what any of them
links with, all are. Other columns are not read. An empty table gives no rows. Sets are known by 64 bits of hash: of 10**10
different ones about three pairs would be taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import FEW, WORD, Staging, documents, meet, row_fields, small_batches, whole_row
from .components import connected_components
from .hashing import Words, mix

_U = np.uint64
BATCH_WORDS = 300_000
#: Elements that one slice of the counting pass holds.
SLICE_ELEMENTS = 3_000_000
#: Elements of a common order that go to all tasks, at most.
FREQUENT = 1 << 18
RICH = 2
TILE_SETS = 2000
TILE_ELEMENTS = 1_000_000
MAX_BITS = 1 << 16
_GROWTH = 1.5
_WEIGHTS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9E6C63D0676A9A99)


@dataclass(frozen=True)
class Join:
    """words per shingle and the least similarity, num / den."""

    n: int
    num: int
    den: int

    @property
    def segmented(self) -> bool:
        """Whether a segment of a set holds 8 elements or more in the mean, counted at the largest allowed difference."""
        return self.num + self.den >= 16 * (self.den - self.num)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text. ASCII capitals are lowered."""
        w = Words([t.lower() for t in texts])
        h = w.hashes()
        inside, out = w.inside(self.n), []
        rolled = np.zeros(len(h), _U)
        for i in range(self.n):
            rolled[: len(h) - i] += h[i:] * _U(_WEIGHTS[i])
        rolled = mix(rolled)
        for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
            if b - a >= self.n:
                out.append(np.unique(rolled[a:b][inside[a:b]]))
            elif b > a:  # the whole short sequence, told from full shingles by its length
                out.append(mix((h[a:b] * np.array(_WEIGHTS[: b - a], _U)).sum(keepdims=True, dtype=_U) + _U(b - a)))
            else:
                out.append(np.zeros(0, _U))
        return out

    def linked(self, overlap: int, s: int, t: int) -> bool:
        return self.den * overlap >= self.num * (s + t - overlap)

    def bands(self, s: int) -> list[int]:
        """Bands of the larger set of a pair that holds a set of this size."""
        first, last = band_of(s), band_of(s * self.den // self.num)
        return list(range(first, last + 1))

    def segments(self, band: int) -> int:
        d = self.differ(band)
        return d + 1 + 3 + -(-(d + 1) // 10)

    def differ(self, band: int) -> int:
        """Most elements in which two linked sets of the band differ."""
        return 2 * (band_end(band) - 1) * (self.den - self.num) // (self.den + self.num)

    def own(self, n: int) -> int:
        """Elements in which a set of n can differ from a partner of its size or more; if none, only equal sets link."""
        return n * (self.den - self.num) // self.num

    def prefix(self, n: int) -> int:
        """Two linked sets share one of so many first elements."""
        return n - -(-self.num * n // self.den) + 1

    def segment_keys(self, s: np.ndarray) -> np.ndarray:
        """All keys of a set by segments."""
        n, out = len(s), []
        if not self.own(n):
            return np.zeros(0, _U)
        sums = np.concatenate([[_U(0)], np.cumsum(mix(s ^ _U(0x5851F42D4C957F2D)), dtype=_U)])
        for band in self.bands(n):
            m = self.segments(band)
            edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(_U)
            at = np.concatenate([[0], np.searchsorted(s, edges), [n]])
            count = np.diff(at)
            key = mix(sums[at[1:]] - sums[at[:-1]] + mix(np.arange(m, dtype=_U) + (_U(band) << _U(32))))
            # equal rich segments beyond the first; if each of two sets leaves out half of its own surplus, one that they share stays
            surplus = m - min(self.own(n), self.differ(band)) - int((count < RICH).sum()) - 1
            out.append(key[count >= RICH][max(surplus, 0) // 2 :])
            if surplus < 0:
                out.append(mix(s[: self.prefix(n)] + mix(np.array([band + (1 << 40)], _U))))
        return np.concatenate(out)

    def prefix_keys(self, sets: list[np.ndarray], common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of many sets by prefixes, and the place of the set that each belongs to. common: sorted elements; counts: theirs."""
        size = np.array([len(s) for s in sets], np.int64)
        owner, flat = np.repeat(np.arange(len(sets)), size), np.concatenate([*sets, np.zeros(0, _U)])
        seen = np.zeros(len(flat), np.float32)
        if len(common) and len(flat):
            at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
            seen = np.where(common[at] == flat, counts[at], 0).astype(np.float32)
        order = np.lexsort((mix(flat), seen, owner))
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        length = np.array([self.prefix(n) if self.own(n) else 0 for n in size.tolist()], np.int64)
        taken = rank < np.repeat(length, size)
        return flat[order][taken], owner[taken]


def band_end(band: int) -> int:
    """First size beyond a band; bands grow by about a half each and start at size 1."""
    end = 2
    for _ in range(band):
        end = max(end + 1, int(end * _GROWTH))
    return end


def band_of(size: int) -> int:
    band, end = 0, 2
    while size >= end:
        band, end = band + 1, max(end + 1, int(end * _GROWTH))
    return band


def node_of(s: np.ndarray) -> int:
    """The hash by which a set is known (signed)."""
    return int(mix(np.array([mix(s).sum(dtype=_U) + _U(len(s))], _U)).view(np.int64)[0])


# --- bitmaps ---------------------------------------------------------------------------------------------------------------
def bitmap(s: np.ndarray) -> bytes:
    """Hashed elements as bits, 2 to 4 for each element up to ``MAX_BITS``."""
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(6, (2 * len(s) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(s & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def stacked(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of words, the wider ones folded to the narrowest."""
    narrow = min(map(len, maps)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, "<u8").reshape(-1, narrow), axis=0) for m in maps])


def within_bound(join: Join, size: np.ndarray, words: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Those of js whose bits allow a link with i."""
    own, theirs = words[i], words[js]
    bound = np.minimum(size[i] - np.bitwise_count(own & ~theirs).sum(1, dtype=np.int64), size[js] - np.bitwise_count(theirs & ~own).sum(1, dtype=np.int64))
    return js[join.den * bound >= join.num * (size[i] + size[js] - bound)]


@dataclass
class Tile:
    """Sets of one tile in the order of their sizes. Pairs of one part, pairs with a leader (tested before) and, between two
    blocks, pairs of one block don't count."""

    size: np.ndarray
    words: np.ndarray
    part: np.ndarray
    block: np.ndarray
    tested: np.ndarray
    crossing: bool

    def partners(self, join: Join, i: int) -> np.ndarray:
        """Later ones that may link with i and are not connected with it."""
        js = np.arange(i + 1, np.searchsorted(self.size, self.size[i] * join.den // join.num, "right"))
        js = js[(self.part[js] != self.part[i]) & ~(self.tested[js] | self.tested[i])]
        if self.crossing:
            js = js[self.block[js] != self.block[i]]
        return within_bound(join, self.size, self.words, i, js) if len(js) else js


def hopeful(join: Join, tile: Tile) -> np.ndarray:
    """Which sets of the tile have a partner within the bound."""
    out = np.zeros(len(tile.size), bool)
    for i in range(len(tile.size) - 1):
        js = tile.partners(join, i)
        out[js] = True
        out[i] |= len(js) > 0
    return out


def forest(join: Join, tile: Tile, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the exact links between parts, as places of sets; joins the parts."""
    out = []
    for i in range(len(sets) - 1):
        for j in tile.partners(join, i):
            if tile.part[i] != tile.part[j] and join.linked(len(np.intersect1d(sets[i], sets[j], True)), len(sets[i]), len(sets[j])):
                tile.part[tile.part == tile.part[j]] = tile.part[i]
                out.append((i, int(j)))
    return out


# --- the passes over the texts ---------------------------------------------------------------------------------------------
def _slices(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids (with the text's mark) and texts in slices of about so many words."""
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(zip(*(c.to_pylist() for c in (b.column(0), b.column(2))), strict=True), b.column(1), strict=True):
            ids.append(i)
            texts.append((t.as_py() or "").encode())
            held += len(texts[-1])
            if held >= 6 * words:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _common(staging: Staging, narrow: DataFrame, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """The commonest elements, sorted, and how often a slice of documents repeats them (``FREQUENT`` at most)."""

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(held)
        h.sort()
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.append(first, len(h)))
        return pa.record_batch([pa.array(h[first[n > 1]].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, texts in _slices(batches, BATCH_WORDS):
            held.append(np.concatenate(join.sets(texts)))
            size += len(held[-1])
            if size >= SLICE_ELEMENTS:
                yield repeated(held)
                held, size = [], 0
        if held:
            yield repeated(held)

    times = staging.put(narrow.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "common")
    by_power = {r["p"]: r["c"] for r in times.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()}  # 64 rows at most
    least, held = 64, 0
    while least > 1 and held + by_power.get(least - 1, 0) <= FREQUENT:
        least -= 1
        held += by_power.get(least, 0)
    found = times.where(F.floor(F.log2("n")) >= least).toArrow()
    staging.drop(times)
    h, n = found.column("h").to_numpy().view(_U), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order].astype(np.float32)


def _pass_one(join: Join, common, id_type: pa.DataType):
    """Rows of kind 0: a document with its node and size (bitmap: at the node's first in the slice); 1: a key of a node, with its size."""
    record = partial(_record, id_type)

    def flush(ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        sets = join.sets(texts)
        node = np.array([node_of(s) for s in sets], np.int64)
        n = np.array([len(s) for s in sets], np.int64)
        live = np.array([i for i, (d, _) in enumerate(ids) if d is not None and n[i]], np.int64)
        first = live[np.unique(node[live], return_index=True)[1]]
        first.sort()
        chosen = set(first.tolist())
        maps = [bitmap(s) if i in chosen else None for i, s in enumerate(sets)]
        yield record(0, None, [int(x) if k else None for x, k in zip(node, n, strict=True)], *zip(*ids, strict=True), n, maps)
        mine = [sets[i] for i in first]
        if join.segmented:
            each = [join.segment_keys(s) for s in mine]
            key, owner = np.concatenate([*each, np.zeros(0, _U)]), np.repeat(np.arange(len(mine)), [len(e) for e in each])
        else:
            key, owner = join.prefix_keys(mine, *common.value)
        if len(key):
            yield record(1, key.view(np.int64), node[first][owner], None, None, n[first][owner], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _slices(batches, BATCH_WORDS):
            yield from flush(ids, texts)

    return run


def _record(id_type: pa.DataType, kind: int, key, node, doc, mark, n, bits) -> pa.RecordBatch:
    size = len(node)
    types = {"key": pa.int64(), "node": pa.int64(), "doc": id_type, "mark": pa.int64(), "n": pa.int64(), "bits": pa.binary()}
    columns = [pa.nulls(size, t) if x is None else pa.array(x, t) for x, t in zip((key, node, doc, mark, n, bits), types.values(), strict=True)]
    return pa.record_batch([pa.array(np.full(size, kind, np.int32)), *columns], names=["kind", *types])


# --- checking --------------------------------------------------------------------------------------------------------------
class _Check:
    """Exact checks of pairs of nodes. nodes: node, n, bits, doc and mark (of a text with that set); texts: doc, text, mark;
    repeated: whether several rows have one id and text."""

    def __init__(self, staging: Staging, join: Join, nodes: DataFrame, texts: DataFrame, repeated: bool):
        self.staging, self.join, self.nodes, self.texts, self.repeated = staging, join, nodes, texts, repeated

    def with_texts(self, members: DataFrame, by: list[str], rows: int) -> DataFrame:
        """members (staged, with the columns ``by`` and node) and a text of each node. A text is known by id and mark, so a repeated
        id brings no others. Few members go to the texts where these are read; of many, the texts wanted are shuffled once."""
        source = self.nodes.select("node", "doc", "mark")
        if rows <= FEW:
            placed = self.staging.put(source.join(F.broadcast(members), "node"), "placed", rows)
            found = self.texts.join(F.broadcast(placed), ["doc", "mark"])
            return found.dropDuplicates([*by, "node"]) if self.repeated else found
        placed = members.join(source.hint("merge"), "node")
        wanted = self.staging.put(placed.select("doc", "mark").distinct(), "wanted", rows)
        found = meet(self.texts, wanted, ["doc", "mark"], "left_semi")
        return placed.join(found.dropDuplicates(["doc", "mark"]).hint("merge"), ["doc", "mark"])

    def star(self, pairs: DataFrame, rows: int) -> DataFrame:
        """pairs: u, v (v: the leader), n_u, n_v; rows of them at most. Those that link, as a staged table."""
        join = self.join

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                a, x, na, nx = b.column("bits_u").to_pylist(), b.column("bits_v").to_pylist(), b.column("n_u").to_pylist(), b.column("n_v").to_pylist()
                ok = [len(within_bound(join, np.array([s, t]), stacked([p, q]), 0, np.array([1]))) > 0 for p, q, s, t in zip(a, x, na, nx, strict=True)]
                yield b.select(["u", "v", "n_u"]).filter(pa.array(ok, pa.bool_()))

        alike = F.col("n_u") * join.num <= F.col("n_v") * join.den
        pairs = self.staging.put(pairs.where(alike & (F.col("n_v") * join.num <= F.col("n_u") * join.den)).distinct(), "pairs", rows)
        rows = pairs.count()
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}"))
        own = side("u").join(F.broadcast(pairs), "u") if rows <= FEW else pairs.join(side("u").hint("merge"), "u")
        near = self.staging.put(own.join(side("v").hint("merge"), "v").mapInArrow(bound, "u long, v long, n_u long"), "near", 10 * rows)
        left = near.count()
        blocks = self.staging.put(near.groupBy("v").agg(_blocks(F.count("*"), F.sum("n_u")).alias("blocks")), "blocks", left)
        placed = meet(near, blocks, "v").select(F.col("v").alias("cell"), F.pmod(F.xxhash64("u"), "blocks").alias("block"), F.col("u").alias("node"))
        members = self.staging.put(placed.union(placed.select("cell", "block", F.col("cell").alias("node")).distinct()), "members", 2 * left)

        def exact(t: pa.Table) -> pa.Table:
            sets = _sets_of(join, t)
            lead = t.column("cell")[0].as_py()
            own = sets.pop(lead)
            hits = [u for u, s in sets.items() if join.linked(len(np.intersect1d(own, s, True)), len(own), len(s))]
            return pa.table([pa.array(hits, pa.int64()), pa.array([lead] * len(hits), pa.int64())], names=["u", "v"])

        links = self.staging.put(self.with_texts(members, ["cell", "block"], 2 * left).groupBy("cell", "block").applyInArrow(exact, "u long, v long"), "links", 40 * left)
        self.staging.drop(pairs, near, blocks, members)
        return links

    def tiles(self, members: DataFrame) -> DataFrame:
        """members: key, node, n, part, tested. Links between parts of a key's group, a spanning forest of each tile."""
        join, staging = self.join, self.staging
        bands = F.sequence(_band(F.col("n")), _band(F.expr(f"(n * {join.den}) div {join.num}")))
        banded = staging.put(members.withColumn("band", F.explode(bands)), "banded")
        rows = banded.count()
        cells = banded.groupBy("key", "band").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"), F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").drop("a", "b")
        cells = staging.put(cells, "cells", rows)
        placed = meet(banded, cells, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        tiled = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "band", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node", "part", "tested", "n")
        tiled = staging.put(tiled, "tiled")
        rows = tiled.count()
        schema = "key long, band int, lo int, hi int, block int, node long, part long, tested boolean"
        names = [c.split()[0] for c in schema.split(", ")]

        def select(t: pa.Table) -> pa.Table:
            t = t.take(pa.array(np.argsort(t.column("n").to_numpy(), kind="stable")))
            return t.select(names).filter(pa.array(hopeful(join, _tile(t, stacked(t.column("bits").to_pylist())))))

        bits = self.nodes.select("node", "bits")
        whole = bits.join(F.broadcast(tiled), "node") if rows <= FEW else tiled.join(bits.hint("merge"), "node")
        chosen = staging.put(whole.groupBy("key", "band", "lo", "hi").applyInArrow(select, schema), "hopeful", 10 * rows)
        left = chosen.count()

        def exact(t: pa.Table) -> pa.Table:
            sets = _sets_of(join, t)
            place = {x: i for i, x in enumerate(t.column("node").to_pylist())}
            nodes = sorted(sets, key=lambda x: len(sets[x]))
            t = t.take(pa.array([place[x] for x in nodes], pa.int64()))
            own = [sets[x] for x in nodes]
            t = t.append_column("n", pa.array([len(s) for s in own], pa.int64()))
            pairs = forest(join, _tile(t, stacked([bitmap(s) for s in own])), own) if own else []
            return pa.table([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], names=["u", "v"])

        by = ["key", "band", "lo", "hi"]
        links = staging.put(self.with_texts(chosen, by, left).groupBy(*by).applyInArrow(exact, "u long, v long"), "links", 10 * left)
        staging.drop(banded, cells, tiled, chosen)
        return links


def _blocks(sets: Column, elements: Column) -> Column:
    return F.greatest(F.ceil(sets / TILE_SETS), F.ceil(elements / TILE_ELEMENTS)).cast("int")


def _sets_of(join: Join, t: pa.Table) -> dict[int, np.ndarray]:
    """Node -> set."""
    return dict(zip(t.column("node").to_pylist(), join.sets([x.encode() for x in t.column("text").to_pylist()]), strict=True))


def _tile(t: pa.Table, words: np.ndarray) -> Tile:
    return Tile(t.column("n").to_numpy(), words, np.unique(t.column("part").to_numpy(), return_inverse=True)[1], t.column("block").to_numpy(), t.column("tested").to_numpy(zero_copy_only=False), t.column("lo")[0].as_py() != t.column("hi")[0].as_py())


def _with_parts(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """groups (key, node, n) with part: the component so far, or the node itself."""
    return meet(groups, parts, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("part"))


def _open_groups(staging: Staging, divided: DataFrame, rows: int) -> DataFrame:
    """key, c (nodes), lead, second (the leaders) of groups that hold several parts beyond a pair; of those with the same nodes one."""
    seen = divided.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"), F.min("node").alias("lead"), F.min(F.struct(F.xxhash64("node", F.lit(1)).alias("h"), "node"))["node"].alias("second"))
    once = seen.where("a <> b AND c > 2").groupBy("c", "x", "y", "lead", "second").agg(F.min("key").alias("key"))
    return staging.put(once.select("key", "c", "lead", "second"), "open", rows)


def similar_components(docs: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles (size of the set) and component_id (smallest id reachable by links, itself included) of every row."""
    spark = docs.sparkSession
    staging = Staging(spark)
    narrow = small_batches(docs).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    common = None if join.segmented else spark.sparkContext.broadcast(_common(staging, narrow, join))
    kind = docs.select(id_col).schema[0].dataType
    schema = StructType.fromDDL("kind int, key long, node long").add("doc", kind).add("mark", "long").add("n", "long").add("bits", "binary")
    rows = staging.put(narrow.mapInArrow(_pass_one(join, common, to_arrow_type(kind)), schema), "keys")
    if common:
        common.unpersist()

    sets = staging.put(rows.where("kind = 0").select("doc", "node", "n"), "sets")
    size = sets.count()
    nodes = staging.put(rows.where("kind = 0 AND bits IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min(F.struct("doc", "mark")).alias("from")).select("node", "n", "bits", "from.doc", "from.mark"), "nodes", 10 * size)
    keys = rows.where("kind = 1").select("key", "node", "n")
    every = keys.count()
    repeated = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    groups = staging.put(keys.join(repeated.hint("merge"), "key").distinct(), "groups", every)
    many = groups.count()
    leads = groups.groupBy("key").agg(F.min(F.struct("node", "n")).alias("v"), F.max("node").alias("b")).where("v.node <> b")
    leads = staging.put(leads.select("key", F.col("v.node").alias("v"), F.col("v.n").alias("n_v")), "leads", many)
    staging.drop(rows)  # most keys stand alone and are not needed any more

    # rows of one id are one document
    known = sets.where("doc IS NOT NULL AND node IS NOT NULL")
    several = staging.put(known.groupBy("doc").agg(F.min("node").alias("v"), F.max("node").alias("b"), F.count("*").alias("c")).where("c > 1"), "several", size)
    check = _Check(staging, join, nodes, narrow.where("doc IS NOT NULL AND text IS NOT NULL"), not several.isEmpty())
    links = staging.put(meet(known, several.where("v <> b").select("doc", "v"), "doc").where("node <> v").select(F.col("node").alias("u"), "v").distinct(), "same", size)

    star = check.star(meet(groups, leads, "key").where("node <> v").select(F.col("node").alias("u"), "v", F.col("n").alias("n_u"), "n_v"), many)
    links = links.union(star)
    parts = connected_components(staging, links)
    divided = _with_parts(groups, parts)
    still = _open_groups(staging, divided, many)
    left = staging.put(meet(divided, still, "key").withColumn("tested", F.col("node") == F.col("lead")), "left", many)
    most = still.agg(F.max("c")).first()[0] or 0
    if most > TILE_SETS:
        seconds = left.groupBy("key").agg(F.min(F.when(F.col("node") == F.col("second"), F.struct("part", "n"))).alias("own"))
        seconds = staging.put(seconds.select("key", F.col("own.part").alias("own"), F.col("own.n").alias("n_v")), "seconds", many)
        star = check.star(meet(left, seconds, "key").where("part <> own").select(F.col("node").alias("u"), F.col("second").alias("v"), F.col("n").alias("n_u"), "n_v"), many)
        links = links.union(star)
        parts = connected_components(staging, links)
        divided = _with_parts(left.select("key", "node", "n"), parts)
        still = _open_groups(staging, divided, many)
        left = staging.put(meet(divided, still, "key").withColumn("tested", F.col("node").isin(F.col("lead"), F.col("second"))), "left", many)
    if not left.isEmpty():
        found = check.tiles(left.select("key", "node", "n", "part", "tested"))
        if not found.isEmpty():
            parts = connected_components(staging, links.union(found))

    labelled = meet(known.select("doc", "node"), parts, "node", "left").select("doc", F.coalesce("component", "node").alias("label"))
    labelled = staging.put(labelled.distinct(), "labelled", size)
    staging.drop_all_but(sets, labelled)
    smallest = staging.put(labelled.groupBy("label").agg(F.min("doc").alias("component"), F.count("*").alias("c")).where("c > 1").drop("c"), "smallest", size)
    by_doc = staging.put(meet(labelled, smallest, "label").groupBy("doc").agg(F.min("component").alias("component")), "by_doc", size)
    out = meet(sets, by_doc, "doc", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _band(size: Column) -> Column:
    """band_of in SQL: the place of a size among the bands' ends."""
    return F.size(F.filter(F.array(*(F.lit(band_end(b)) for b in range(60))), lambda e: e <= size))


CONTRACT = Join(3, 90, 100)
NEAR = Join(5, 8, 10)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir), CONTRACT)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row, that of the smallest id, of each group of near copies (5-word shingles, similarity 0.8).

    Each row is a document of its own, known by 128 bits of hash of its id, text and source: rows equal in these are copies (the
    one whose other columns come first as JSON stays), rows with one id are linked by their texts only, and null ids take part
    and come after all others. Of rows with one id the smallest hash stays. Rows without words have no copies and all stay.
    Columns of any name and type stay as they are. A table without the column source does without it.
    """
    staging = Staging(spark)
    parts = [F.col(c) for c in ("doc_id", "text", "source") if c in docs.columns]
    row = F.concat_ws(":", F.xxhash64(*parts), F.xxhash64(F.lit(1), *reversed(parts)))
    found = similar_components(docs.select(row.alias("row"), "text"), NEAR, "row")
    found = staging.put(found.groupBy("row").agg(F.min("component_id").alias("component"), F.max("n_shingles").alias("n"), F.count("*").alias("times")).where("n > 0"), "found", docs.count())
    size = found.count()
    copies = staging.put(found.groupBy("component").agg(F.count("*").alias("rows"), F.sum("times").alias("times")).where("times > 1").select("component"), "copies", size)
    among = staging.put(meet(found, copies, "component"), "among", size)
    member = staging.put(meet(docs.select(row.alias("row"), "doc_id"), among, "row").groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.first("component").alias("component"), F.first("times").alias("times")), "member", size)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best")
    first = staging.put(member.groupBy("component").agg(best).select("component", F.col("best.row").alias("first")), "first", size)
    # rows that go, and rows that stay once of several equal ones
    judged = meet(member, first, "component").select("row", (F.col("row") == F.col("first")).alias("stays"), "times").where("NOT stays OR times > 1")
    marked = staging.put(judged.select("row", "stays"), "marked", size)
    staging.drop_all_but(marked)
    whole = docs.select(row.alias("row"), whole_row(docs).alias("all"))
    kept = meet(whole, marked, "row", "left_anti").select(*row_fields(docs, "all"))
    again = marked.where("stays").select("row")
    if again.isEmpty():
        return kept
    once = meet(whole, again, "row", "left_semi").groupBy("row").agg(F.min_by("all", F.to_json("all")).alias("all"))
    return kept.union(once.select(*row_fields(docs, "all")))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON r.d = e.a),
k AS (SELECT d, min(m) AS component_id FROM r GROUP BY d)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN k ON documents.doc_id = k.d
"""
