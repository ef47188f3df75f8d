"""Exact join of documents by the Jaccard similarity of their word shingles, as a metric-space join.

The Jaccard distance is a metric, and two documents link when it is at most 1 - threshold. Pivots, the regions they create
and the windows that replicate documents across borders do the joining, on three levels, each inside the regions of the
one before; every level is exact, so no link is lost.

* Level 0. Documents as pivots can't cut a corpus: nearly all documents are at distance 1 from nearly all others, and a
  window around 1 holds everything. So the first pivots are projections. The universe of shingles is dealt by hash into
  groups of three classes; the pivot regions of a group are the distinct contents of two of its classes. Two sets that
  link differ in at most k elements, so by pigeonhole there are groups in which they differ in one at most, and there they
  share a region. The set sizes that can link define bands (k depends on size); a document near a band's upper border is
  replicated to the next one. Regions whose content is too small to tell are skipped where pigeonhole still leaves one.
* Level 1. Regions that share documents form a cell. In a large cell, a document with so many shingles of its own that it
  is farther than the threshold from everything else leaves. A cell that is still large is joined again with other pivots: single
  shingles, ordered with those that are common in a sample of the cell last. A document is replicated to the regions of
  the first shingles that a set within the threshold must hit (the window).
* Level 2. Inside a cell the pivots are documents, the most central first, and distances are computed exactly. Each
  document belongs to the region of its nearest pivot and is replicated to every region whose pivot is at most
  2 * (1 - threshold) farther (triangle inequality); regions join recursively without their pivots until a region lies in
  one component. Cells that stay large do the same over the cluster: all documents of a cell are held against broadcast
  pivots (their bytes are bounded), and its regions and windows are the cells of the next turn (``_large_cells``).

Equal sets are one node from the start (copies are never paired). Region members travel as packed arrays, and a region
yields a star of candidate edges, never all pairs. Components are found by ``components``.

Words are runs of anything but ASCII white space, A-Z lower-cased. With fewer words than a shingle takes, the whole
sequence is one shingle; without words, or with null text, the set is empty and links with nothing. Shingles are compared
by 64-bit hashes and sets by 128-bit digests. component_id is the smallest doc_id of a component; null ids come last and
a component without ids has a null one. Rows that repeat a doc_id are documents of their own that share that id. Very long texts are shingled whole; their sets travel as one value. An empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.llm.components import components
from stratapoint.llm.rows import tag
from stratapoint.llm.text import LOWER, by_bytes, claim, mix64, ngram_hashes, word_hashes
from stratapoint.runtime import Scratch, ship

#: A cell of at most so many documents and shingles is joined within a task.
CELL_DOCS, CELL_SHINGLES = 256, 1 << 21
#: Pivots of a turn, of a cell, how many of them make regions, and the bytes of a broadcast block of pivots.
PIVOTS, CENTRES, BLOCK_BYTES = 512, 16, 32 << 20
#: Bytes of texts that are cut into shingles together, and regions that travel together.
BATCH_BYTES, BATCH_NAMES = 2 << 20, 1 << 18
#: Bytes that a region's name keeps besides its bucket. Names that are taken for each other only add candidates, which are compared exactly.
NAME_BYTES = 5
#: Names of a bucket are looked at in so many turns at most, of about so many names.
TURNS, TURN_NAMES = 8, 1 << 18
#: Who leaves large cells is broadcast as bitmaps of 32,768 documents (4 KiB) up to this number, else joined by a shuffle of the sets.
BITMAPS = 4096
#: The first count of private shingles looks at one in so many, the second at all that are left.
PARTS = 2
#: Documents sampled from a large cell to see which shingles are common in it.
SAMPLE = 64
#: Candidate documents up to this number are matched with their texts by a broadcast of their ids, else by a shuffle.
BROADCAST_ROWS = 200_000


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    w = word_hashes((text or b"").translate(LOWER).split())
    return np.unique(ngram_hashes(w, min(n, len(w))) if len(w) else w)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
    return int(d[0]), int(d[1])


@dataclass(frozen=True)
class Rule:
    """Sets link when den * intersection >= num * union; 2 * num > den."""

    num: int
    den: int

    @property
    def epsilon(self) -> float:
        return 1 - self.num / self.den

    def links(self, inter: np.ndarray, a, b) -> np.ndarray:
        return self.den * inter >= self.num * (a + b - inter)

    @cached_property
    def bands(self) -> np.ndarray:
        """The least size of each band."""
        out, ratio = [1], max(1.25, self.den / self.num * 1.2)
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(out[-1] * ratio)))
        return np.array(out)

    def differing(self, most: int) -> int:
        """The most elements in which two sets of at most this size can differ and link."""
        return (self.den - self.num) * 2 * most // (self.den + self.num)

    def regions(self, s: np.ndarray) -> np.ndarray:
        """The level 0 regions of a set, as 64-bit names."""
        size, out = len(s), []
        if not size:
            return s
        first = int(np.searchsorted(self.bands, size, side="right")) - 1
        last = int(np.searchsorted(self.bands, size * self.den // self.num, side="right")) - 1
        for band in range(first, last + 1):
            k = self.differing(int(self.bands[band + 1]) - 1)
            if not k:
                continue  # only equal sets link, and these are one node
            spare = 1 + k // 24
            groups = k // 2 + spare
            small = 1 if int(self.bands[band]) * 2 / 3 / groups > 8 else 0
            cls = (s % np.uint64(3 * groups)).astype(np.int64)
            n = np.bincount(cls, minlength=3 * groups)
            order = np.argsort(cls, kind="stable")
            sums = np.zeros(3 * groups, np.uint64)
            full = np.flatnonzero(n)
            sums[full] = np.add.reduceat(mix64(s)[order], (np.cumsum(n) - n)[full])
            n, sums = n.reshape(-1, 3), sums.reshape(-1, 3)
            pairs = np.stack([n[:, 0] + n[:, 1], n[:, 0] + n[:, 2], n[:, 1] + n[:, 2]], 1)
            names = np.stack([mix64(sums[:, i] * np.uint64(3) + mix64(sums[:, j] + np.uint64(i + 3 * j))) for i, j in ((0, 1), (0, 2), (1, 2))], 1)
            names = mix64(names + (np.arange(groups, dtype=np.uint64) * np.uint64(4) + np.uint64(band << 32))[:, None] + np.arange(3, dtype=np.uint64))
            weak = pairs <= small
            out.append(names[~weak] if weak.any(1).sum() < spare else names.ravel())
        return np.concatenate(out) if out else s[:0]

    def prefix(self, size: int) -> int:
        """Of any order, the first so many elements meet those of every set that links."""
        return size - -(-self.num * size // self.den) + 1


def _identity(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for b, texts in by_bytes(batches, 1, BATCH_BYTES):
            sets = [shingles(t, n) for t in texts]
            d = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64()), pa.array([tag(t) for t in texts], pa.binary())], ["doc_id", "d1", "d2", "n", "tag"])

    return run


def _packed(names: np.ndarray, nodes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Region names and their members, packed by bucket of the name. A name costs NAME_BYTES and a bit (whether a member begins
    there), and a member of a bucket as many bytes as the range of members takes: many buckets leave it about one name in each."""
    bucket = (names % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((nodes, bucket))
    bucket, nodes = bucket[order], nodes[order]
    low = _narrow(names[order] // np.uint64(buckets), NAME_BYTES)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    rows = []
    for a, z in zip(at, [*at[1:], len(bucket)][: len(at)], strict=True):
        new = np.r_[True, nodes[a + 1 : z] != nodes[a : z - 1]]
        own = nodes[a:z][new].view(np.uint64)
        above = own - own[0]
        width = max(1, (int(above[-1]).bit_length() + 7) // 8)
        rows.append(np.uint32(z - a).tobytes() + bytes([width]) + own[:1].tobytes() + np.packbits(new).tobytes() + _narrow(above, width).tobytes() + low[a:z].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(rows, pa.binary())], ["bucket", "packed"])


def _narrow(x: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of each number."""
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _wide(row: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(row, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8").ravel()


def _unpacked(row: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = int(np.frombuffer(row, "<u4", 1)[0]), row[4]
    least, at = np.frombuffer(row, "<u8", 1, 5), 13 + (n + 7) // 8
    new = np.unpackbits(np.frombuffer(row, np.uint8, at - 13, 13), count=n)
    many = int(new.sum())
    own = (least + _wide(row, at, many, width)).view(np.int64)
    return _wide(row, at + many * width, n, NAME_BYTES), own[np.cumsum(new, dtype=np.int64) - 1]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The region names of a bucket with all their members, in turns; its rows stay packed meanwhile."""
    at, rows = None, []
    for b in batches:
        for bucket, row in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if bucket != at and rows:
                yield from _turns(rows)
                rows = []
            at = bucket
            rows.append(row.as_buffer().to_pybytes())
    if rows:
        yield from _turns(rows)


def _turns(rows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    turns = min(TURNS, 1 + sum(int(np.frombuffer(r, "<u4", 1)[0]) for r in rows) // TURN_NAMES)
    for k in range(turns):
        names, nodes = [], []
        for r in rows:
            x, own = _unpacked(r)
            mine = x % np.uint64(turns) == k
            names.append(x[mine])
            nodes.append(own[mine])
        if any(map(len, names)):
            yield np.concatenate(names), np.concatenate(nodes)


class _Sums:
    """Counts by one or two keys, added up whenever many have come together."""

    LIMIT = 1 << 18

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, *columns: np.ndarray) -> None:
        """The last column counts."""
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held > 2 * self.LIMIT:
            self.parts = [self.total()]
            self.held = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, ...]:
        *keys, n = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort(keys[::-1])
        keys, n = [k[order] for k in keys], n[order]
        at = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(n) else np.zeros(0, np.int64)
        return *(k[at] for k in keys), np.add.reduceat(n, at) if len(at) else n

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from pa.table([pa.array(c) for c in self.total()], names).to_batches(100_000)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's regions: (member, least member, other members of the region), summed by pair."""
    claim("jaccard")
    sums = _Sums()
    for name, node in _buckets(batches):
        order = np.lexsort((node, name))
        name, node = name[order], node[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (node[1:] != node[:-1])]  # a node brings a region once
        name, node = name[new], node[new]
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        size = np.diff(np.r_[first, len(name)])
        others = np.repeat(size - 1, size)
        shared = others > 0
        sums.add(node[shared], np.repeat(node[first], size)[shared], others[shared])
        if sums.held > _Sums.LIMIT and len(sums.parts) == 1:  # more pairs than a task should hold
            yield from sums.batches(["a", "b", "w"])
            sums = _Sums()
    yield from sums.batches(["a", "b", "w"])


def _edges(scratch: Scratch, packed: DataFrame, buckets: int, name: str) -> DataFrame:
    stars = packed.repartitionById(buckets, "bucket").mapInArrow(_stars, "a long, b long, w long")
    return scratch.table(stars.groupBy("a", "b").agg(F.sum("w").alias("w")), name)


def _cells(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """node, cell, pop: how many neighbours a node has, over all its regions."""
    pop = edges.groupBy("a").agg(F.sum("w").alias("pop")).withColumnRenamed("a", "node")
    return scratch.table(components(scratch, edges.select("a", "b"), f"{name}-cc").withColumnRenamed("root", "cell").join(pop, "node"), name)


class Cell:
    """Sets of one cell, and which of them are connected."""

    def __init__(self, sets: list[np.ndarray], rule: Rule):
        self.rule, self.n = rule, np.array([len(s) for s in sets])
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.cumsum(self.n) - self.n
        self.mark = np.zeros(self.ids.max() + 1, np.int64)
        self.label = np.arange(len(sets))

    def meet(self, pivot: int) -> np.ndarray:
        """Distances from a pivot to all; what links is connected."""
        own = self.ids[self.starts[pivot] : self.starts[pivot] + self.n[pivot]]
        self.mark[own] = 1
        inter = np.add.reduceat(self.mark[self.ids], self.starts)
        self.mark[own] = 0
        for other in set(self.label[self.rule.links(inter, self.n[pivot], self.n)].tolist()):
            self.label[self.label == other] = self.label[pivot]
        return 1 - inter / (self.n[pivot] + self.n - inter)

    def join(self, order: np.ndarray) -> None:
        """order: all members, the most central first."""
        todo, wide = [order], 2 * self.rule.epsilon + 1e-9
        while todo:
            own = todo.pop()
            if len(own) < 2 or len(set(self.label[own].tolist())) == 1:
                continue
            d = np.stack([self.meet(p) for p in own[:2]])[:, own[2:]]
            rest = own[2:]
            regions = [rest[x] for x in d <= d.min(0) + wide] if len(rest) else []
            todo += regions if sum(map(len, regions)) <= 1.5 * len(rest) else [rest]


def _small_cells(rule: Rule):
    """Rows sorted by cell: node and the least node of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        held: dict[int, tuple[int, np.ndarray]] = {}
        at = None

        def out() -> pa.RecordBatch:
            nodes = np.array(list(held), np.int64)
            cell = Cell([x[1] for x in held.values()], rule)
            cell.join(np.lexsort((nodes, -np.array([x[0] for x in held.values()]))))
            least = {lab: nodes[cell.label == lab].min() for lab in set(cell.label.tolist())}
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([least[x] for x in cell.label.tolist()], pa.int64())], ["node", "root"])

        for b in batches:
            for cell, node, pop, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if cell != at and held:
                    yield out()
                    held = {}
                at = cell
                held[node] = (pop, np.frombuffer(s.as_buffer(), "<u8").copy())
        if held:
            yield out()

    return run


def _blocks(pivots: DataFrame, by: list[str]) -> Iterator[tuple[int, int, dict]]:
    """pivots(cell, node, shingles) in blocks of bounded bytes, dealt by these columns: block number, blocks, cell -> nodes and sets."""
    size = pivots.agg(F.coalesce(F.sum(F.length("shingles") + 64), F.lit(0))).first()[0]
    many = max(1, -(-2 * size // BLOCK_BYTES))
    for k in range(many):
        by_cell = defaultdict(list)
        for r in pivots.where(F.pmod(F.xxhash64(*by), F.lit(many)) == k).collect():
            by_cell[r.cell].append((r.node, bytes(r.shingles)))
        yield k, many, dict(by_cell)


def _by_block(big: DataFrame, pivots: DataFrame, make: Callable, schema: str) -> DataFrame:
    """big.mapInArrow(make(a broadcast block)) over all blocks; the pivots of a cell are in one block."""
    out, sc = None, big.sparkSession.sparkContext
    for k, many, cells in _blocks(pivots, ["cell"]):
        own = big.where(F.pmod(F.xxhash64("cell"), F.lit(many)) == k) if many > 1 else big
        part = own.mapInArrow(make(sc.broadcast(cells)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _names_of(buckets: int, parts: int):
    """The shingles of a document under its cell as region names, or one part of so many parts of them by hash."""
    last = np.uint64((1 << 64) // parts - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for b in batches:
            names, nodes = [], []
            for cell, node, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = np.frombuffer(s.as_buffer(), "<u8")
                own = mix64(s + mix64(np.array([cell], np.int64).view(np.uint64)))
                names.append(own[own <= last])
                nodes.append(np.full(len(names[-1]), node, np.int64))
            if names:
                yield _packed(np.concatenate(names), np.concatenate(nodes), buckets)

    return run


_SUMS = "bucket int, packed binary"


def _private(buckets: int):
    """How many names of a task belong to one node only, by node; one row for each bucket of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        sums = _Sums()
        for name, node in _buckets(batches):
            order = np.argsort(name)
            name, node = name[order], node[order]
            new = np.r_[True, name[1:] != name[:-1], True]
            alone, many = np.unique(node[new[1:] & new[:-1]], return_counts=True)
            sums.add(alone, many.astype(np.int64))
        if sums.parts:
            node, many = sums.total()
            bucket = node % buckets
            own = [(int(k), np.stack((node[bucket == k], many[bucket == k])).tobytes()) for k in np.unique(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int32()), pa.array([x[1] for x in own], pa.binary())], ["bucket", "packed"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("jaccard")
    sums = _Sums()
    for b in batches:
        for row in b.column(1):
            sums.add(*np.frombuffer(row.as_buffer(), np.int64).reshape(2, -1))
    yield from sums.batches(["node", "alone"])


def _without(scratch: Scratch, big: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """big without the nodes of gone, its sets staying where they are."""
    block, bit = F.bitmap_bucket_number("node").alias("block"), F.bitmap_bit_position("node").alias("bit")
    bits = gone.select(block, bit).repartition("block").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = scratch.table(bits, f"{name}-bits")
    if bits.count() > BITMAPS:
        return big.join(gone, "node", "left_anti").select(*big.columns)
    byte = F.expr("cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)")
    out = big.select("*", block, bit).join(F.broadcast(bits), "block", "left")
    return out.where(F.col("bits").isNull() | (F.bit_get(byte, (F.col("bit") % 8).cast("int")) == 0)).select(*big.columns)


def _sharing(scratch: Scratch, big: DataFrame, rule: Rule, buckets: int, parts: int, name: str) -> DataFrame:
    """Documents of large cells that can link at all: too many shingles of their own rule that out. Those counted in one of
    several parts are at most those there are, so nobody leaves who can link."""
    names = big.select("cell", "node", "shingles").mapInArrow(_names_of(buckets, parts), "bucket int, packed binary").repartitionById(buckets, "bucket")
    alone = names.mapInArrow(_private(buckets), _SUMS).repartition("bucket").mapInArrow(_summed, "node long, alone long")
    alone = scratch.table(alone, f"{name}-alone")
    sizes = big.select("node", (F.length("shingles") / 8).alias("n"))
    gone = alone.join(sizes, "node").where(rule.den * (F.col("n") - F.col("alone")) < rule.num * F.col("n")).select("node")
    left = _without(scratch, big, scratch.table(gone, f"{name}-gone"), name)
    return scratch.table(left.select("cell", "node", "pop", "shingles"), f"{name}-left")


def _by_prefix(rule: Rule, buckets: int):
    """Level 1: the regions of the first shingles of each document, those common in its cell last."""

    def make(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("jaccard")
            common: dict[int, np.ndarray] = {}
            for b in batches:
                names, nodes = [], []
                for cell, node, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                    if cell not in common:
                        some = [np.frombuffer(x, "<u8") for _, x in block.value.get(cell, ())]
                        u, n = np.unique(np.concatenate(some), return_counts=True) if some else (np.zeros(0, np.uint64), np.zeros(0, int))
                        common[cell] = u[n > 1]
                    s = np.frombuffer(s.as_buffer(), "<u8")
                    rank = mix64(s ^ np.uint64(0x5851F42D4C957F2D))
                    late = np.isin(s, common[cell])
                    first = s[np.lexsort((rank, late))[: rule.prefix(len(s))]]
                    names.append(mix64(first + mix64(np.array([cell], np.int64).view(np.uint64))))
                    nodes.append(np.full(len(first), node, np.int64))
                if names:
                    yield _packed(np.concatenate(names), np.concatenate(nodes), buckets)

        return run

    return make


class Pivots:
    """The pivots of one large cell, and distances to them; the first CENTRES of a farthest-first order make regions."""

    def __init__(self, rule: Rule, members: list[tuple[int, bytes]]):
        sets = [np.frombuffer(x, "<u8") for _, x in members]
        self.rule, self.nodes, self.size = rule, [n for n, _ in members], np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.centres = [0]
        far = self.distances(sets[0])[1]
        while len(self.centres) < min(CENTRES, len(sets)) and far.max() > rule.epsilon:
            self.centres.append(int(far.argmax()))
            far = np.minimum(far, self.distances(sets[self.centres[-1]])[1])

    def distances(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a set has in common with each pivot, and its distance from it."""
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        inter = np.bincount(self.owner[at], minlength=len(self.size))
        return inter, 1 - inter / (self.size + len(s) - inter)

    def place(self, s: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The pivots that a set links with, and the regions that it is in: its nearest centre's, and by the triangle
        inequality those of centres at most twice the threshold's distance farther."""
        inter, d = self.distances(s)
        near = d[self.centres]
        return np.flatnonzero(self.rule.links(inter, self.size, len(s))), np.flatnonzero(near <= near.min() + 2 * self.rule.epsilon + 1e-9).tolist()


_AGAINST = "cell long, node long, pivot long, region int"


def _against(rule: Rule):
    """Level 2 across tasks: links of each document with the pivots of its cell (a star around the first; region null), and its regions (pivot null)."""

    def make(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("jaccard")
            ready: dict[int, Pivots] = {}
            between: set[tuple[int, int, int]] = set()

            def out(rows: list[tuple]) -> pa.RecordBatch:
                cols = list(zip(*rows, strict=True)) or [()] * 4
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(cols)], [x.split()[0] for x in _AGAINST.split(", ")])

            for b in batches:
                rows: list[tuple] = []
                for cell, node, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                    if cell not in block.value:
                        continue
                    if cell not in ready:
                        if len(ready) > 16:
                            ready.clear()
                        ready[cell] = Pivots(rule, block.value[cell])
                    own = ready[cell]
                    hit, regions = own.place(np.frombuffer(s.as_buffer(), "<u8"))
                    if len(hit):
                        first = own.nodes[hit[0]]
                        rows.append((cell, node, first, None))
                        between.update((cell, own.nodes[h], first) for h in hit[1:])
                    rows += [(cell, node, None, r) for r in regions]
                yield out(rows)
                if len(between) > 100_000:
                    yield out([(*x, None) for x in between])
                    between.clear()
            yield out([(*x, None) for x in between])

        return run

    return make


def _top(k: int):
    """The k largest (pop, node) of each cell within a task, and the bytes of the cell's largest set there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = defaultdict(list)
        most: dict[int, int] = defaultdict(int)
        for b in batches:
            for cell, node, pop, size in zip(*[c.to_pylist() for c in b.columns], strict=True):
                best[cell].append((pop, node))
                most[cell] = max(most[cell], size)
                if len(best[cell]) > 4 * k:
                    best[cell] = sorted(best[cell], reverse=True)[:k]
        rows = [(cell, *x, most[cell]) for cell, own in best.items() for x in sorted(own, reverse=True)[:k]]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cell", "pop", "node", "most"])

    return run


def by_size(scratch: Scratch) -> Callable[[DataFrame, str], tuple[DataFrame, DataFrame]]:
    def split(members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Members of cells that a task can join, and of larger ones."""
        sizes = members.groupBy("cell").agg(F.count("*").alias("docs"), F.sum(F.length("shingles") / 8).alias("all"))
        large = scratch.table(sizes.where((F.col("docs") > CELL_DOCS) | (F.col("all") > CELL_SHINGLES)).select("cell", "docs"), f"{name}-large")
        large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large  # one row for each large cell; the sets stay where they are
        return members.join(large, "cell", "left_anti"), members.join(large, "cell").select("cell", "node", "pop", "shingles", "docs")

    return split


def in_tasks(rule: Rule) -> Callable[[DataFrame], DataFrame]:
    def joined(members: DataFrame) -> DataFrame:
        """node, root of cells that a task can join."""
        by_cell = members.select("cell", "node", "pop", "shingles").repartition("cell").sortWithinPartitions("cell")
        return by_cell.mapInArrow(_small_cells(rule), "node long, root long")

    return joined


def _large_cells(scratch: Scratch, big: DataFrame, rule: Rule, split: Callable, joined: Callable) -> DataFrame:
    """node, root of the documents of cells too large for a task. big: cell, node, pop, shingles.

    Each turn holds a cell's documents against its pivots and cuts the cell into regions with windows, which are cells of
    the next turn. A pair that is still to be seen has a member outside the cell's largest component that has not been a
    pivot (an active one); only regions with active documents go on. A cell that regions do not cut (its documents are all
    within each other's windows) is finished at once: its active documents become pivots, block by block.
    """
    edges, step = None, 0

    def add(found: DataFrame) -> DataFrame:
        return found if edges is None else edges.unionByName(found)

    while True:
        step += 1
        name = lambda x: f"{x}-{step}"  # noqa: B023, E731
        top = big.select("cell", "node", "pop", F.length("shingles").alias("most")).mapInArrow(_top(PIVOTS), "cell long, pop long, node long, most long")
        # So many pivots of a cell that their sets are within a block.
        many = F.greatest(F.lit(1), F.least(F.lit(PIVOTS), F.floor(F.lit(BLOCK_BYTES) / 4 / F.max("most")))).cast("int")
        some = top.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("pop", "node")), False).alias("p"), many.alias("many"))
        chosen = scratch.table(some.select("cell", F.explode(F.slice("p", F.lit(1), F.col("many"))).alias("p")).select("cell", F.col("p.node").alias("node")), name("pivots"))
        pivots = scratch.table(big.join(chosen, ["cell", "node"]).select("cell", "node", "shingles").dropDuplicates(["cell", "node"]), name("pivot-sets"))
        found = scratch.table(_by_block(big.drop("docs"), pivots, _against(rule), _AGAINST), name("found"))
        edges = add(found.where("region is null").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
        roots = scratch.table(components(scratch, edges, name("turn")), name("turn-roots"))
        label = big.select("cell", "node").join(roots, "node", "left").select("cell", "node", F.coalesce("root", "node").alias("root"))
        label = scratch.table(label.join(chosen.withColumn("used", F.lit(True)), ["cell", "node"], "left"), name("labels"))
        tops = label.groupBy("cell", "root").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("top"))
        active = scratch.table(label.where("used is null").join(tops, "cell").where("root <> top").select("cell", "node"), name("active"))
        if active.isEmpty():
            break
        regions = found.where("region is not null").join(chosen, ["cell", "node"], "left_anti").select("cell", "node", "region")
        live = regions.join(active, ["cell", "node"]).select("cell", "region").distinct()
        live = scratch.table(regions.join(live, ["cell", "region"]), name("regions"))
        whole = big.groupBy("cell").agg(F.count("*").alias("docs"))
        sizes = live.groupBy("cell", "region").agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        cut = (F.col("n") <= 1.5 * F.col("docs")) & (F.col("most") <= 0.75 * F.col("docs"))
        state = scratch.table(sizes.join(whole, "cell").select("cell", cut.alias("cut")), name("state"))
        tight = active.join(state.where("not cut"), "cell", "left_semi")
        last = scratch.table(big.join(tight, ["cell", "node"]).select("cell", "node", "shingles"), name("tight"))
        rest = big.select("cell", "node", "pop", "shingles").join(state.where("not cut"), "cell", "left_semi")
        for k, _, cells in _blocks(last, ["cell", "node"]):  # one block at a time, whatever their number
            block = big.sparkSession.sparkContext.broadcast(cells)
            links = rest.mapInArrow(_against(rule)(block), _AGAINST).where("region is null")
            edges = edges.unionByName(scratch.table(links.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), name(f"links-{k}")))
            block.destroy()
        if state.where("cut").isEmpty():
            break
        inner = live.join(state.where("cut"), "cell", "left_semi")
        parts = big.select("cell", "node", "pop", "shingles").join(inner, ["cell", "node"])
        parts = scratch.table(parts.select(F.xxhash64("cell", "region").alias("cell"), "node", "pop", "shingles"), name("parts"))
        small, big = split(parts, name("parts"))
        within = scratch.table(joined(small).select(F.col("node").alias("a"), F.col("root").alias("b")), name("within"))
        edges = edges.unionByName(within)
        big = scratch.table(big.select("cell", "node", "pop", "shingles"), name("big"))
        if big.isEmpty():
            break
    return components(scratch, edges, "large")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, tag (see ``rows``) of every row of docs(doc_id, text); links: den * intersection >= num * union."""
    spark = docs.sparkSession
    ship(spark)
    scratch, rule = Scratch(spark), Rule(num, den)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = scratch.table(own.mapInArrow(_identity(words), "doc_id long, d1 long, d2 long, n long, tag binary"), "rows")

    def level0(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        names, nodes, seen, size = [], [], set(), 0
        for _, texts in by_bytes(batches, 0, BATCH_BYTES):
            for t in texts:
                s = shingles(t, words)
                node = digest(s)[0]
                if node not in seen:
                    seen.add(node)
                    names.append(rule.regions(s))
                    nodes.append(np.full(len(names[-1]), node, np.int64))
                    size += len(names[-1])
                if size >= BATCH_NAMES:
                    yield _packed(np.concatenate(names), np.concatenate(nodes), buckets)
                    names, nodes, seen, size = [], [], set(), 0
        if names:
            yield _packed(np.concatenate(names), np.concatenate(nodes), buckets)

    edges = _edges(scratch, own.select("text").mapInArrow(level0, "bucket int, packed binary"), buckets, "edges")
    cells = _cells(scratch, edges, "cells")

    classes = scratch.table(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")), "classes")
    # One text for each set of a cell; nodes get numbers of their own, so that nothing rests on half a digest.
    sets = classes.join(cells.withColumnRenamed("node", "d1"), "d1").withColumn("node", F.monotonically_increasing_id())
    sets = scratch.table(sets, "sets")
    few = sets.count() <= BROADCAST_ROWS
    wanted = sets.select(F.col("doc_id").alias("id"), "d1", "d2", "cell", "pop", "node")
    texts = own.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "d1", "d2", "cell", "pop", "node")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for b, texts in by_bytes(batches, 0, BATCH_BYTES):
            keep, found = [], []
            for i, (t, d) in enumerate(zip(texts, zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True), strict=True)):
                s = shingles(t, words)
                if digest(s) == d:
                    keep.append(i)
                    found.append(s.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(3).take(at), b.column(5).take(at), b.column(4).take(at), pa.array(found, pa.binary())], ["cell", "node", "pop", "shingles"])

    member = "cell long, node long, pop long, shingles binary"
    loaded = scratch.table(texts.mapInArrow(load, member), "loaded")

    split, joined = by_size(scratch), in_tasks(rule)
    small, big = split(loaded, "first")
    roots = [joined(small)]
    for k, parts in (("a", PARTS), ("b", 1)):  # what leaves in one turn may leave others alone in the next
        if not big.isEmpty():
            small, big = split(_sharing(scratch, big, rule, buckets, parts, k), k)
            roots.append(joined(small))
    if not big.isEmpty():
        sample = big.where(F.pmod(F.xxhash64("node"), F.col("docs")) < SAMPLE).select("cell", "node", "shingles")
        again = _edges(scratch, _by_block(big.drop("docs"), sample, _by_prefix(rule, buckets), "bucket int, packed binary"), buckets, "edges-again")
        inner = _cells(scratch, again, "cells-again")
        members = scratch.table(big.select("node", "shingles").join(inner, "node").select("cell", "node", "pop", "shingles"), "members")
        small, big = split(members, "second")
        roots.append(joined(small))
        if not big.isEmpty():
            roots.append(_large_cells(scratch, big.drop("docs"), rule, split, joined))
    labels = roots[0]
    for r in roots[1:]:
        labels = labels.unionByName(r)
    labels = scratch.table(labels.distinct(), "roots")

    # A set outside any cell, or alone in the end, is a component of its own.
    ids = scratch.table(sets.select("d1", "d2", "doc_id", "node").join(labels, "node", "left").select("d1", "d2", "doc_id", F.coalesce("root", "node").alias("root")), "ids")
    least = scratch.table(ids.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    linked = scratch.table(ids.join(least, "root").select("d1", "d2", "component_id"), "linked")
    every = classes.join(linked, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.join(scratch.table(every, "components"), ["d1", "d2"], "left")
    scratch.only("rows", "components")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "tag")
