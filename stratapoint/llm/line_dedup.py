"""Line dedup over range-partitioned line hashes.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code
points that occur in at least ``min_docs`` documents lose all their lines except in the largest doc_id that holds them.

The 128-bit hashes of the keys are range-partitioned and sorted by hash, then document (largest first), then position; so
a key with a third of all lines is spread over many tasks, and each task streams through its rows, batch by batch, and
holds no more than the lines of a key that has had fewer than ``min_docs`` documents so far. Only the first and last key of
a task can go on in another; lines of these that are not yet known to go wait for exact totals, two rows a task, which are
broadcast. What is returned is not text but a zlib-compressed bitmap for each document that
loses lines (bit set: the line stays); ``apply_bitmaps`` joins them with the texts.

Null and empty text are one empty line. A null doc_id counts as one document and as the smallest. Rows that repeat a
doc_id are one document for counting; each row's own lines are judged. Rows are told apart by doc_id and text, so
repeated rows share a bitmap. Very long texts and lines are only hashed. An empty table gives no rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratapoint.llm.rows import tag, tag_of
from stratapoint.llm.text import LOWER, SPACE, claim
from stratapoint.runtime import Scratch, ship

_LINES = "h1 long, h2 long, no_id boolean, doc_id long, tag binary, pos int"
_NAMES = [x.split()[0] for x in _LINES.split(", ")]


def _explode(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lines")
        for b in batches:
            hashes, ids, tags, pos = [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or b""
                had = len(pos)
                for i, line in enumerate(text.translate(LOWER).split(b"\n")):
                    key = line.strip(SPACE)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        pos.append(i)
                ids += [doc_id] * (len(pos) - had)
                if len(pos) > had:
                    tags += [tag(text)] * (len(pos) - had)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            doc = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), doc.is_null(), doc, pa.array(tags, pa.binary()), pa.array(pos, pa.int32())], _NAMES)

    return run


_JUDGED = f"{_LINES}, known boolean, task int, docs long, end_no_id boolean, end_id long"


def _judge(min_docs: int):
    """Streams through a sorted task: lines that go (known true), lines of its first or last key that may go (known false),
    and for each of these two keys one row (known null) with its first and last document and the number of its documents here.

    Held from batch to batch are only lines of a key whose documents are still fewer than min_docs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Task(min_docs)
        for b in batches:
            if b.num_rows:
                yield from own.batch(b)
        yield from own.finish()

    return run


class _Task:
    """The key at hand of a sorted task: its first and last document, how many it has so far, and lines not yet judged."""

    names = [x.split()[0] for x in _JUDGED.split(", ")]

    def __init__(self, min_docs: int):
        self.min_docs, self.task = min_docs, TaskContext.get().partitionId()
        self.key = self.start = self.end = None
        self.docs, self.first_key = 0, True
        self.held: list[pa.RecordBatch] = []

    def lines(self, b: pa.RecordBatch, known: bool) -> pa.RecordBatch:
        n = b.num_rows
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([known] * n, pa.bool_()), pa.array([self.task] * n, pa.int32()), *(pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int64()))], self.names)

    def about(self) -> pa.RecordBatch:
        row = (*self.key, *self.start, None, None, None, self.task, self.docs, *self.end)
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], self.names)

    def batch(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h1, h2, null, doc = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).fill_null(0).to_numpy()
        new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_doc = new_key | np.r_[True, (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])]
        cut = [*np.flatnonzero(new_key).tolist(), len(h1)]
        of = lambda i: (bool(null[i]), None if null[i] else int(doc[i]))

        def feed(j: int) -> Iterator[pa.RecordBatch]:
            a, z = cut[j], cut[j + 1]
            nth = np.cumsum(new_doc[a:z]) + self.docs - (self.end == of(a))
            self.docs, self.end = int(nth[-1]), of(z - 1)
            if self.first_key:  # it may go on from the task before
                yield self.lines(b.slice(a, z - a), False)
                return
            self.held.append(b.slice(a, z - a).filter(pa.array(nth > 1)))
            if self.docs >= self.min_docs:
                yield from (self.lines(x, True) for x in self.held if x.num_rows)
                self.held = []

        def begin(j: int) -> Iterator[pa.RecordBatch]:
            self.key, self.start, self.end, self.docs, self.held = (int(h1[cut[j]]), int(h2[cut[j]])), of(cut[j]), None, 0, []
            yield from feed(j)

        j, last = 0, len(cut) - 2
        if self.key == (h1[0], h2[0]):
            yield from feed(0)
            j = 1
        if j <= last and self.key is None:
            yield from begin(0)
            j = 1
        if j <= last and self.first_key:
            yield self.about()
            self.first_key = False
        if j < last:  # keys that begin and end here
            a, z = cut[j], cut[last]
            at = np.array(cut[j : last + 1]) - a
            size, seen = np.diff(at), np.cumsum(new_doc[a:z])
            before = np.repeat(seen[at[:-1]] - 1, size)
            gone = np.flatnonzero((np.repeat(seen[at[1:] - 1], size) - before >= self.min_docs) & (seen - before > 1))
            if len(gone):
                yield self.lines(b.take(pa.array(gone + a)), True)
        if j <= last:
            yield from begin(last)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            yield from (self.lines(x, False) for x in self.held if x.num_rows)
            yield self.about()


_BITMAPS = "doc_id long, tag binary, n_dropped int, last int, keep_bitmap binary"


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document, row and position: one bitmap for each row of documents."""

    def out(held: list[tuple[int | None, bytes, list[int]]]) -> pa.RecordBatch:
        maps = []
        for _, _, pos in held:
            stays = np.ones(pos[-1] + 1, np.uint8)
            stays[pos] = 0
            maps.append(zlib.compress(np.packbits(stays).tobytes()))
        cols = [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary()), pa.array([len(h[2]) for h in held], pa.int32()), pa.array([h[2][-1] for h in held], pa.int32()), pa.array(maps, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _BITMAPS.split(", ")])

    held: list[tuple[int | None, bytes, list[int]]] = []
    for b in batches:
        for doc_id, tag_, pos in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if held and held[-1][:2] == (doc_id, tag_):
                if held[-1][2][-1] != pos:  # repeated rows bring every position again
                    held[-1][2].append(pos)
            else:
                if len(held) >= 5000:
                    yield out(held)
                    held = []
                held.append((doc_id, tag_, [pos]))
    if held:
        yield out(held)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, tag (see ``rows``), n_dropped, last (the last dropped line), keep_bitmap of documents that lose lines."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    lines = scratch.table(own.mapInArrow(_explode(min_chars), _LINES), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("no_id"), F.col("doc_id").desc(), F.col("tag"), F.col("pos")]
    judged = scratch.table(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_judge(min_docs), _JUDGED), "judged")
    scratch.only("judged")
    # At most two rows a task. A document that ends one task's lines of a key and begins the next one's is one document.
    tasks = Window.partitionBy("h1", "h2").orderBy("task")
    both = F.coalesce((F.lag("end_no_id").over(tasks) == F.col("no_id")) & F.lag("end_id").over(tasks).eqNullSafe(F.col("doc_id")), F.lit(False))
    edges = judged.where("known is null").select("h1", "h2", "no_id", "doc_id", "task", (F.col("docs") - both.cast("int")).alias("docs"))
    edges = edges.groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.min_by(F.struct("no_id", "doc_id"), "task").alias("top")).where(F.col("total") >= min_docs)
    late = judged.where("not known").join(F.broadcast(edges), ["h1", "h2"]).where(~((F.col("no_id") == F.col("top.no_id")) & F.col("doc_id").eqNullSafe(F.col("top.doc_id"))))
    gone = judged.where("known").select("doc_id", "tag", "pos").unionByName(late.select("doc_id", "tag", "pos"))
    return gone.repartition("doc_id", "tag").sortWithinPartitions("doc_id", "tag", "pos").mapInArrow(_bitmaps, _BITMAPS)


def lines_kept(text: bytes, bitmap: bytes | None, last: int | None) -> list[bytes]:
    lines = text.split(b"\n")
    if bitmap is None:
        return lines
    stays = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: last + 1]
    return [x for x, s in zip(lines, stays, strict=False) if s] + lines[last + 1 :]


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text (binary), keep_bitmap, last for every row of docs; the last two are null where all lines stay."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    b = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("tag").alias("b_tag"), "keep_bitmap", "last").hint("shuffle_hash")
    return own.join(b, F.col("doc_id").eqNullSafe(F.col("b_doc")) & (tag_of(F.col("text")) == F.col("b_tag")), "left").select("doc_id", "text", "keep_bitmap", "last")


_DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text, bitmap, last in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            text = text.as_py()
            kept = lines_kept(text, bitmap, last)
            n = text.count(b"\n") + 1
            rows.append((doc_id, n, n - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(cols)], [x.split()[0] for x in _DIGEST.split(", ")])


def line_dedup_digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    return with_bitmaps(docs, line_dedup(docs, min_chars, min_docs)).mapInArrow(_digest, _DIGEST)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [b"\n".join(lines_kept(t.as_py(), m, last)).decode() for t, m, last in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id and the text that stays, for every row."""
    return with_bitmaps(docs, bitmaps).mapInArrow(_texts, "doc_id long, text string")
