"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that also starts earlier.

Shards. Every window of ``length`` bytes has an anchor: the leftmost of its ``SEED``-byte strings with the least hash. Equal
windows have equal anchors, and equal text for ``SEED`` more bytes before or behind it (whichever half the window reaches
farther into); that context is the key of a comparison, and consecutive windows of one key travel as one chunk. First the
keys are counted; a bit filter of those that occur twice (a size chosen from their number, at most ``FILTER_BITS``) is
broadcast, and only chunks of such keys go to shards. Equal chunks are resolved before they travel: within a batch, all but
the earliest lose all their windows at once.

In a shard, the distinct chunks of a key are one string; a key of many chunks is split by longer contexts until none
makes a string of more than ``WIDE`` symbols. Many strings are suffix-sorted together by induced sorting (suffix types,
recursive sorting of leftmost S substrings, two induction passes: see ``suffix_array``). Runs of the suffix array whose
permuted common prefixes reach ``length`` are equal windows; all but the earliest go.

What is removed travels as spans by document, not as text, in one row for a task and a bucket of documents, and is joined
with the texts once.

Texts are UTF-8 bytes; null counts as empty; matches never cross documents. Earlier means a smaller doc_id (null before
all; rows that share an id go by the MD5 digest of their text), then a smaller start. Rows that repeat id and text are one
document. Very long texts are scanned in overlapping pieces of ``SLICE_BYTES``. An empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.llm.rows import tag, tag_of
from stratapoint.llm.suffix_array import permuted_prefixes, suffix_arrays
from stratapoint.llm.text import by_bytes, claim, mix64
from stratapoint.runtime import Scratch, ship

SEED = 32
#: The largest bit filter that is broadcast: 64 MiB.
FILTER_BITS = 1 << 29
#: Bytes of text that are scanned together, and whose chunks are held together before they travel.
SLICE_BYTES, BATCH_BYTES = 1 << 19, 8 << 20
#: Symbols of a string, and of all strings that are suffix-sorted together.
WIDE, BATCH_SYMBOLS = 512, 1 << 20
#: Bytes of spans that a task holds before it sends them off.
HELD_BYTES = 32 << 20

_PLACE = np.uint64((1 << 20) - 1)


def _seeds(text: np.ndarray) -> np.ndarray:
    """Hashes of all strings of SEED bytes."""
    n = len(text) - SEED + 1
    words = np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), 0, (1,))
    h = words * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    for step, factor in ((8, 0xD6E8FEB86659FD93), (16, 0xBF58476D1CE4E5B9)):
        h = h[:-step] * np.uint64(factor) + h[step:]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h[:n]


def anchors(text: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor and the half of its context: key, first and last window start, anchor.

    text: at most SLICE_BYTES of documents that end at these places; no window crosses an end.
    """
    none = np.zeros(0, np.int64)
    starts = np.r_[0, ends[:-1]]
    fit = ends - starts >= length
    if not fit.any():
        return none.view(np.uint64), none, none, none
    h = _seeds(np.frombuffer(text, np.uint8))
    value, m, span = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1, length - SEED + 1
    while m < span:  # the least hash of the seeds of a window, the leftmost one of equals
        step = min(m, span - m)
        value, m = np.minimum(value[:-step], value[step:]), m + step
    at = (value & _PLACE).astype(np.int32)
    whole = np.zeros(len(text) + 1, np.int8)
    whole[starts[fit]] = 1
    whole[ends[fit] - length + 1] -= 1
    whole = np.cumsum(whole[: len(at)], dtype=np.int8).view(bool)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    at = at[first].astype(np.int64)
    # Windows that reach far before their anchor share what stands before it, the others what stands behind it.
    side = min(SEED, (length - SEED) // 2)
    before, behind = first <= at - side, last > at - side
    b, e = at[before], at[behind]
    keys = np.concatenate((mix64(h[b - side] * np.uint64(3) + h[b]), mix64(h[e] * np.uint64(5) + h[e + side])))
    first, last = np.concatenate((first[before], np.maximum(first[behind], e - side + 1))), np.concatenate((np.minimum(last[before], b - side), last[behind]))
    return keys, first, last, np.concatenate((b, e))


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of bounded size: bytes, ends of the pieces, and of each piece its text's number and its place there.

    A text longer than a slice goes in pieces that share length - 1 bytes, so that each of its windows is in one piece.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        return b"".join(x[2] for x in held), np.cumsum([len(x[2]) for x in held]), np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, max(1, len(t) - length + 1), SLICE_BYTES - length + 1):
            piece = t[at : at + SLICE_BYTES]
            if size + len(piece) > SLICE_BYTES:
                yield out()
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield out()


def _hashes(length: int, buckets: int):
    """Distinct anchor hashes of a batch by bucket (their top bits), and whether a hash came twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffixes")
        for _, texts in by_bytes(batches, 0, BATCH_BYTES):
            found = [anchors(x, ends, length)[0] for x, ends, _, _ in _slices(texts, length)]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(k, h[a:z].tobytes(), (n[a:z] > 1).astype(np.uint8).tobytes()) for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < z]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["bucket", "hashes", "twice"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All batches of a task's buckets together: the hashes that occur twice or more."""
    got, more = [], []
    for b in batches:
        for h, m in zip(b.column(1), b.column(2), strict=True):
            got.append(np.frombuffer(h.as_buffer(), np.uint64).copy())
            more.append(np.frombuffer(m.as_buffer(), np.uint8).copy())
    if got:
        h, m = np.concatenate(got), np.concatenate(more)
        order = np.argsort(h)
        h, m = h[order], m[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[first, len(h)])
        keep = (size > 1) | (np.maximum.reduceat(m, first) > 0)
        own = h[first][keep]
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary()), pa.array([len(own)], pa.int64())], ["hashes", "n"])


#: Bits of one row of the filter.
_SEGMENT = 1 << 18


def _segments(shift: int):
    """The filter's bits of a task's hashes, as segments of it; hashes are dealt by their top bits, so tasks hardly share any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for h in b.column(0):
                bit = np.frombuffer(h.as_buffer(), np.uint64) >> np.uint64(shift)
                part = (bit // np.uint64(_SEGMENT)).astype(np.int64)
                for k in np.unique(part).tolist():
                    held.setdefault(k, np.zeros(_SEGMENT, np.uint8))[(bit[part == k] % np.uint64(_SEGMENT)).astype(np.int64)] = 1
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([np.packbits(held[k]).tobytes() for k in keys], pa.binary())], ["part", "bits"])

    return run


_ROW = "hash long, no_id boolean, doc_id long, tag binary, start int, body binary"
_ROW_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _ROW_NAMES)


def _merged(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open ranges sorted by start, touching ones as one."""
    if not len(a):
        return a, z
    far = np.maximum.accumulate(z)
    new = np.flatnonzero(np.r_[True, a[1:] > far[:-1]])
    return a[new], far[np.r_[new[1:] - 1, len(a) - 1]]


def _packed_spans(spans: array) -> bytes:
    """Merged spans of start, end, start, end ..."""
    a, z = np.array(spans, "<i4").reshape(-1, 2).T
    order = np.argsort(a, kind="stable")
    return np.stack(_merged(a[order], z[order]), 1).astype("<i4").tobytes()


class _Spans:
    """Spans by document, until they are sent off as one row for each bucket of documents."""

    def __init__(self, buckets: int):
        self.buckets, self.size = buckets, 0
        self.gone: dict[tuple, array] = {}

    def lose(self, doc: tuple, spans: tuple | bytes) -> None:
        """spans: start, end, start, end ... as numbers or as little-endian 32-bit integers."""
        if (own := self.gone.get(doc)) is None:
            own = self.gone[doc] = array("i")
            self.size += 200
        (own.frombytes if isinstance(spans, bytes) else own.extend)(spans)
        self.size += 8
        if len(own) > 1 << 16:
            own[:] = array("i", _packed_spans(own))

    def rows(self) -> list[tuple]:
        """bucket and, packed, documents with their spans."""
        by_bucket: dict[int, list[bytes]] = {}
        for (has_id, doc_id, tag), own in self.gone.items():
            spans = _packed_spans(own)
            by_bucket.setdefault(int.from_bytes(tag[:4], "little") % self.buckets, []).append(_DOC.pack(has_id, doc_id, tag, len(spans)) + spans)
        self.gone, self.size = {}, 0
        return [(k, b"".join(x)) for k, x in by_bucket.items()]


_DOC = struct.Struct("<?q16sI")


def _spans_of(packed: bytes) -> Iterator[tuple[tuple, bytes]]:
    at = 0
    while at < len(packed):
        has_id, doc_id, tag, size = _DOC.unpack_from(packed, at)
        at += _DOC.size
        yield (has_id, doc_id, tag), packed[at : at + size]
        at += size


def _chunks(length: int, shift: int, bits, buckets: int):
    """Chunks whose anchor may occur twice (body: their text), and spans of equal chunks in the batch (hash null, body: packed spans of a bucket of documents, its number as doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, spans = np.frombuffer(bits.value, np.uint8), _Spans(buckets)
        send = lambda: _batch([(None, False, k, None, 0, x) for k, x in spans.rows()])
        for b, texts in by_bytes(batches, 1, BATCH_BYTES):
            best: dict[tuple[int, bytes], tuple] = {}
            docs: dict[int, tuple] = {}
            ids = b.column(0).to_pylist()
            for whole, ends, owner, place in _slices(texts, length):
                h, first, last, _ = anchors(whole, ends, length)
                bit = h >> np.uint64(shift)
                hit = np.flatnonzero(full[(bit >> np.uint64(3)).astype(np.int64)] >> (7 - (bit & np.uint64(7))).astype(np.uint8) & 1)
                first, last = first[hit], last[hit]
                piece = np.searchsorted(ends, first, side="right")
                own, start = owner[piece], first - np.r_[0, ends[:-1]][piece] + place[piece]
                for i in np.unique(own).tolist():
                    if i not in docs:
                        docs[i] = (ids[i] is not None, ids[i] or 0, tag(texts[i]))
                for x, i, s, f, e in zip(h[hit].view(np.int64).tolist(), own.tolist(), start.tolist(), first.tolist(), (last + length).tolist(), strict=True):
                    key, new = (x, whole[f:e]), (docs[i], s)
                    old = best.setdefault(key, new)
                    if old is new or old == new:
                        continue
                    if new < old:
                        best[key], new = new, old
                    if new[0] != best[key][0] or new[1] != best[key][1]:
                        spans.lose(new[0], (new[1], new[1] + len(key[1])))
            rows = [(x, not doc[0], doc[1], doc[2], s, body) for (x, body), (doc, s) in best.items()]
            for i in range(0, len(rows), 20_000):
                yield _batch(rows[i : i + 20_000])
            if spans.size > HELD_BYTES:
                yield send()
        yield send()

    return run


class _Shard:
    """Collects groups of distinct chunks, sorts them in batches, and gathers what goes by document."""

    def __init__(self, length: int, spans: _Spans):
        self.length, self.groups, self.symbols, self.lose = length, [], 0, spans.lose

    def add(self, members: dict[bytes, tuple]) -> None:
        """members: distinct chunk -> (document, start) of its earliest occurrence."""
        if sum(len(x) + 1 for x in members) <= WIDE:
            self._add(list(members.items()))
            return
        # All windows of a chunk have one anchor; a window is known by the anchor's place in it, its offset.
        offsets = []
        for whole, ends, _, _ in _slices(list(members), self.length):
            _, first, _, at = anchors(whole, ends, self.length)
            offsets += (at - first)[np.argsort(first)].tolist()
        self._split([(body, doc, start, p) for (body, (doc, start)), p in zip(members.items(), offsets, strict=True)], 0, self.length - SEED)

    def _add(self, group: list[tuple[bytes, tuple]]) -> None:
        self.groups.append(group)
        self.symbols += sum(len(x) + 1 for x, _ in group) + 1
        if self.symbols >= BATCH_SYMBOLS:
            self.sort()

    def _split(self, members: list[tuple[bytes, tuple, int, int]], lo: int, hi: int) -> None:
        """members: chunk, document, start, the offset of its first window; all windows have offsets from lo to hi.

        The windows of half the offsets share more context, so that each half makes many smaller groups.
        """
        mid = (lo + hi) // 2
        for a, z in ((lo, mid), (mid + 1, hi)):
            groups: dict[bytes, dict[bytes, tuple]] = {}
            for body, doc, start, p in members:
                top, low = min(z, p), max(a, p - (len(body) - self.length))  # offsets fall from window to window
                if top < low:
                    continue
                part, new = body[p - top : p - low + self.length], (doc, start + p - top, top)
                own = groups.setdefault(body[p - a : p - z + self.length], {})
                old = own.setdefault(part, new)
                if old is not new:
                    if new[:2] < old[:2]:
                        own[part], old, new = new, new, old
                    if new[:2] != old[:2]:
                        self.lose(new[0], (new[1], new[1] + len(part)))
            for own in groups.values():
                if len(own) < 2:
                    continue
                if sum(len(x) + 1 for x in own) <= WIDE:
                    self._add([(x, (doc, start)) for x, (doc, start, _) in own.items()])
                else:
                    self._split([(x, *y) for x, y in own.items()], a, z)

    def sort(self) -> None:
        groups = sorted(self.groups, key=lambda g: sum(len(x) + 1 for x, _ in g))
        self.groups, self.symbols = [], 0
        while groups:
            # Rows of similar length go together, so that little is padding.
            least = sum(len(x) + 1 for x, _ in groups[0])
            many = next((i for i, g in enumerate(groups) if sum(len(x) + 1 for x, _ in g) > 1.3 * least + 64), len(groups))
            self._sort(groups[:many])
            groups = groups[many:]

    def _sort(self, groups: list[list[tuple[bytes, tuple]]]) -> None:
        n = np.array([sum(len(x) + 1 for x, _ in g) + 1 for g in groups])
        t = np.zeros((len(groups), int(n.max())), np.int64)
        owner = np.full(t.shape, -1, np.int64)  # the chunk of each place that starts a window
        owners: list[tuple[tuple, int]] = []  # document, and the text position of the place 0 of the row
        for r, g in enumerate(groups):
            at = 0
            for body, (doc, start) in g:
                t[r, at : at + len(body)] = np.frombuffer(body, np.uint8)
                t[r, at : at + len(body)] += 2
                t[r, at + len(body)] = 1
                owner[r, at : at + len(body) - self.length + 1] = len(owners)
                owners.append((doc, start - at))
                at += len(body) + 1
        sa = suffix_arrays(t, n)
        prefix = permuted_prefixes(t, n, sa)
        rows, width = t.shape
        r, j = np.nonzero(np.arange(width) < n[:, None])
        p = sa[r, j].astype(np.int64)
        joins = prefix[r, p] >= self.length  # equal to the window before in sorted order
        run = np.cumsum(~joins) - 1
        size = np.bincount(run)
        some = (size[run] > 1) & (owner[r, p] >= 0)  # a match that runs past a chunk's end starts at no window
        r, p, run = r[some], p[some], run[some]
        own = owner[r, p]
        docs = sorted({o[0] for o in owners})
        rank = {d: i for i, d in enumerate(docs)}
        doc = np.array([rank[o[0]] for o in owners], np.int64)[own] if len(own) else own
        start = np.array([o[1] for o in owners], np.int64)[own] + p if len(own) else own
        order = np.lexsort((start, doc, run))
        run, doc, start = run[order], doc[order], start[order]
        later = np.r_[False, run[1:] == run[:-1]] if len(run) else np.zeros(0, bool)
        doc, start = doc[later], start[later]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
        for a, z in zip(cut, [*cut[1:], len(doc)], strict=True) if len(doc) else ():
            self.lose(docs[doc[a]], np.stack(_merged(start[a:z], start[a:z] + self.length), 1).astype("<i4").tobytes())


_SPANS = "bucket int, packed binary"


def _shards(length: int, buckets: int):
    """Rows sorted by anchor hash, then from early to late."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = _Spans(buckets)
        shard, at, members = _Shard(length, spans), None, {}

        def send() -> pa.RecordBatch:
            rows = spans.rows()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["bucket", "packed"])

        for b in batches:
            for x, no_id, doc_id, tag_, start, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if x is None:
                    for doc, own in _spans_of(body):
                        spans.lose(doc, own)
                    continue
                if x != at:
                    if len(members) > 1:  # the windows of one chunk all differ
                        shard.add(members)
                    at, members = x, {}
                doc = (not no_id, doc_id, tag_)
                old = members.setdefault(body, (doc, start))
                if old[1] != start or old[0] != doc:  # rows that repeat id and text are one document
                    spans.lose(doc, (start, start + len(body)))
            if spans.size > HELD_BYTES:
                yield send()
        if len(members) > 1:
            shard.add(members)
        shard.sort()
        yield send()

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: one row for each document."""
    at, held = None, _Spans(1)

    def out() -> pa.RecordBatch:
        rows = [(doc[1] if doc[0] else None, doc[2], _packed_spans(own)) for doc, own in held.gone.items()]
        held.gone = {}
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "tag", "spans"])

    for b in batches:
        for bucket, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if bucket != at:
                yield out()
                at = bucket
            for doc, own in _spans_of(packed):
                held.lose(doc, own)
    yield out()


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, tag (see ``rows``) and spans (binary, pairs of 32-bit numbers) of documents that lose bytes."""
    if length <= SEED:
        raise ValueError(f"length must be above {SEED}")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.select("text").mapInArrow(_hashes(length, 8 * tasks), "bucket int, hashes binary, twice binary").repartition("bucket")
    repeated = scratch.table(dealt.mapInArrow(_repeated, "hashes binary, n long"), "repeated")
    n = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    log = max(20, min(FILTER_BITS.bit_length() - 1, (16 * n).bit_length()))
    bits = np.zeros((1 << log) // 8, np.uint8)
    for r in repeated.select("hashes").mapInArrow(_segments(64 - log), "part long, bits binary").collect():  # the filter's own size, in segments
        a = r.part * _SEGMENT // 8
        bits[a : a + _SEGMENT // 8] |= np.frombuffer(r.bits, np.uint8)[: len(bits) - a]
    sent = spark.sparkContext.broadcast(bits.tobytes())
    rows = own.mapInArrow(_chunks(length, 64 - log, sent, 4 * tasks), _ROW)
    sorted_ = rows.repartition(F.coalesce("hash", F.xxhash64("doc_id"))).sortWithinPartitions("hash", F.desc("no_id"), "doc_id", "tag", "start")
    spans = scratch.table(sorted_.mapInArrow(_shards(length, 4 * tasks), _SPANS), "spans")
    scratch.only("spans")
    return spans.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_together, "doc_id long, tag binary, spans binary")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text (binary) and spans of every row; null where nothing goes."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    s = spans.select(F.col("doc_id").alias("s_doc"), F.col("tag").alias("s_tag"), "spans").hint("shuffle_hash")
    return own.join(s, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (tag_of(F.col("text")) == F.col("s_tag")), "left").select("doc_id", "text", "spans")


def kept_bytes(text: bytes, spans: bytes | None) -> tuple[bytes, int]:
    """What stays of a text, and how many spans go."""
    if not spans:
        return text, 0
    pairs = np.frombuffer(spans, "<i4").reshape(-1, 2).tolist()
    out, end = [], 0
    for a, z in pairs:
        out.append(text[end:a])
        end = z
    return b"".join([*out, text[end:]]), len(pairs)


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            text = text.as_py()
            kept, n = kept_bytes(text, spans)
            rows.append((doc_id, len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(cols)], [x.split()[0] for x in _DIGEST.split(", ")])


def suffix_dedup_digest(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return with_spans(docs, repeated_spans(docs, length)).mapInArrow(_digest, _DIGEST)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = [kept_bytes(t.as_py(), s)[0] for t, s in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], ["doc_id", "text"])


def suffix_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id and the bytes that stay of every row's text (a cut may fall inside a character)."""
    return with_spans(docs, repeated_spans(docs, length)).mapInArrow(_texts, "doc_id long, text binary")
