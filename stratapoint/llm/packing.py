"""Best-fit packing after a dominance reduction (Martello and Toth).

Documents become pieces of at most ``capacity`` ids; only longer ones are cut. The instance is no more than a count for
each length, ``capacity`` numbers however many documents there are, so it is solved on the driver:

1. Reduction. For the longest length l with room r beside it: if nothing fits, l stands alone; if the longest length k
   that fits is at least as long as any sum of other pieces within r (k fills r exactly, or no two pieces fit, or no
   reachable sum lies in (k, r]), the set {l, k} dominates every alternative and is fixed for as many pairs as there are.
   Fixed pieces leave the instance, and the test is repeated until nothing changes.
2. Best-fit decreasing on what is left, whole runs of equal lengths and equal bins at a time (the result is that of the
   plain algorithm, piece by piece).

The plan says, for ranks of each length, which sequences and offsets they take. Pieces get their rank from a range
partitioning by length and identity, so that a length with a third of all pieces is spread over many tasks.

Very long texts are encoded whole and cut into pieces. Null or empty text is the end id alone. Rows that repeat a doc_id are documents of their own. An empty table packs into
nothing. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.llm.tokens import END, encoder
from stratapoint.runtime import Scratch, ship

#: A group of equal sequences: how many, and (length, copies) of what each holds, in order.
Group = tuple[int, list[tuple[int, int]]]


def _reachable(lengths: list[int], room: int) -> int:
    """The largest sum within room of any of these lengths, each as often as wanted."""
    mask, bits = (1 << room + 1) - 1, 1
    for n in lengths:
        step = n
        while step <= room:
            bits |= bits << step & mask
            step *= 2
        if bits >> room & 1:
            return room
    return bits.bit_length() - 1


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """The dominating sets, fixed for good, and what they leave of the instance."""
    left = {n: c for n, c in counts.items() if c}
    fixed: list[Group] = []
    changed = True
    while changed:
        changed = False
        for n in sorted(left, reverse=True):
            while left.get(n):
                room, have = capacity - n, left[n]
                fits = sorted(x for x, c in left.items() if x <= room and (x != n or c > 1))
                if not fits:
                    fixed.append((have, [(n, 1)]))
                    del left[n]
                    changed = True
                    break
                best = fits[-1]
                if best != room and 2 * fits[0] <= room and _reachable(fits, room) > best:
                    break
                pairs = have // 2 if best == n else min(have, left[best])
                fixed.append((pairs, [(n, 2)] if best == n else [(n, 1), (best, 1)]))
                for x in (n, best):
                    left[x] -= pairs
                for x in {n, best}:
                    if not left[x]:
                        del left[x]
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing, a run of equal pieces at a time."""
    bins: dict[int, list[Group]] = {}
    rooms: list[int] = []

    def put(room: int, group: Group) -> None:
        if room not in bins:
            bisect.insort(rooms, room)
        bins.setdefault(room, []).append(group)

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            at = bisect.bisect_left(rooms, n)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // n
            if at < len(rooms):
                many, held = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                many, held = -(-todo // each), []
            full = min(many, todo // each)
            todo -= full * each
            if full:
                put(room - each * n, (full, [*held, (n, each)]))
            if full < many:
                if todo:
                    put(room - todo * n, (1, [*held, (n, todo)]))
                    full, todo = full + 1, 0
                if full < many:
                    put(room, (many - full, held))
    return [g for gs in bins.values() for g in gs]


def pack_counts(counts: dict[int, int], capacity: int) -> list[Group]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


class Plan:
    """Where the pieces of each length go, by rank: runs of ranks over ``many`` sequences from ``base`` on, copies stacked."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.first = np.zeros(capacity + 2, np.int64)  # ranks before each length, all lengths in one row of numbers
        for n, c in counts.items():
            self.first[n + 1] = c
        self.first = np.cumsum(self.first)
        taken, base, rows = dict.fromkeys(counts, 0), 0, []
        for many, held in pack_counts(counts, capacity):
            offset = 0
            for n, copies in held:
                rows.append((self.first[n] + taken[n], many, base, offset, n))
                taken[n] += many * copies
                offset += n * copies
            base += many
        assert taken == counts
        rows.sort()
        self.sequences = base
        self.at, self.many, self.base, self.offset, self.length = np.array(rows, np.int64).reshape(-1, 5).T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = self.first[length] + rank
        row = np.searchsorted(self.at, g, side="right") - 1
        q = g - self.at[row]
        return self.base[row] + q % self.many[row], self.offset[row] + q // self.many[row] * self.length[row]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), strict=True):
                ids += END
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], [x.split()[0] for x in _PIECES.split(", ")])

    return run


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the pieces of each length within a task whose rows are sorted by length."""
    task, last, held = TaskContext.get().partitionId(), -1, 0
    for b in batches:
        n = b.column(3).to_numpy()
        if not len(n):
            continue
        starts = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
        sizes = np.diff(np.r_[starts, len(n)])
        local = np.arange(len(n)) - np.repeat(starts, sizes)
        if n[0] == last:
            local[: sizes[0]] += held
        last, held = n[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), task, np.int32)), pa.array(local)], [*b.schema.names, "task", "local"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs(doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.table(own.mapInArrow(_pieces(tokenizer, capacity), _PIECES), "pieces")
    order = ["length", "doc_id", "piece", "ids_crc32", "start"]
    sorted_ = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = scratch.table(sorted_.mapInArrow(_ranks, f"{_PIECES}, task int, local long"), "ranked")
    # A task holds a range of lengths, so this has at most as many rows as there are tasks and lengths together.
    scratch.only("ranked")
    runs = ranked.groupBy("length", "task").agg(F.count("*").alias("n")).orderBy("length", "task").collect()
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in runs:
        before[r.length, r.task] = counts.get(r.length, 0)
        counts[r.length] = counts.get(r.length, 0) + r.n
    plan = spark.sparkContext.broadcast((Plan(counts, capacity), before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = plan.value
        for b in batches:
            n, task = b.column(3).to_numpy(), b.column(5).to_numpy()
            base = np.fromiter(map(before.__getitem__, zip(n.tolist(), task.tolist(), strict=True)), np.int64, len(n))
            seq, offset = own.place(n, base + b.column(6).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")
