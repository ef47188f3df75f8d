"""Quality selection by importance resampling.

Two generative models over hashed n-grams (words, pairs of words, and up to three token shapes; ``buckets`` buckets): one of the target (labelled
documents of quality 1), one of the raw text (all documents). A document's weight is the log ratio of its probability under
the two, summed over all its n-grams, its own counts left out of both (else the labelled documents would win by memory). Sampling without replacement in proportion to the weights is a Gumbel top-k: each
document's key is its log weight plus Gumbel noise made from a hash of its doc_id and a seed, and the ``k`` largest keys
win. ``k`` is a share of the rows; by default the share of quality 1 among the labelled documents, so that noise decides
only between documents that look alike.

The target is fitted on at most ``max_labels`` labelled rows (those with the smallest hash), which bounds the broadcast; the
raw counts cover every document. The k-th key is found without gathering keys: they are range-partitioned, and a task's
number of rows (one figure a task) says which ranks it holds.

Null and empty texts have no n-grams and weight 0. Labels for unknown documents, null labels and repeated labels are
harmless (a document is target if any label of it says quality 1); without any target every weight is 0 and the share 1.
Rows with a null doc_id can be sampled like others; rows that repeat doc_id and text have equal keys, and ties go by
doc_id. Very long texts are counted whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.llm.text import claim, classes, distinct, flat, ngram_hashes, parts
from stratapoint.runtime import Scratch, ship

BUCKETS = 1 << 16
MAX_LABELS = 200_000
#: Counts of equal probability added to either side of a ratio.
PRIOR = 10.0
#: Tokens are words (bytes of 1) and runs of other printing ASCII characters (2).
_KIND = bytes(2 if 32 < c < 127 and not chr(c).isalnum() else 1 if c > 127 or chr(c).isalnum() else 0 for c in range(256))
#: Texts are counted in parts of about so many bytes.
PART_BYTES = 1 << 20


def _hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece between neighbouring starts: whether it is a token, its hash and the hash of its shape.

    A shape says case and digits, or is the characters themselves.
    """
    names, which = distinct(data, starts, pa.large_binary())
    data, at = flat(names)
    first, size = data[at[:-1]], np.diff(at)
    kind = np.frombuffer(_KIND, np.uint8)[first]
    many = lambda low, high: np.add.reduceat((data >= low) & (data <= high), at[:-1], dtype=np.int64)
    digits, upper, lower = many(48, 57), many(65, 90), many(97, 122)
    shapes = [xxhash.xxh3_64_intdigest(x, 1) for x in (b"0", b"A", b"Aa", b"a0", b"a")]
    shape = np.select([digits == size, (upper > 0) & (lower == 0) & (size > 1), (first >= 65) & (first <= 90), digits > 0], np.array(shapes[:4], np.uint64), np.uint64(shapes[4]))
    words = names.to_pylist()
    marks = np.flatnonzero(kind == 2)
    shape[marks] = np.array([xxhash.xxh3_64_intdigest(words[i], 1) for i in marks.tolist()], np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return (kind > 0)[which], word[which], shape[which]


def buckets_by_row(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs, and hashed n-grams (1 to 3) of token shapes, of all texts of a column; which text each is of."""
    data, rows = flat(texts)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    kind = classes(data, _KIND)
    first = np.zeros(len(data) + 1, bool)
    first[1:-1] = kind[1:] != kind[:-1]
    first[rows] = True
    starts = np.flatnonzero(first)
    token, word, shape = _hashes(data, starts)
    word, shape = word[token], shape[token]
    row = (np.searchsorted(rows, starts[:-1][token], side="right") - 1).astype(np.int32)
    found, of = [], []
    for hashes, n in ((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3)):
        last = row[n - 1 :]
        within = row[: len(last)] == last
        grams = ngram_hashes(hashes, n)[within]
        found.append((grams & np.uint64(buckets - 1) if buckets & buckets - 1 == 0 else grams % np.uint64(buckets)).astype(np.int32))
        of.append(last[within])
    return np.concatenate(found), np.concatenate(of)


def buckets_of(text: bytes | None, buckets: int) -> np.ndarray:
    return buckets_by_row(pa.array([text], pa.binary()), buckets)[0]


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``PART_BYTES`` of texts at a time, one row at least."""
    for a, z in parts(flat(b.column(0))[1], PART_BYTES):
        yield b.slice(a, z - a)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        sums = np.zeros((2, buckets), np.int64)
        for b in (part for whole in batches for part in _parts(whole)):
            at, row = buckets_by_row(b.column(0), buckets)
            target = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            sums[0] += np.bincount(at, minlength=buckets)
            sums[1] += np.bincount(at[target[row]], minlength=buckets)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["bucket", "raw", "target"])

    return run


def gumbel(seed: int, doc_id: int | None) -> float:
    u = (xxhash.xxh3_64_intdigest(str(doc_id).encode(), seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


class Ratio:
    """Log of target over raw probability; a document's own n-grams are left out, and rare buckets shrink towards 0."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.raw, self.target = raw.astype(np.float64), target.astype(np.float64)
        self.raw_n, self.target_n = float(raw.sum()), float(target.sum())

    def weights(self, at: np.ndarray, row: np.ndarray, is_target: np.ndarray) -> np.ndarray:
        """Of each text: at are the buckets of all texts' n-grams, row says whose each is."""
        n_rows, buckets = len(is_target), len(self.raw)
        own = np.bincount(row, minlength=n_rows)
        raw_n, target_n = self.raw_n - own, self.target_n - own * is_target
        known = (own > 0) & (raw_n > 0) & (target_n > 0)
        scale = np.divide(target_n, raw_n, out=np.ones(n_rows), where=known)
        key = row.astype(np.int64) * buckets + at
        key = np.sort(key.astype(np.uint32) if n_rows * buckets < 1 << 32 else key)
        new = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
        n = np.diff(np.append(new, len(key)))
        row, at = np.divmod(key[new].astype(np.int64), buckets)
        target = self.target[at] - n * is_target[row]
        raw = (self.raw[at] - n) * scale[row]
        return np.where(known, np.bincount(row, n * np.log((target + PRIOR) / (raw + PRIOR)), n_rows), 0.0)


def importance_resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 7, buckets: int = BUCKETS, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, log_weight, sample_key, kept of every row of docs(doc_id, text); labels: doc_id, quality."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    some = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    some = scratch.table(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels), "labels")
    if share is None:
        n, good = some.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
        share = good / n if good else 1.0
    target = some.where("quality = 1").select("doc_id", F.lit(True).alias("target"))
    counts = own.join(F.broadcast(target), "doc_id", "left").select("text", "target").mapInArrow(_count(buckets), "bucket long, raw long, target long")
    raw, good_n = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # one row a bucket
        raw[r.bucket], good_n[r.bucket] = r.raw, r.target
    model = spark.sparkContext.broadcast(Ratio(raw, good_n))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        ratio = model.value
        for b in (part for whole in batches for part in _parts(whole)):
            ids = b.column(1).to_pylist()
            w = ratio.weights(*buckets_by_row(b.column(0), buckets), b.column(2).fill_null(False).to_numpy(zero_copy_only=False))
            keys = w + np.array([gumbel(seed, i) for i in ids])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(w, pa.float64()), pa.array(keys, pa.float64())], ["doc_id", "log_weight", "sample_key"])

    schema = "doc_id long, log_weight double, sample_key double"
    scored = scratch.table(own.join(F.broadcast(target), "doc_id", "left").select("text", "doc_id", "target").mapInArrow(score, schema), "scored")
    order = [F.desc("sample_key"), F.asc_nulls_last("doc_id")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            at = np.arange(n, n + b.num_rows)
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, task, np.int32)), pa.array(at)], [*b.schema.names, "task", "at"])

    ranked = scratch.table(scored.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{schema}, task int, at long"), "ranked")
    sizes = {r.task: r.n for r in ranked.groupBy("task").agg(F.count("*").alias("n")).collect()}  # one row a task
    k = round(share * sum(sizes.values()))
    cut = F.lit(0)
    before = 0
    for task in sorted(sizes):
        if before < k < before + sizes[task]:
            cut = F.when(F.col("task") == task, F.lit(k - before)).otherwise(cut)
        before += sizes[task]
    full, total = [], 0
    for task in sorted(sizes):
        total += sizes[task]
        if total <= k:
            full.append(task)
    last = max(full, default=-1)
    return ranked.select("doc_id", "log_weight", "sample_key", ((F.col("task") <= last) | (F.col("at") < cut)).alias("kept"))
