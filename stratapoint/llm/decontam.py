"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

A text is lower-cased (A-Z) and its words are runs of ASCII letters, digits and non-ASCII characters. Every ``n``
consecutive words of a benchmark item are a window; an item of fewer words, but not none, is one window. The windows are
the keys of a hash set, sorted hashes with the text beside them, that is broadcast to all tasks; a task scans runs of words
that occur in the benchmark at all, looks up their windows and verifies each hit word by word. No shuffle.

The benchmark's size is measured before it is broadcast: beyond ``block_bytes`` it is dealt into blocks of about that
size by a hash of its rows (a single item is not cut), and the corpus passes through one scan after another, each with one
block. A stage holds at most ``CHAIN`` blocks; then its result is written, and the blocks are given back.

Null text has no words; a null item_id reads as the string ``null``; rows that repeat an item_id are one item with several
texts. An empty benchmark hits nothing. Long documents are scanned whole. Repeated documents are judged one by one. Further columns pass through; this
operator's own are named ``n_words``, ``hit_spans`` (binary, pairs of 32-bit word numbers), ``hit_items`` and ``n_hit``, and replace columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratapoint.llm.text import ALNUM, claim
from stratapoint.runtime import Scratch, ship

#: Bytes of benchmark text in a block (a worker holds about seven times as much for it), and blocks that one stage holds.
BLOCK_BYTES, CHAIN = 8 << 20, 3
ADDED = ("hit_spans", "hit_items", "n_words", "n_hit")
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: bytes | str | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(ALNUM).split()


class Windows:
    """The windows of a block of items: sorted hashes, and the normalised text that verifies a hit.

    A window takes about 20 bytes and its text, not a Python object.
    """

    def __init__(self, items: list[tuple[str, bytes | None]], n: int):
        self.names = [i for i, _ in items]
        self.words: set[bytes] = set()
        parts, hashes, where, owner = [], [], [], []
        at = 0
        for k, (_, text) in enumerate(items):
            w = words_of(text)
            if not w:
                continue
            self.words.update(w)
            starts = np.cumsum([0, *(len(x) + 1 for x in w)])
            whole = b" ".join(w)
            for i in range(max(1, len(w) - n + 1)):
                a, b = int(starts[i]), int(starts[min(i + n, len(w))]) - 1
                hashes.append(xxhash.xxh3_64_intdigest(whole[a:b]))
                where.append((at + a, at + b))
                owner.append(k)
            parts.append(whole)
            at += len(whole)
        self.text = b"".join(parts)
        h, at, own = np.array(hashes, np.uint64), np.array(where, np.int64).reshape(-1, 2), np.array(owner, np.int64)
        order = np.lexsort((own, h))
        h, at, own = h[order], at[order], own[order]
        keep = np.ones(len(h), bool)
        for i in np.flatnonzero((h[1:] == h[:-1]) & (own[1:] == own[:-1])).tolist():  # an item that repeats a window
            keep[i + 1] = self._text(at[i]) != self._text(at[i + 1])
        self.hashes, self.at, self.owner = h[keep], at[keep], own[keep]
        self.sizes = sorted({min(n, len(words_of(t))) for _, t in items} - {0})
        self.runs = re.compile(b"\x01{%d,}" % self.sizes[0]) if self.sizes else None

    def _text(self, at: np.ndarray) -> bytes:
        return self.text[int(at[0]) : int(at[1])]

    def owners(self, window: bytes) -> list[str]:
        """The items that hold a window."""
        h = np.uint64(xxhash.xxh3_64_intdigest(window))
        lo = int(np.searchsorted(self.hashes, h))
        out = []
        while lo < len(self.hashes) and self.hashes[lo] == h:
            if self._text(self.at[lo]) == window:
                out.append(self.names[self.owner[lo]])
            lo += 1
        return out

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that windows cover, merged, and the items they are from."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.runs is None:
            return spans, items
        known = bytes(map(self.words.__contains__, words))
        for run in self.runs.finditer(known):
            a, b = run.span()
            for i in range(a, b):
                for n in self.sizes:
                    if i + n > b:
                        break
                    if owners := self.owners(b" ".join(words[i : i + n])):
                        items.update(owners)
                        if spans and i <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], i + n))
                        else:
                            spans.append((i, i + n))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan(block, text_at: int, names: list[str], drop_from: int | None = None):
    """With drop_from: only documents of fewer items, without their hit spans, in the same pass (a second pass would
    take a second worker beside each of this one's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("windows")
        windows: Windows = block.value
        for b in batches:
            count, hit, spans, items = [], [], [], []
            before = zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True)
            for text, (old, owners) in zip(b.column(text_at), before, strict=True):
                words = words_of(text.as_py())
                s, i = windows.hits(words)
                if old:
                    s = merged(s + [tuple(x) for x in np.frombuffer(old, "<u4").reshape(-1, 2).tolist()])
                count.append(len(words))
                hit.append(sum(z - a for a, z in s))
                spans.append(np.array(s, "<u4").tobytes())
                items.append(sorted(i.union(owners or ())))
            if drop_from is not None:
                at = [k for k, own in enumerate(items) if len(own) < drop_from]
                texts = []
                for k in at:
                    t = b.column(text_at)[k].as_py()
                    s = np.frombuffer(spans[k], "<u4").reshape(-1, 2).tolist()
                    texts.append(remove_spans(t.encode(), s).decode() if s else t)
                cols = [c.take(pa.array(at, pa.int64())) for c in b.columns[: len(names)]]
                cols[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names)
                continue
            added = [pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(count, pa.int64()), pa.array(hit, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *added], [*names, *ADDED])

    return run


def _blocks(benchmark: DataFrame, n: int, block_bytes: int) -> tuple[int, Callable[[int], Broadcast]]:
    """How many blocks the benchmark makes, and what broadcasts one of them."""
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text"))
    size = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    many = max(1, -(-size // block_bytes))

    def block(k: int) -> Broadcast:
        part = own if many == 1 else own.where(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k)
        return benchmark.sparkSession.sparkContext.broadcast(Windows([(r.item, None if r.text is None else bytes(r.text)) for r in part.collect()], n))

    return many, block


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(text, ...) with hit_spans, hit_items, n_words and n_hit (words hit)."""
    return _scans(docs, benchmark, n, block_bytes, None)


def _scans(docs: DataFrame, benchmark: DataFrame, n: int, block_bytes: int, drop_from: int | None) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    own = {x.lower() for x in ADDED}
    names = [c for c in docs.columns if c.lower() not in own]
    text_at = [c.lower() for c in names].index("text")
    out = docs.select(*[F.col(f"`{x}`") for x in names], F.lit(None).cast("binary").alias("hit_spans"), F.lit(None).cast("array<string>").alias("hit_items"))
    schema = StructType([*out.schema.fields, StructField("n_words", LongType()), StructField("n_hit", LongType())])
    many, block = _blocks(benchmark, n, block_bytes)
    scratch, sent = Scratch(spark), []
    for k in range(many):
        sent.append(block(k))
        out = out if k == 0 else out.drop("n_words", "n_hit")
        if k + 1 == many and drop_from is not None:
            return out.mapInArrow(_scan(sent[-1], text_at, names, drop_from), StructType(schema.fields[: len(names)]))
        out = out.mapInArrow(_scan(sent[-1], text_at, names), schema)
        if len(sent) == CHAIN and k + 1 < many:
            out = scratch.table(out, f"hits-{k}")
            scratch.only(f"hits-{k}")
            for b in sent:
                b.destroy()
            sent = []
    return out


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without its words in these ranges and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(ALNUM))]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, text[end:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, drop_from: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without documents in which windows of at least drop_from items occur, and without the hit spans of the others."""
    return _scans(docs, benchmark, n, block_bytes, drop_from)
