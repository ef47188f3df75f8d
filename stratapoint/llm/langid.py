"""Language identification by rank-order n-gram profiles.

A language's profile is the ranked list of its ``size`` most frequent letter n-grams (n = 1 to 3, over lower-cased letters;
any run of other characters is one blank, and no n-gram has a blank in its middle). A document's own ranked list, taken
from its whole text, is held against each profile: an n-gram costs the difference of its two ranks, or ``size`` if the
profile lacks it. The language with the least sum wins (ties: the first name); the score is 1 - sum / (size * n-grams).

Profiles are fitted on a bounded sample of the labelled rows, at most about ``per_language`` documents of each language,
chosen by a hash of their doc_id; counts are summed in Spark and only profiles reach the driver.

A text that is null or has no letter is ``und`` with score 0; so is everything if there are no labelled rows. Rows with a
null lang are not learned from; a null doc_id counts as the empty string where its checksum is asked for. Repeated rows
are judged one by one. An empty table gives no rows. Very long texts are counted whole, by one pass over their code points. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapoint.llm.text import claim
from stratapoint.runtime import ship

SIZE = 300
PER_LANGUAGE = 5000
UNKNOWN = "und"
_BLANK = 32


@cache
def _symbols() -> np.ndarray:
    """Code point -> lower-case letter, or a blank."""
    out = np.full(0x110000, _BLANK, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct n-grams of a text, and how often each occurs."""
    s = _symbols()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    s = np.concatenate(([_BLANK], s, [_BLANK])).astype(np.uint32)
    s = s[np.r_[True, (s[1:] != _BLANK) | (s[:-1] != _BLANK)]]
    if len(s) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits = 8 if s.max() < 256 else 21
    a = s.astype(np.uint32 if bits == 8 else np.uint64)
    one = a[a != _BLANK]
    two = a[:-1] << a.dtype.type(bits) | a[1:]
    three = (two[:-1] << a.dtype.type(bits) | a[2:])[a[1:-1] != _BLANK]
    codes, n = np.unique(np.concatenate((one, two, three)), return_counts=True)
    if bits == 8:  # the same codes for all texts
        c = codes.astype(np.uint64)
        codes = (c >> np.uint64(16)) << np.uint64(42) | (c >> np.uint64(8) & np.uint64(255)) << np.uint64(21) | c & np.uint64(255)
    return codes, n


def ranked(codes: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The codes of the most frequent n-grams, most frequent first, ties by code."""
    if len(n) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        codes, n = codes[n >= least], n[n >= least]
    return codes[np.lexsort((codes, -n))][:size]


class Profiles:
    def __init__(self, by_lang: dict[str, list[int]], size: int):
        self.size, self.langs, self.tables = size, sorted(by_lang), []
        for lang in self.langs:
            codes = np.array(by_lang[lang], np.uint64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def distances(self, text: str) -> tuple[np.ndarray, int]:
        """Out-of-place sums by language, and the number of ranked n-grams."""
        own = ranked(*ngrams(text), self.size)
        rank = np.arange(len(own))
        out = []
        for codes, ranks in self.tables:
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            out.append(int(np.where(codes[at] == own, np.abs(ranks[at] - rank), self.size).sum()))
        return np.array(out, np.int64), len(own)

    def predict(self, text: str | None) -> tuple[str, float]:
        d, n = self.distances(text or "")
        if not n or not len(d):
            return UNKNOWN, 0.0
        best = int(d.argmin())
        return self.langs[best], 1.0 - float(d[best]) / (self.size * n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("languages")
    for b in batches:
        codes, counts = defaultdict(list), defaultdict(list)
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            c, n = ngrams(text.as_py() or "")
            codes[lang].append(c)
            counts[lang].append(n)
        for lang in codes:
            c, at = np.unique(np.concatenate(codes[lang]), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts[lang]), len(c)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])


def fit(labelled: DataFrame, size: int = SIZE, per_language: int = PER_LANGUAGE) -> Profiles:
    """labelled: doc_id, text, lang."""
    ship(labelled.sparkSession)
    own = labelled.where(F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    totals = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Profiles({}, size)
    share = F.lit(0)
    for lang, n in totals.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1_000_000, 1_000_000 * per_language // n + 1))).otherwise(share)
    sample = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    sums = sample.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    by_lang: dict[str, list[int]] = defaultdict(list)
    for r in sums.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        by_lang[r.lang].append(r.code)
    return Profiles(by_lang, size)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


ADDED = ("lang_pred", "score")


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs(text, ...) with lang_pred and score, which replace columns of those names."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(profiles)
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])
    at = [c.lower() for c in own.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("languages")
        for b in batches:
            got = [model.value.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*b.schema.names, *ADDED])

    return own.mapInArrow(run, own.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def identify(docs: DataFrame, size: int = SIZE, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from the rows that are not held out, and predict all: docs with held_out, lang_pred, score."""
    out = held_out(F.col("doc_id"))
    return predict(docs, fit(docs.where(~out), size, per_language)).withColumn("held_out", out)
