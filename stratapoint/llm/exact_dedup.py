"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z. Misra-Gries summaries of the digests (one per partition, merged
by counter) name at most ``k`` candidates; one more pass counts those exactly, and the verified winners, a table of at
most ``k`` rows, are broadcast so that their copies are resolved on the map side. What is left has no digest in more
than 1/(k+1) of the rows and goes through an ordinary shuffle.

Null text counts as the empty text. A null doc_id never wins against an id; in a group without any id, and for rows that
repeat one id and text, every such row is the row that stays (they are one document). A text is hashed whole, however long. An empty table gives no rows.
Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.llm.rows import tag
from stratapoint.llm.text import LOWER, claim
from stratapoint.runtime import Scratch, ship

#: Counters of a summary; 1,024 rows of 48 bytes are the most that is ever broadcast.
COUNTERS = 1024


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("digests")
    for b in batches:
        texts = [t or b"" for t in b.column(1).to_pylist()]
        d = [hashlib.sha256(t.translate(LOWER)).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tag(t) for t in texts], pa.binary()), pa.array(d, pa.binary())], ["doc_id", "tag", "digest"])


def prune(counts: dict[bytes, int], k: int) -> dict[bytes, int]:
    """Misra-Gries: take the (k+1)-th largest count off all and keep what stays positive."""
    if len(counts) <= k:
        return counts
    off = sorted(counts.values(), reverse=True)[k]
    return {d: n - off for d, n in counts.items() if n > off}


def _summary(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            seen = pc.value_counts(b.column(0))
            for d, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True):
                counts[d] = counts.get(d, 0) + n
            counts = prune(counts, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "n"])

    return run


def heavy_hitters(digests: DataFrame, k: int) -> dict[bytes, int]:
    """At most k digests, among them every one in more than 1/(k+1) of the rows."""
    parts = digests.select("digest").mapInArrow(_summary(k), "digest binary, n long")
    top = parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k + 1).collect()
    return prune({bytes(r.digest): r.n for r in top}, k)


def exact_dedup(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, tag (of the text as it is, see ``rows``) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    table = Scratch(spark).table(own.mapInArrow(_digests, "doc_id long, tag binary, digest binary"), "digests")

    schema = "digest binary, keep_id long, group_size long"
    candidates = spark.createDataFrame([(bytearray(d),) for d in heavy_hitters(table, k)], "digest binary")
    winners = spark.createDataFrame(
        [(r.digest, r.keep_id, r.group_size) for r in table.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).collect() if r.group_size > 1],
        schema,
    )
    heavy = table.join(F.broadcast(winners), "digest").select("doc_id", "tag", "keep_id", "group_size", "digest")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    best = rest.selectExpr(
        "doc_id", "tag", "max(doc_id) over (partition by digest) as keep_id", "count(*) over (partition by digest) as group_size", "digest"
    )
    return heavy.unionByName(best).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "tag"
    )
