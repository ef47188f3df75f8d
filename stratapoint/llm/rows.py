"""Telling rows of a table of texts apart, and taking rows out of it.

A row is its doc_id and a tag, the 128-bit digest of its text (null as empty): rows that share an id, or have none, are
apart unless they also repeat the text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapoint.runtime import Scratch

#: Up to so many rows of ids and tags (about 50 bytes each) are broadcast; more go through a shuffle.
BROADCAST_ROWS = 500_000


def tag(text: bytes | None) -> bytes:
    return hashlib.md5(text or b"", usedforsecurity=False).digest()


def tag_of(text: Column) -> Column:
    """The same by Spark."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) without the rows that gone(doc_id, tag) names."""
    gone = Scratch(docs.sparkSession).table(gone.select(F.col("doc_id").alias("gone_id"), F.col("tag").alias("gone_tag")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = docs["doc_id"].eqNullSafe(F.col("gone_id")) & (tag_of(docs["text"]) == F.col("gone_tag"))
    return docs.join(gone, same, "left_anti")
