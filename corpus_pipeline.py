"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; ``run`` writes every stage's result
as Parquet in the shared folder and reads it again.

1. language_id: documents in no known language go (no letters, or far from every profile). The models learn from the
   labelled rows that are not held out.
2. exact_dedup: of equal texts, the row with the largest doc_id stays; of rows that also repeat the doc_id (or all have none), the
   least row by all columns.
3. near_dedup: five-word shingles, Jaccard 0.8 or more; the smallest doc_id of each group stays.
4. decontamination: documents with passages of two or more benchmark items go; of others the passages themselves go.
5. packing: sequences of at most 2048 ids.

Rows with a null text, an empty one or one without letters go in stage 1. A null doc_id loses against any id in stages 2 and
3; where all have none, one row of equal texts stays, and of documents that are only near, all (they have no smallest id).
Rows that repeat doc_id and text become one; rows that repeat a doc_id alone are documents of their own. Very long texts
take the same way as others. Columns named like those that operators add stay what they are, but for ``lang_pred``,
``score`` (stage 1), ``hit_spans``, ``hit_items``, ``n_words`` and ``n_hit`` (stage 4), which are replaced or dropped. Empty
tables give empty tables.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.llm import decontam, exact_dedup, jaccard_join, langid, packing, rows
from stratapoint.runtime import Scratch

#: Documents below this score are in no language of the labels: their n-grams are on hardly any profile.
MIN_SCORE = 0.25
TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = langid.predict(docs, langid.fit(docs.where(~langid.held_out(F.col("doc_id")))))
    return known.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text; rows that repeat doc_id and text are ties, of which the least by all columns stays."""
    scratch, names = Scratch(spark), docs.columns
    found = scratch.table(exact_dedup.exact_dedup(docs), "found")
    left = rows.without(docs, found.where("not kept"))
    tied = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    tied = scratch.table(tied.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__tie")), "tied")
    if tied.isEmpty():
        return left
    text = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    left = left.select("*", F.sha2(text, 256).alias("__digest"))
    tied = F.broadcast(tied) if tied.count() <= rows.BROADCAST_ROWS else tied
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__tie"))
    first = left.join(tied, same).groupBy("doc_id", "__digest").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in names])).alias("first"))
    return left.join(tied, same, "left_anti").select(*[F.col(f"`{c}`") for c in names]).unionByName(first.select("first.*"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(docs, words=5, num=80, den=100)
    return rows.without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Packing uses a tokenizer, which SQL does not have; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = len(Scratch.made)
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.only(name)
        for own in Scratch.made[before:]:  # what the stage's operators wrote for themselves
            own.drop()
    return docs
