"""The corpus operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapoint.llm.decontam import find_contamination
from stratapoint.llm.exact_dedup import exact_dedup
from stratapoint.llm.jaccard_join import jaccard_components
from stratapoint.llm.langid import identify
from stratapoint.llm.licenses import license_scan
from stratapoint.llm.line_dedup import line_dedup_digest
from stratapoint.llm.packing import pack
from stratapoint.llm.quality import importance_resample
from stratapoint.llm.suffix_dedup import suffix_dedup_digest
from stratapoint.llm.token_records import token_records

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir)).drop("tag")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), WORD_TOKENIZER)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), words=3, num=90, den=100).drop("tag")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup_digest(_documents(spark, sf_dir))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(_documents(spark, sf_dir), BYTE_TOKENIZER).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_items = F.size("hit_items").cast("long")
    return found.select(
        "doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated")
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt")))
    return license_scan(_documents(spark, sf_dir).select("doc_id", path.alias("path"), "text")).drop("text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_records": op7_token_records,
    "op8_decontamination": op8_decontamination,
    "op9_licenses": op9_licenses,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS k FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY k) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY k) AS kept, sha256(k) AS text_sha256
        FROM t""",
    "op5_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g
              FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
        c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT c.doc_id, e.y FROM c JOIN e ON c.r = e.x)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(r) FROM c WHERE c.doc_id = d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id)""",
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g
              FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 - 99 AS BIGINT))) AS i FROM d WHERE len(h) >= 200)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
        n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
        s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM s GROUP BY doc_id, k),
        p AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans),
        o AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS head
              FROM p JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN o USING (doc_id)""",
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS g, least(8, len(w)) AS n
            FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 7))) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        grams AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, grams.n, item FROM grams JOIN windows USING (g, n)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT k.*, top IS NOT NULL AND top <> doc_id AS gone FROM k LEFT JOIN f USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
}
