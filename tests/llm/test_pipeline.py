"""The whole pipeline against a brute-force version."""

import re
from collections import Counter

import corpus_pipeline
from stratapoint.llm import langid
from tests.llm import fixtures as fx
from tests.llm.test_operators import crc, ids_of, plain_best_fit


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def without_hits(text, bench):
    """The text without its runs of hit words, and the number of items hit."""
    at = [m.span() for m in WORD.finditer(fx.lower(text))]
    words = [fx.lower(text)[a:z] for a, z in at]
    hit, items = set(), set()
    for item, other in bench:
        own = WORD.findall(fx.lower(other))
        for k in range(max(1, len(own) - 7) if own else 0):
            window = own[k : k + 8]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    items.add(item)
    out, end = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += text[end : at[i][0]]
        end = at[i][1]
    return out + text[end:], len(items)


def test_run(spark, tmp_path):
    """All awkward rows: null ids and texts, repeats, ties, long texts; the texts of cut documents, too."""
    docs = fx.documents(7, 40)
    some = next(t for i, t in docs if i is not None and i < 40 and len(t.split()) > 20)
    bench = [(1, some), (2, "alpha beta one two"), (3, "one two"), (4, " ".join(next(t for i, t in docs if i == 1003).split()[3:14])), (5, None), (6, " ".join(some.split()[5:16]))]
    fx.frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    own = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(own.where(~langid.held_out(own.doc_id)))
    kept = [(i, t) for i, t in docs if (p := model.predict(t))[0] != "und" and p[1] >= corpus_pipeline.MIN_SCORE]
    best = {}
    for i, t in kept:
        best[fx.lower(t)] = max((x for x in (i, best.get(fx.lower(t))) if x is not None), default=None)
    kept = list({(i, fx.lower(t)): (i, t) for i, t in kept if best[fx.lower(t)] == i}.values())
    kept = [row for row, (i, _, head) in zip(kept, fx.jaccard_rows(kept, 5, 80, 100), strict=True) if i == head]
    left = [(i, *without_hits(t, bench)) for i, t in kept]
    assert any(0 < n < 2 for _, _, n in left) and any(n >= 2 for _, _, n in left)
    left = [(i, t) for i, t, n in left if n < 2]
    want = Counter()
    for (i, _), ids in zip(left, ids_of(corpus_pipeline.TOKENIZER, [t for _, t in left]), strict=True):
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[i, k, len(ids[a : a + 2048]), crc(ids[a : a + 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) <= len(plain_best_fit([r.length for r in got], 2048))
    assert all(r.offset + r.length <= 2048 for r in got)


def test_run_on_nothing(spark, tmp_path):
    fx.frame(spark, fx.documents(7, 1)).where("1 = 0").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_stage_keeps_one_row_of_repeats(spark):
    """Rows loaded twice, and equal texts without ids, keep one row; other rows stay."""
    once = [(1, "a b", "x"), (2, "A b", "x"), (3, "c", None), (4, None, "x"), (None, "only here", "x")]
    docs = spark.createDataFrame(once + once + [(3, "C", "y"), (None, "ONLY here", "x")], "doc_id long, text string, source string")
    got = sorted(map(tuple, corpus_pipeline.dedup_exact(spark, docs, "").collect()), key=str)
    assert got == sorted([(2, "A b", "x"), (3, "C", "y"), (4, None, "x"), (None, "ONLY here", "x")], key=str)
