"""The corpus operators on small tables with every awkward row, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratapoint.llm import decontam, exact_dedup, langid, licenses, line_dedup, packing, quality, rows, suffix_dedup, token_records, tokens
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def docs():
    return fx.documents()


def table(df):
    return Counter(map(tuple, df.collect()))


def ids_of(name, texts):
    own = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids + [0] for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_exact_dedup(spark, docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[fx.lower(t)].append(i)
    want = Counter()
    for i, t in docs:
        own = groups[fx.lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        want[i, keep, len(own), i == keep, hashlib.sha256(fx.lower(t).encode()).hexdigest()] += 1
    for k in (1, 1024):  # with one counter nearly nothing is heavy
        got = exact_dedup.exact_dedup(fx.frame(spark, docs), k).drop("tag")
        assert table(got) == want
    assert exact_dedup.exact_dedup(fx.frame(spark, docs).where("1 = 0")).count() == 0


def test_misra_gries_keeps_heavy_keys():
    counts = {}
    stream = [b"a", b"b"] * 40 + [str(i).encode() for i in range(100)] + [b"a"] * 30
    for x in stream:
        counts[x] = counts.get(x, 0) + 1
        counts = exact_dedup.prune(counts, 4)
    assert b"a" in counts


def test_without(spark, docs):
    df = fx.frame(spark, docs)
    gone = exact_dedup.exact_dedup(df).where("not kept")
    left = [(r.doc_id, r.text) for r in rows.without(df, gone).collect()]
    assert len({fx.lower(t) for _, t in left}) == len({fx.lower(t) for _, t in docs}) and Counter(left)[3003, "twice the row"] == 2


ODD = ["ΑΣ. Σ İstanbul! 'S it's I'LL <|endoftext|> áb  x   y \n z\t.,! ..., 12ab3 ٣ \x1c q", "", "   ", "a  b", "word.\n\nNext,  two", "don't, 'tis.", "½ x², _a_, 日本 語.", "A, b. C.\nD \n E", "a\0b, c"]
ODD += ["one . two", "one , two", "a . ", "Bonjour , monde", "1 . 2", "\u0c87\u0f4d", "\n", " \n", "\n a", "a\n", "a\n\u0301b", " \u0301", "<|startoftext|>a<|endoftext|>", "<|endoftext", "x" * 70_000, "long " * 40_000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    """On awkward strings and on 200,000 random ones: stops among spaces, any Unicode, special tokens."""
    rng = __import__("random").Random(name)
    plain = [*"  \n.,", *"abcXY12'!_-", "\t", "  ", "the", "Stone", " . ", " , ", ". ", ", ", ".\n", "'s", "'LL"]
    marks = [*map(chr, (0, 0x1C, 0x85, 0xA0, 0xAD, 0x130, 0x131, 0x149, 0x300, 0x301, 0x307, 0x345, 0x3A3, 0x3C2, 0xC87, 0xF4D, 0x1E9E, 0x2028, 0x200B, 0x3000, 0x1F600, 0xFB01))]
    special = ["<|endoftext|>", "<|startoftext|>", "<|", "|>"]

    def text(kind):
        n = rng.randrange(1, 14)
        if kind == 0:
            return "".join(rng.choice(plain) for _ in range(n))
        if kind == 1:
            return "".join(rng.choice(plain) if rng.random() < 0.5 else rng.choice(marks) for _ in range(n))
        if kind == 2:
            return "".join(rng.choice(plain) if rng.random() < 0.4 else chr(c if not 0xD800 <= (c := rng.randrange(1, 0x11000)) < 0xE000 else 32) for _ in range(n))
        return "".join(rng.choice(special) if rng.random() < 0.3 else rng.choice(plain) for _ in range(n))

    texts = ODD + [text(i % 4) for i in range(200_000)]
    enc = tokens.encoder(name)
    for a in range(0, len(texts), 20_000):
        part = texts[a : a + 20_000]
        for t, want in zip(part, ids_of(name, part), strict=True):
            assert np.frombuffer(enc.encode(t) + tokens.END, "<u4").tolist() == want, t[:100]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_columns_are_encoded_as_texts(name, monkeypatch):
    """A column has the library's ids for each text, whatever its slices, and looks a segment up once, not at each place."""
    rng = __import__("random").Random(name)
    plain = ["a", "Zé", "ß", "×", "÷", "ª", "ÿ", "Ā", "日", "’", *".,!'()3 \n~^_\0\t\x1c\x85\xa0\u3000", "  ", "«", "<|endoftext|>"]
    texts = [None, "", *ODD, *("".join(rng.choice(plain) for _ in range(rng.randrange(9))) for _ in range(50_000)), None]
    want = [np.array(x[:-1], "<u4").tobytes() for x in ids_of(name, texts)]
    enc = tokens.encoder(name)
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        assert [x for a in range(0, len(texts), 7001) for x in enc.encode_all(column.slice(a, 7001))] == want
    monkeypatch.setattr(tokens, "_SEGMENTS", 3)
    assert enc.encode_all(column.slice(1, 300)) == want[1:301] and enc.encode_all(column[:0]) == []
    monkeypatch.undo()
    monkeypatch.setattr(tokens._Pieces, "LIMIT", 200)
    assert enc.encode_all(column) == want
    looked = []
    enc = tokens.Encoder(public_tokenizers.path(name), "word" in name)
    monkeypatch.setattr(enc, "pieces", type("Looked", (), {"special": [], "__getitem__": lambda _, x: looked.append(x) or b"abcd"})())
    assert enc.encode_all(pa.array(["one two, two\ntwo " * 1000] * 3)) and len(looked) < 10


def test_packing(spark, docs):
    got = packing.pack(fx.frame(spark, docs), "word_bpe_49k.json", 64).collect()
    want = Counter()
    for (i, _), ids in zip(docs, ids_of("word_bpe_49k.json", [t for _, t in docs]), strict=True):
        for k, a in enumerate(range(0, len(ids), 64)):
            want[i, k, a, len(ids[a : a + 64]), crc(ids[a : a + 64])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= len(plain_best_fit([r.length for r in got], 64))
    assert packing.pack(fx.frame(spark, docs).where("1 = 0"), "word_bpe_49k.json").count() == 0


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if sum(b) + n <= capacity]
        (max(fit, key=sum) if fit else bins.append([]) or bins[-1]).append(n)
    return bins


def test_plans_are_whole_and_good():
    rng = np.random.default_rng(0)
    for _ in range(40):
        counts = dict(Counter(rng.integers(1, 65, 400).tolist())) | {64: 3}
        plan = packing.Plan(counts, 64)
        seen = defaultdict(list)
        for n, c in counts.items():
            for s, o in zip(*plan.place(np.full(c, n), np.arange(c)), strict=True):
                seen[int(s)].append((int(o), n))
        for own in seen.values():
            own.sort()
            assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 64
        assert sum(map(len, seen.values())) == sum(counts.values()) and plan.sequences <= len(plain_best_fit(list(Counter(counts).elements()), 64)) + 1


def test_reduction_fixes_only_dominating_sets():
    fixed, left = packing.reduce_instance({60: 2, 40: 3, 30: 1, 7: 1}, 100)
    assert (2, [(60, 1), (40, 1)]) in fixed and not left.get(60)
    fixed, left = packing.reduce_instance({50: 1, 30: 1, 15: 1, 6: 1}, 100)
    assert left.get(50) == 1 or any(50 in dict(g) for _, g in fixed)


def test_best_fit_is_the_plain_algorithm():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = dict(Counter(rng.integers(1, 30, 80).tolist()))
        bins = plain_best_fit(list(Counter(counts).elements()), 50)
        got = Counter()
        for many, held in packing.best_fit(counts, 50):
            got[tuple(sorted((n for n, c in held for _ in range(c)), reverse=True))] += many
        assert sum(got.values()) == len(bins) and Counter(sum(x) for x in got.elements()) == Counter(map(sum, bins))


def test_records(spark, docs, tmp_path):
    df = fx.frame(spark, docs)
    got = token_records.token_records(df, "byte_bpe_50k.json", str(tmp_path / "r")).collect()
    ids = dict()
    order = sorted(zip(docs, ids_of("byte_bpe_50k.json", [t for _, t in docs]), strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), crc(x)) for (i, _), x in order)
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [i for (i, _), _ in order]
    index = token_records.build_index(spark, str(tmp_path / "r"))
    some = index.where("doc_id % 7 = 3")
    ids = {r.doc_id: list(r.ids) for r in token_records.read_records(spark, str(tmp_path / "r"), some).collect() if r.doc_id != 3003}
    want = {i: x for (i, _), x in order if i is not None and i % 7 == 3 and i != 3003}
    assert ids == want
    assert token_records.token_records(df.where("1 = 0"), "byte_bpe_50k.json").count() == 0


def test_broken_records_are_found():
    good = token_records.frame(5, np.array([1, 2, 0], "<u4").tobytes(), 2) + token_records.frame(None, np.array([0], "<u4").tobytes(), 4)
    assert [(a, i, x.tolist()) for a, _, i, x in token_records.records(good)] == [(0, 5, [1, 2, 0]), (32, None, [0])]
    for at in (0, 9, 15, 22, 28, 33):
        with pytest.raises(ValueError):
            list(token_records.records(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]))


def plain_decontamination(docs, bench):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fx.lower(t))
    windows = defaultdict(set)
    for item, text in bench:
        w = word(text)
        for i in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[i : i + 8])].add(str(item) if item is not None else "null")
    out = Counter()
    for i, t in docs:
        w, hit, items = word(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= own
        out[i, len(w), len(hit), tuple(sorted(items))] += 1
    return out


def test_decontamination(spark, docs):
    long = " ".join(t for _, t in docs[:3] if t)
    bench = [(1, " ".join(long.split()[:12])), (2, "SAME text, again"), (3, None), (4, ""), (None, "one two"), (5, "one two three"), (6, "x" * 5000), (6, "no id at all")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    for block_bytes in (1 << 20, 40):  # one block, and so many that stages are cut
        found = decontam.find_contamination(fx.frame(spark, docs), b, 8, block_bytes)
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.hit_items)) for r in found.collect()) == plain_decontamination(docs, bench)
    empty = decontam.find_contamination(fx.frame(spark, docs), b.where("1 = 0"))
    assert empty.agg(F.sum("n_hit"), F.count("*")).first() == (0, len(docs))
    left, again = (decontam.decontaminate(fx.frame(spark, docs), b, block_bytes=size) for size in (1 << 20, 40))
    assert table(left) == table(again)
    assert left.columns == [c for c in fx.frame(spark, docs).columns if c != "hit_items"]
    assert plain_decontamination([(r.doc_id, r.text) for r in left.where("doc_id >= 2000 and doc_id < 2006").collect()], [(2, "same text again")]) == Counter({(2000 + k, 0, 0, ()): 1 for k in range(6)})


def test_line_dedup(spark):
    long = "This line is certainly longer than forty characters, number {}"
    docs = [(i, "\n".join([f"own {i}", long.format(1).upper() if i % 2 else "\t" + long.format(1) + " ", long.format(i % 3), "", "short"])) for i in range(12)]
    docs += [(20, None), (21, ""), (None, long.format(1)), (22, "\n" + long.format(1) + "\n" + long.format(1) + "\n"), (22, long.format(1)), (5, long.format(7)), (23, "é" * 39), (24, "é" * 40)]
    docs += [(i, "é" * 40) for i in range(30, 35)]
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[fx.lower(line).strip(strip)].add(i)
    want = Counter()
    for i, t in docs:
        lines = (t or "").split("\n")
        stays = []
        for line in lines:
            k = fx.lower(line).strip(strip)
            top = max((x for x in holders[k] if x is not None), default=None)
            if len(k) < 40 or len(holders[k]) < 5 or i == top:
                stays.append(line)
        want[i, len(lines), len(lines) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest()] += 1
    df = fx.frame(spark, docs)
    assert table(line_dedup.line_dedup_digest(df)) == want
    try:  # batches of a row, and one task that sees all or sixteen that see little
        for batch, parts in ((1, 1), (1, 16), (3, 4)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert table(line_dedup.line_dedup_digest(df)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    texts = line_dedup.apply_bitmaps(df, line_dedup.line_dedup(df))
    assert Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in texts.collect()) == Counter({(k[0], k[3]): 1 for k in want}) | Counter()
    assert line_dedup.line_dedup_digest(df.where("1 = 0")).count() == 0


def plain_suffix_dedup(docs, length):
    order = sorted({(i is not None, i or 0, hashlib.md5((t or "").encode()).digest(), (t or "").encode()) for i, t in docs})
    seen, result = set(), {}
    for has, i, _, t in order:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            g = t[s : s + length]
            if g in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(g)
        kept = bytes(c for c, x in zip(t, gone, strict=True) if not x)
        result[i if has else None, t] = (len(t), len(t) - len(kept), len([p for p in bytes(gone).split(b"\0") if p]), hashlib.sha256(kept).hexdigest())
    return Counter((i, *result[i, (t or "").encode()]) for i, t in docs)


def test_suffix_dedup(spark, docs):
    extra = [(50, "é" * 90 + "tail"), (51, "head" + "é" * 90), (52, "ab" * 200)]
    rng = __import__("random").Random(5)
    passage = " ".join(fx.words(rng, 40))
    extra += [(60 + k, "".join(rng.choice("xy ") for _ in range(rng.randrange(30))) + passage[rng.randrange(60) : 100 + rng.randrange(140)] + "".join(rng.choice("xy ") for _ in range(40))) for k in range(150)]  # one hot anchor
    for length in (40, 100):
        df = fx.frame(spark, docs + extra)
        assert table(suffix_dedup.suffix_dedup_digest(df, length)) == plain_suffix_dedup(docs + extra, length)
    assert suffix_dedup.suffix_dedup_digest(df.where("1 = 0")).count() == 0


def test_anchors_see_every_window_once(monkeypatch):
    """In pieces of any size; equal windows have equal keys."""
    rng = __import__("random").Random(6)
    texts = [" ".join(fx.words(rng, rng.randrange(300))).encode() for _ in range(12)] + [b"ab" * 400, b"", b"x" * 99, b"x" * 100]
    texts += [texts[0] + texts[1], texts[0][7:]]
    for slice_bytes in (700, 1 << 19):
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
        keys, seen = {}, Counter()
        for whole, ends, owner, place in suffix_dedup._slices(texts, 100):
            assert len(whole) <= slice_bytes
            starts = np.r_[0, ends[:-1]]
            for key, first, last, _ in zip(*suffix_dedup.anchors(whole, ends, 100), strict=True):
                k = np.searchsorted(ends, first, side="right")
                for s in range(first, last + 1):
                    seen[owner[k], s - starts[k] + place[k]] += 1
                    assert keys.setdefault(whole[s : s + 100], key) == key
        assert seen == Counter({(i, s): 1 for i, t in enumerate(texts) for s in range(len(t) - 99)})


def test_suffix_arrays():
    from stratapoint.llm.suffix_array import permuted_prefixes, suffix_arrays

    rng = np.random.default_rng(1)
    for _ in range(40):
        strings = []
        for _ in range(int(rng.integers(1, 20))):
            x = rng.integers(1, 4, int(rng.integers(0, 50))).tolist()
            strings.append((x[: len(x) // 3] * 3 if rng.random() < 0.5 else x) + [0])
        n = np.array(list(map(len, strings)))
        t = np.zeros((len(strings), n.max()), np.int64)
        for i, x in enumerate(strings):
            t[i, : len(x)] = x
        sa = suffix_arrays(t, n)
        prefixes = permuted_prefixes(t, n, sa)
        for i, x in enumerate(strings):
            want = sorted(range(len(x)), key=lambda k: x[k:])
            assert sa[i, : len(x)].tolist() == want
            for a, b in zip(want, want[1:], strict=False):
                common = next(k for k in range(len(x)) if x[a + k] != x[b + k])
                assert prefixes[i, b] == common


def test_language_id(spark):
    rng = __import__("random").Random(1)
    lexicon = {"aa": "the of and house water green stone night".split(), "bb": "der die und haus wasser gruen stein nacht".split(), "cc": "ла на дом вода камень ночь".split()}
    made = [(i, " ".join(rng.choice(lexicon[lang]) for _ in range(rng.randrange(3, 60))), lang) for i in range(300) for lang in [rng.choice(list(lexicon))]]
    made += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "the of and", None), (None, "der die und", "bb"), (None, None, None)]
    df = spark.createDataFrame([(i, t, lang, "x", 0.5) for i, t, lang in made], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(df).collect()
    assert len(got) == len(made)
    held = [r for r in got if r.held_out and r.lang and r.doc_id < 900]
    assert len(held) > 40 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (900, 901)} == {(900, "und", 0.0), (901, "und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.where("1 = 0")).count() == 0


def test_quality(spark):
    rng = __import__("random").Random(2)
    good = [(i, " ".join(fx.words(rng, 50)), 1) for i in range(150)]
    bad = [(500 + i, " ".join(w.upper() + "!!" for w in fx.words(rng, 50)), 0) for i in range(50)]
    df = fx.frame(spark, [(i, t) for i, t, _ in good + bad] + [(None, None), (900, "")])
    labels = spark.createDataFrame([(i, q) for i, _, q in good[:100] + bad[:30]] + [(None, 1), (7, None), (99999, 0)], "doc_id long, quality int")
    got = quality.importance_resample(df, labels, share=0.75).collect()
    assert len(got) == 202 and sum(r.kept for r in got) == round(0.75 * 202)
    kept = {r.doc_id for r in got if r.kept}
    assert len(kept & {i for i, _, _ in good}) >= 140 and len(kept & {i for i, _, _ in bad}) <= 10
    least = min(r.sample_key for r in got if r.kept)
    assert all(r.sample_key <= least for r in got if not r.kept)
    assert all(r.kept and r.log_weight == 0 for r in quality.importance_resample(df, labels.where("1 = 0")).collect())
    assert quality.importance_resample(df.where("1 = 0"), labels).count() == 0


def plain_language(learned, texts, size):
    """(prediction, score) of each text, from the definition."""

    def grams(text):
        s = "".join((low if len(low := c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
        s = re.sub(" +", " ", f" {s} ")
        out = Counter(x for x in s if x != " ")
        out.update(s[i : i + 2] for i in range(len(s) - 1))
        out.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
        return out if len(s) > 1 else Counter()

    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    rank = lambda counts: sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]
    by_lang = defaultdict(Counter)
    for text, lang in learned:
        by_lang[lang].update(grams(text))
    profiles = {lang: {g: i for i, g in enumerate(rank(c))} for lang, c in by_lang.items()}
    out = []
    for text in texts:
        own = rank(grams(text))
        sums = {lang: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(sums), key=sums.get) if own and sums else None
        out.append(("und", 0.0) if best is None else (best, 1 - sums[best] / (size * len(own))))
    return out


def test_language_id_is_its_definition(spark, docs):
    rng = __import__("random").Random(9)
    made = [(i, t, ["aa", "bb", None][(i or 0) % 3]) for i, t in docs] + [(5000 + k, "".join(rng.choice("aébçß ñÅ.İǅ日") for _ in range(rng.randrange(90))), rng.choice(["aa", "bb", "cc"])) for k in range(60)]
    made += [(6000, "długi " * 30_000, "cc")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    for size in (12, 300):
        learned = [(t, lang) for i, t, lang in made if lang and zlib.crc32(str("" if i is None else i).encode()) % 4 != 2]
        want = plain_language(learned, [t for _, t, _ in made], size)
        got = langid.identify(df, size).collect()
        assert Counter((r.doc_id, r.text, r.lang_pred, round(r.score, 9)) for r in got) == Counter((i, t, lang, round(score, 9)) for (i, t, _), (lang, score) in zip(made, want, strict=True))


def test_quality_is_its_definition(spark, docs):
    """Weights, keys and the choice, from counts of every n-gram by bucket."""
    import math

    import xxhash

    buckets, seed = 512, 3
    labels = [(i, int(i % 3 == 0)) for i, _ in docs if i is not None and i % 2 == 0] + [(10, None), (77777, 1)]
    good = {i for i, q in labels if q == 1}
    grams = [Counter(quality.buckets_of((t or "").encode(), buckets).tolist()) for _, t in docs]
    raw, target = Counter(), Counter()
    for (i, _), g in zip(docs, grams, strict=True):
        raw.update(g)
        if i in good:
            target.update(g)
    want = []
    for (i, _), g in zip(docs, grams, strict=True):
        own = i in good
        n = sum(g.values())
        scale = (sum(target.values()) - n * own) / (sum(raw.values()) - n)
        w = sum(c * math.log((target[b] - c * own + 10) / ((raw[b] - c) * scale + 10)) for b, c in g.items())
        u = (xxhash.xxh3_64_intdigest(str(i).encode(), seed) + 0.5) / 2**64
        want.append((i, w, w - math.log(-math.log(u))))
    got = quality.importance_resample(fx.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int"), share=0.4, seed=seed, buckets=buckets).collect()
    near = lambda rows: sorted((str(i), round(w, 6), round(k, 6)) for i, w, k in rows)
    assert near((r.doc_id, r.log_weight, r.sample_key) for r in got) == near(want)
    k = round(0.4 * len(docs))
    chosen = sorted(want, key=lambda x: (-x[2], x[0] is None, x[0] or 0))[:k]
    assert sum(r.kept for r in got) == k and sorted(round(r.sample_key, 6) for r in got if r.kept) == sorted(round(x[2], 6) for x in chosen)


def test_quality_counts_columns(monkeypatch):
    """N-grams and weights of whole columns, in parts, are those of each text by its definition."""
    import xxhash

    from stratapoint.llm.text import ngram_hashes

    def shape(t):
        letters = bytes(c for c in t if c < 128)
        if not (t[0] > 127 or t[:1].isalnum()):
            return t
        return b"0" if t.isdigit() else b"A" if letters.isupper() and len(t) > 1 else b"Aa" if t[:1].isupper() else b"a0" if any(48 <= c < 58 for c in letters) else b"a"

    def plain(text, buckets):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text or b"")
        w = np.array([xxhash.xxh3_64_intdigest(t) for t in words], np.uint64)
        s = np.array([xxhash.xxh3_64_intdigest(shape(t), 1) for t in words], np.uint64)
        return Counter(int(g) % buckets for h, n in ((w, 1), (w, 2), (s, 1), (s, 2), (s, 3)) for g in ngram_hashes(h, n))

    rng = __import__("random").Random(4)
    parts = [b"a", b"Ab", b"AB", b"9", b"\xc3\xa9", b"!", b"'", b" ", b" ", b"\n", b"\x7f", b"\0", b"_", b"Z", b"\xff"]
    texts = [None, b"", *(b"".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)), b"some Words 12 " * 9000, None]
    own = [rng.random() < 0.4 for _ in texts]
    monkeypatch.setattr(quality, "PART_BYTES", 700)
    for buckets in (512, 1000):
        want = [plain(t, buckets) for t in texts]
        batch = pa.RecordBatch.from_arrays([pa.array([b"x", *texts], pa.binary())[1:], pa.array([x or None for x in own])], ["text", "target"])
        (got,) = quality._count(buckets)(iter([batch]))
        raw, target = sum(want, Counter()), sum((g for g, x in zip(want, own, strict=True) if x), Counter())
        assert [tuple(r.values()) for r in got.to_pylist()] == sorted((b, n, target[b]) for b, n in raw.items())
        ratio = quality.Ratio(np.array([raw[b] for b in range(buckets)]), np.array([target[b] for b in range(buckets)]))
        weights = np.concatenate([ratio.weights(*quality.buckets_by_row(p.column(0), buckets), np.array(p.column(1).fill_null(False))) for p in quality._parts(batch)])
        for g, x, weight in zip(want, own, weights.tolist(), strict=True):
            n = sum(g.values())
            scale = (ratio.target_n - n * x) / (ratio.raw_n - n)
            assert weight == pytest.approx(sum(c * np.log((target[b] - c * x + 10) / ((raw[b] - c) * scale + 10)) for b, c in g.items()), abs=1e-6)


def test_language_id_refuses_what_is_no_language(spark):
    """The pipeline's threshold lies between random letters or other scripts and real texts."""
    import corpus_pipeline

    rng = __import__("random").Random(4)
    lexicon = "the of and house water green stone night with from have this that which".split()
    real = [(i, " ".join(rng.choice(lexicon) for _ in range(rng.randrange(1, 60))), "en") for i in range(200)]
    noise = [(1000 + i, "".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(rng.randrange(60, 400))), None) for i in range(40)] + [(2000, "привет мир как дела", None), (2001, "123 456", None), (2002, None, None)]
    df = spark.createDataFrame(real + noise, "doc_id long, text string, lang string")
    left = {r.doc_id for r in corpus_pipeline.language_id(spark, df, "").collect()}
    assert left == {i for i, _, _ in real}


def plain_notice(words, templates, v, least):
    """(is a grant, score, start, template) of the best span of words, from all spans."""
    best = None
    for k, ((name, text), weights, norm) in enumerate(zip(templates, v.weights, v.norms, strict=True)):
        most, must = int(len(licenses.terms(text)) / least**2) + 1, licenses.NAMES & weights.keys()
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + most) + 1):
                unit = Counter(words[a:b])
                if words[a] not in weights or words[b - 1] not in weights or not must <= unit.keys():
                    continue
                own = {t: n * v.idf.get(t, v.unknown) for t, n in unit.items()}
                score = round(sum(w * weights.get(t, 0) for t, w in own.items()) / (np.sqrt(sum(w * w for w in own.values())) * norm), 6)
                if score >= least:
                    best = max(filter(None, [best, (name != "Proprietary", score, -a, -k)]))
    return best


def test_notices_are_the_best_cosine(spark):
    rng = __import__("random").Random(8)
    v, texts = licenses.Vectors(), []
    for k in range(60):
        name, text = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        w = licenses.terms(text)
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w)), rng.choice(["stone", "the", "license", "water"]))
        if rng.random() < 0.4:
            del w[rng.randrange(len(w))]
        noise = lambda: [rng.choice(["stone", "river", "the", "of", "2020", "copyright"]) for _ in range(rng.randrange(8))]
        texts.append(" ".join([*noise(), *w, *noise()]))
    df = spark.createDataFrame([(f"d{i}/f.c", t, "mine", b"x") for i, t in enumerate(texts)], "path string, text string, __text string, __row binary")
    got = licenses.license_scan(df).collect()
    found = 0
    for r in got:
        assert (r["__text"], bytes(r["__row"])) == ("mine", b"x")  # a caller's columns stay what they are
        best = plain_notice(licenses.terms(r.text), licenses.TEMPLATES, v, 0.8)
        found += best is not None
        assert r.own_license == (licenses.TEMPLATES[-best[3]][0] if best else None), r.text
        assert best is None or abs(r.own_score - best[1]) < 2e-6
    assert 30 < found


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [("a/LICENSE", mit), ("a/x.py", "print(1)"), ("a/b/y.py", "text\nLicensed under CC BY-NC 4.0.\nmore text here"), ("a/b/z.py", None), ("c/w.py", "und mit der die"), ("top.py", ""), (None, mit), ("a/b/c/LICENSE", gpl), ("a/b/c/d/e.py", "x"), ("a/x.py", "print(1)"), ("d/f.py", "Released under no License of the kind, and so on, for any use whatsoever")]
    df = spark.createDataFrame([(p, t, "old") for p, t in files], "path string, text string, license string")
    got = {(r.path, r.own_license, r.license, r.inherited_from) for r in licenses.license_scan(df).collect()}
    assert got == {
        ("a/LICENSE", "MIT", "MIT", None), ("a/x.py", None, "MIT", "a"), ("a/b/y.py", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), ("a/b/z.py", None, "MIT", "a"), ("c/w.py", None, None, None),
        ("top.py", None, None, None), (None, "MIT", "MIT", None), ("a/b/c/LICENSE", "GPL-3.0", "GPL-3.0", None), ("a/b/c/d/e.py", None, "GPL-3.0", "a/b/c"), ("d/f.py", None, None, None),
    }
    assert licenses.license_scan(df.where("1 = 0")).count() == 0


def test_license_notices_within_text(spark):
    """Words around a notice, line ends and comment marks do not count; tags are read."""
    cases = {
        "Copyright 2020 Jane Doe. Released under the MIT License.": "MIT",
        "Released under the MIT License, see LICENSE for details.": "MIT",
        "This file is released under the MIT License.": "MIT",
        "Copyright (c) 2020 The Foo Authors. All rights reserved.": "Proprietary",
        "# Copyright 2020 Foo. All rights reserved.\n# Licensed under the Apache License,\n# Version 2.0 (the \"License\");\nimport os": "Apache-2.0",
        "/* it under the terms of the GNU General Public\n * License as published by the Free Software Foundation; either\n * version 2 of the License, or (at your option) any later version.": "GPL-2.0",
        "# SPDX-License-Identifier: MIT\nx = 1": "MIT",
        "// SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0",
        "<!-- SPDX-License-Identifier: MIT OR Zlib -->": "MIT OR Zlib",
        "Released under the Zlib License.": None,
        "Licensed under the Zlib License, Version 2.0.": None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, text string").selectExpr("concat('s', id, '/x.c') as path", "text")
    got = {r.text: r.own_license for r in licenses.license_scan(df).collect()}
    assert got == cases


def test_license_files_speak(spark):
    """Real licence files, whole or their openings, are their own best template and speak for their directories."""
    texts = dict(licenses.full_texts())
    opening = texts["MIT"].split("THE SOFTWARE IS")[0].replace("<year> <copyright holders>", "2021 Jane Doe")
    files = [(f"{name}/LICENSE", text) for name, text in texts.items()] + [("opened/COPYING", opening)]
    rows = files + [(f"{path.rsplit('/', 1)[0]}/src/a.py", "x = 1") for path, _ in files] + [("prose/LICENSE", "A plain story about the sea, the wind and a license to sail"), ("prose/a.py", "x")]
    got = {r.path: r for r in licenses.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for name in [*texts, "opened"]:
        license_, file = ("MIT", "opened/COPYING") if name == "opened" else (name, f"{name}/LICENSE")
        assert got[file].own_license == license_
        assert (got[f"{name}/src/a.py"].license, got[f"{name}/src/a.py"].inherited_from) == (license_, name)
    assert got["prose/a.py"].license is None


def test_license_gate_holds_every_template():
    for _, text in (*licenses.TEMPLATES, *licenses.full_texts()):
        assert set(licenses.terms(text)) & set(licenses.GATE), text


def test_license_cues_are_exact():
    """Whatever reaches the threshold holds a cue."""
    v = licenses.Vectors()
    cue = re.compile(v.cues(0.8))
    for weights, norm in zip(v.weights, v.norms, strict=True):
        rest = [w for t, w in weights.items() if not cue.search(t)]
        assert np.sqrt(sum(w * w for w in rest)) < 0.8 * norm
