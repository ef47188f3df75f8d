from collections import Counter

import pytest

from stratapoint.llm import components as cc
from stratapoint.llm import jaccard_join as jj
from stratapoint.runtime import Scratch
from tests.llm import fixtures as fx


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_all_awkward_rows(spark):
    rows = fx.documents()
    assert result(jj.jaccard_components(fx.frame(spark, rows), 3, 90, 100)) == fx.jaccard_components(rows, 3, 90, 100)
    assert jj.jaccard_components(fx.frame(spark, rows).where("1 = 0")).count() == 0


def test_large_cells(spark, monkeypatch):
    """Everything that only large data takes: big cells, rounds of pivots, blocks, components by joins, texts by a shuffle."""
    for name, value in (("CELL_DOCS", 3), ("PIVOTS", 2), ("BLOCK_BYTES", 4000), ("SAMPLE", 4), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(jj, name, value)
    monkeypatch.setattr(cc.components, "__defaults__", (0,))
    rows = [r for r in fx.documents(4, 10)]
    assert result(jj.jaccard_components(fx.frame(spark, rows), 2, 80, 100)) == fx.jaccard_components(rows, 2, 80, 100)


def test_large_cells_by_regions(spark, monkeypatch):
    """Documents spread in distance, so that regions cut their cell, and tight ones, which no region cuts."""
    import random

    import numpy as np

    rng = random.Random(11)
    sets = []
    for cluster in range(3):
        base = [rng.randrange(2**62) for _ in range(60)]
        for k in range(40):
            s = list(base)
            for _ in range(rng.randrange(0, 10 + 12 * (k % 3))):
                s[rng.randrange(60)] = rng.randrange(2**62)
            sets.append((cluster == 2, np.unique(np.array(s, np.uint64))))
    rule, scratch = jj.Rule(80, 100), Scratch(spark)
    rows = [(1 + own, i, rng.randrange(5), bytearray(s.tobytes())) for i, (own, s) in enumerate(sets)]
    big = spark.createDataFrame(rows, "cell long, node long, pop long, shingles binary")
    for name, value in (("CELL_DOCS", 10), ("PIVOTS", 8), ("BLOCK_BYTES", 20_000)):
        monkeypatch.setattr(jj, name, value)
    split, joined = jj.by_size(scratch), jj.in_tasks(rule)
    got = {r.node: r.root for r in jj._large_cells(scratch, big, rule, split, joined).collect()}
    want = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if rows[i][0] == rows[j][0] and rule.links(np.array(len(np.intersect1d(a, b))), len(a), len(b)) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert [got.get(i, i) for i in range(len(sets))] == want
    assert 3 < len(set(want)) < len(sets)


@pytest.mark.parametrize("one_task", [0, 100])
def test_components(spark, one_task):
    edges = [(5, 4), (4, 9), (7, 7), (1, 2), (2, 3), (9, 10), (20, 1), (30, 31), (31, 30)]
    got = cc.components(Scratch(spark), spark.createDataFrame(edges, "a long, b long"), "t", one_task)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 4), (10, 4), (20, 1), (30, 30), (31, 30)]


def test_linked_sets_share_a_region():
    """Pigeonhole: sets on the threshold, of many sizes, always meet."""
    import numpy as np

    rng = np.random.default_rng(1)
    for rule in (jj.Rule(90, 100), jj.Rule(80, 100)):
        for size in (1, 5, 9, 10, 19, 40, 100, 333, 1000):
            for _ in range(5):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                drop = int(size * (rule.den - rule.num) / (rule.den + rule.num))
                b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64))))
                inter = len(np.intersect1d(a, b))
                if not drop or not rule.links(np.array(inter), len(a), len(b)):
                    continue
                assert len(np.intersect1d(rule.regions(a), rule.regions(b))), (rule, size)
                for x, y in ((a, b), (a[: len(a) - drop], a)):
                    if rule.links(np.array(len(np.intersect1d(x, y))), len(x), len(y)) and len(x) != len(y):
                        assert len(np.intersect1d(rule.regions(x), rule.regions(y))), (rule, size)


def test_cell_join_is_exact():
    import numpy as np

    rng = np.random.default_rng(2)
    rule = jj.Rule(80, 100)
    base = rng.integers(0, 2**62, 60, dtype=np.uint64)
    sets = []
    for _ in range(80):
        s = base.copy()
        k = int(rng.integers(0, 9))
        s[rng.integers(0, 60, k)] = rng.integers(0, 2**62, k, dtype=np.uint64)
        sets.append(np.unique(s))
    cell = jj.Cell(sets, rule)
    cell.join(np.arange(80))
    want = np.arange(80)
    for i in range(80):
        for j in range(i):
            if rule.links(np.array(len(np.intersect1d(sets[i], sets[j]))), len(sets[i]), len(sets[j])):
                want[want == want[i]] = want[j]
    assert all((want[i] == want[j]) == (cell.label[i] == cell.label[j]) for i in range(80) for j in range(80))


@pytest.mark.parametrize("buckets", [1, 7, 5000])
def test_names_travel_in_few_bytes(buckets):
    """Every name comes back with its member; where a member has about one name in each bucket, too, they take few bytes."""
    import numpy as np

    rng = np.random.default_rng(5)
    nodes = np.repeat(rng.integers(-(2**63), 2**63, 400, dtype=np.int64), 300)
    names = rng.integers(0, 2**64, len(nodes), dtype=np.uint64)
    packed = jj._packed(names, nodes, buckets)
    got = Counter()
    for bucket, row in zip(packed["bucket"].to_pylist(), packed["packed"].to_pylist(), strict=True):
        got.update((bucket, *x) for x in zip(*[y.tolist() for y in jj._unpacked(row)], strict=True))
    bits = np.uint64(2**40 - 1)
    assert got == Counter(zip((names % np.uint64(buckets)).tolist(), (names // np.uint64(buckets) & bits).tolist(), nodes.tolist(), strict=True))
    assert packed["packed"].nbytes < 15 * len(names)


def test_turns_see_every_name_once(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    names = rng.integers(0, 200, 3000, dtype=np.uint64) * np.uint64(3)
    batches = [jj._packed(names[k : k + 1000], np.arange(k, k + 1000), 3) for k in (0, 1000, 2000)]
    monkeypatch.setattr(jj, "TURN_NAMES", 500)
    turns = list(jj._buckets(iter(batches)))
    assert len(turns) == 7
    assert sorted(x for a, b in turns for x in zip(a.tolist(), b.tolist(), strict=True)) == sorted(zip((names // np.uint64(3)).tolist(), range(3000), strict=True))
    seen = [set(a.tolist()) for a, _ in turns]
    assert sum(map(len, seen)) == len(set().union(*seen))


@pytest.mark.parametrize("most", [4096, 0])
def test_without_nodes(spark, monkeypatch, most):
    """By bitmaps and by a shuffle, with numbers as monotonically_increasing_id gives them."""
    monkeypatch.setattr(jj, "BITMAPS", most)
    nodes = [p << 33 | k for p in range(3) for k in (0, 1, 2, 7, 8, 9, 32_767, 32_768, 32_769, 65_536, 100_000)]
    big = spark.createDataFrame([(1, n, bytearray(b"set")) for n in nodes], "cell long, node long, shingles binary")
    for gone in ([], nodes[::2], nodes[1::3], nodes):
        got = jj._without(Scratch(spark), big, spark.createDataFrame([(n,) for n in gone], "node long"), "t")
        assert got.columns == big.columns
        assert sorted(r.node for r in got.collect()) == sorted(set(nodes) - set(gone))


def test_sets_of_large_cells_are_not_shuffled(spark, monkeypatch):
    """Documents that share some words, so that they meet, but no links leave large cells without a shuffle of the sets."""
    import random

    plans, table = {}, Scratch.table

    def kept(self, df, name):
        out = table(self, df, name)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return out

    rng = random.Random(8)
    rows = [(i, " ".join(fx.words(rng, 60))) for i in range(60)]
    rows += [(100 + i, t if i % 2 else t + " more") for i, (_, t) in enumerate(rows[:20])]
    monkeypatch.setattr(Scratch, "table", kept)
    monkeypatch.setattr(jj, "CELL_DOCS", 3)
    # All documents are in one cell.
    monkeypatch.setattr(jj, "_cells", lambda scratch, edges, name, f=jj._cells: f(scratch, edges, name) if name != "cells" else f(scratch, edges, name).selectExpr("node", "1L AS cell", "pop"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert result(jj.jaccard_components(fx.frame(spark, rows), 1, 80, 100)) == fx.jaccard_components(rows, 1, 80, 100)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "a-left" in plans
    for name in ("a-left", "b-left"):
        assert "SortMergeJoin" not in plans.get(name, "") and "ShuffledHashJoin" not in plans.get(name, "")
