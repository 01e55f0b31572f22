import hashlib
import re

from photolake import storage
from photolake.llm.decontaminate import contamination, decontaminate, phrase_matches, proximity_matches
from tests.llm.conftest import prose
from tests.llm.conftest_llm import LOWER

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    def split(t):
        return ITEM.findall((t or "").translate(LOWER))

    windows = set()
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        if i is not None and n:
            windows |= {(str(i), tuple(w[k : k + n])) for k in range(len(w) - n + 1)}
    out = []
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case():
    items = [(2, prose(1, 40)), (10, prose(2, 13)), (3, "Short item here"), (4, "one"), (5, None), (6, "..."), (10, prose(3, 20)), (None, prose(4, 20)), (7, prose(1, 40))]
    a, b = prose(1, 40).split(), prose(2, 13).split()
    docs = [
        (1, prose(50, 100) + " " + " ".join(a[5:25]) + ". " + prose(51, 30)),
        (2, " ".join(a[:12])),
        (3, prose(2, 13).upper() + " x " + prose(2, 13)),
        (4, "a short  ITEM-here, one two"),
        (5, None),
        (6, ""),
        (7, prose(60, 2000) + " " + " ".join(b)),
        (8, " ".join(a[:6] + ["odd"] + a[7:])),
        (9, "oneone"),
        (9, "one"),
        (9, "one"),
        (None, " ".join(a)),
        (11, " ".join(b[:12]) + " " + " ".join(b)),
        (12, " ".join(["the"] * 60)),
    ]
    return docs, items


def bench_table(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def rows(df):
    return sorted((tuple(r) for r in df.drop("h").collect()), key=str)


def test_against_brute_force(spark, table):
    docs, items = case()
    assert rows(contamination(table(docs), bench_table(spark, items))) == brute(docs, items)


def test_large_benchmark_takes_the_shuffle(spark, table, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    docs, items = case()
    assert rows(contamination(table(docs), bench_table(spark, items))) == brute(docs, items)


def test_repetitive_items(spark, table):
    items = [(1, "a a a a a a a a a a a a a a a b a a"), (2, "a b " * 10)]
    docs = [(1, "a " * 30), (2, "b a b a b a b a b a b a b a b"), (3, "a a a a b a a a a a a a a a a a b")]
    assert rows(contamination(table(docs), bench_table(spark, items))) == brute(docs, items)


def test_empty_tables_and_stage(spark, table):
    docs, items = case()
    assert contamination(table([]), bench_table(spark, items)).count() == 0
    assert contamination(table(docs), bench_table(spark, [])).where("contaminated").count() == 0
    kept = decontaminate(table(docs), bench_table(spark, items))
    assert kept.columns == table(docs).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, docs[1][1]), (5, None), (6, ""), (7, docs[6][1]), (9, "oneone"), (12, docs[13][1])]


def test_phrases_and_proximity(spark, table):
    w = prose(1, 13).split()
    docs = [(1, " ".join(w)), (2, " ".join(w[:6] + ["odd"] + w[6:])), (3, prose(77, 40))]
    bench = bench_table(spark, [(1, prose(1, 13))])
    assert [(r["doc_id"], r["first"], r["last"]) for r in phrase_matches(table(docs), bench).collect()] == [(1, 0, 12)]
    assert {r["doc_id"] for r in proximity_matches(table(docs), bench).collect()} == {1, 2}
