import math
import random

import numpy as np
import pytest

from photolake.llm import line_dedup, near_dup
from photolake.llm import passages as passages_module
from photolake.llm.line_dedup import drop_lines, repeated_lines
from photolake.llm.passages import compact_windows, repeated_passages
from photolake.llm.quality import classify, good_documents, gram_log_probabilities, score
from tests.llm.conftest import prose

BLANKS = " \t\r\x0b\x0c"


def brute_lines(rows):
    places = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(BLANKS):
                places.setdefault(line.strip(BLANKS), []).append((i, k))
    lines = list(places)
    sets = [{x[j : j + 8] for j in range(len(x) - 7)} if len(x) >= 8 else {x} for x in lines]
    root = list(range(len(lines)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(lines)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 10 * k >= 8 * (len(sets[a]) + len(sets[b]) - k):
                root[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for a, x in enumerate(lines):
        first[find(a)] = min(first.get(find(a), (math.inf, 0)), min(places[x]))
    gone = {i: [] for i, _ in rows}
    for a, x in enumerate(lines):
        for place in places[x]:
            if place != first[find(a)]:
                gone[place[0]].append(place[1])
    return {i: sorted(g) for i, g in gone.items()}


def line_case():
    r = random.Random(1)
    base = [prose(i, 25) for i in range(30)]
    near = lambda s: s[: len(s) // 2] + r.choice("xyz") + s[len(s) // 2 + 1 :]
    rows = [(i, "\n".join(r.choice([x, near(x), x + " ", "", "  \t", "ok", "All rights reserved."]) for x in r.sample(base, 6))) for i in range(40)]
    return rows + [(40, None), (41, ""), (42, "\n\n"), (43, prose(99, 3000)), (44, prose(99, 3000) + "!")]


@pytest.mark.parametrize("slice_bytes", [8 << 20, 3000])
def test_lines_against_brute_force(table, monkeypatch, slice_bytes):
    whole = line_dedup.text_slices
    monkeypatch.setattr(line_dedup, "text_slices", lambda b, **_: whole(b, limit=slice_bytes))
    rows = line_case()
    got = {r["doc_id"]: list(r["dropped"]) for r in repeated_lines(table(rows)).collect()}
    assert got == brute_lines(rows)


def test_dropping_lines(table):
    docs = table([(1, "one line here\nanother line there"), (2, "new words only\none line here\n\nend"), (2, "new words only\none line here\n\nend"), (None, None)])
    out = drop_lines(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, "one line here\nanother line there"), (2, "new words only\n\nend"), (2, "new words only\n\nend"), (None, None)], key=str)
    assert repeated_lines(table([])).count() == 0


def test_compact_windows_hold_every_passage():
    g = np.random.default_rng(2).integers(0, 2**63, 200, dtype=np.uint64)
    windows = compact_windows(g, 20)
    assert len(windows) < 3 * len(g) / 20 * 2
    for a in range(0, 200 - 20, 7):
        for b in range(a + 19, 200, 11):
            c = a + int(g[a : b + 1].argmin())
            assert sum(l <= a <= c <= b <= r and m == c for l, m, r in windows) == 1  # noqa: E741


def test_passages(table):
    shared, other = prose(7, 70), prose(8, 60).split()
    near = list(other)
    near[30] = "changed"
    rows = [(1, f"{prose(1, 40)} {shared} {prose(2, 30)}"), (2, f"{prose(3, 55)} {shared}"), (3, f"{shared} {prose(4, 90)}"), (4, " ".join(other) + " " + prose(5, 20)), (5, prose(6, 20) + " " + " ".join(near)), (6, prose(9, 200)), (7, None), (8, ""), (9, shared[:60]), (10, f"{shared} {prose(10, 5)} {shared}"), (10, f"{shared} {prose(10, 5)} {shared}"), (None, prose(11, 49))]
    out = {r["doc_id"]: r for r in repeated_passages(table(rows)).collect()}
    spans = lambda i: [(s["first"], s["last"]) for s in out[i]["spans"]]
    assert spans(1) == [(40, 109)] and spans(2) == [(55, 124)] and spans(3) == [(0, 69)]
    assert (out[1]["n_dropped"], out[2]["n_dropped"], out[3]["n_dropped"]) == (0, 70, 70)
    assert out[4]["n_repeated"] >= 55 and out[5]["n_repeated"] >= 55 and out[4]["n_dropped"] == 0
    assert all(out[i]["n_repeated"] == 0 for i in (6, 7, 8, 9, None)) and out[10]["n_dropped"] >= 70
    assert repeated_passages(table([])).count() == 0 and repeated_passages(table(rows)).count() == len(rows)


def brute_kneser_ney(counts):
    """log p of each 4-gram (of 16-bit units) by the textbook recursion."""
    tables = {4: {g: n for g, n in counts.items() if n}}
    for k in (3, 2, 1):
        tables[k] = {}
        for g in tables[k + 1]:
            s = g & ((1 << 16 * k) - 1)
            tables[k][s] = tables[k].get(s, 0) + 1
    cut = {}
    for k, t in tables.items():
        n = [sum(c == i for c in t.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        cut[k] = []
        for i in (1, 2, 3):
            d = i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else None
            cut[k].append(d if d is not None and 0 < d < i else i / 2)

    def p(k, g):
        own = {x: c for x, c in tables[k].items() if x >> 16 == g >> 16}
        low = p(k - 1, g & ((1 << 16 * (k - 1)) - 1)) if k > 1 else 1 / (len(tables[1]) + 1)
        if not own:
            return low
        d = lambda c: cut[k][min(c, 3) - 1]
        c = own.get(g, 0)
        return ((c - d(c) if c else 0) + sum(map(d, own.values())) * low) / sum(own.values())

    return {g: math.log(p(4, g)) for g in counts}


def test_kneser_ney_against_textbook(spark):
    r = random.Random(3)
    counts = {}
    for _ in range(400):
        g = 0
        for _ in range(4):
            g = g << 16 | r.choice([97, 98, 99, 0xFFFE])
        counts[g - (1 << 64) if g >= 1 << 63 else g] = r.choice([0, 0, 1, 1, 1, 2, 2, 3, 4, 9])
    got = {r["g"]: r["logp"] for r in gram_log_probabilities(spark.createDataFrame([("en", g, n) for g, n in counts.items()], "lang string, g long, n long")).collect()}
    want = brute_kneser_ney({g % (1 << 64): n for g, n in counts.items()})
    assert {g % (1 << 64): round(v, 9) for g, v in got.items()} == {g: round(v, 9) for g, v in want.items()}


def quality_case(spark):
    r = random.Random(5)
    syllables = ["an", "the", "on", "er", "in", "re", "st", "al"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    good = [(i, " ".join(word() for _ in range(80)), "en") for i in range(300)]
    bad = [(1000 + i, " ".join(word().upper() + "!!" for _ in range(60)), "en") for i in range(30)]
    odd = [(2000, None, "en"), (2001, "", "en"), (2002, "no model here", "xx"), (2003, "null language", None), (None, good[0][1], "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in good + bad + odd], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000, 0, 0), (1001, 1, 1), (None, 1, 0), (7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    docs, labels = quality_case(spark)
    out = {r["doc_id"]: r for r in classify(docs, labels).collect()}
    assert all(out[i]["kept"] for i in range(300)) and not any(out[1000 + i]["kept"] for i in range(30))
    assert all(out[i]["kept"] and out[i]["perplexity"] is None for i in (2000, 2001, 2002, 2003)) and out[None]["kept"]
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 305
    assert classify(docs.limit(0), labels).count() == 0 and good_documents(docs, labels.limit(0)).count() == docs.count()


def test_scores_do_not_depend_on_how_the_model_travels(spark):
    docs, labels = quality_case(spark)
    rows = lambda d: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.collect()), key=str)
    assert rows(score(docs, labels)) == rows(score(docs, labels, broadcast_bytes=0))


@pytest.mark.parametrize("slice_bytes", [8 << 20, 1])
def test_passages_past_a_first_document_that_fails(table, monkeypatch, slice_bytes):
    """Documents share a passage whose every shingle earlier documents have in other contexts."""
    whole = passages_module.text_slices
    monkeypatch.setattr(passages_module, "text_slices", lambda b, **_: whole(b, limit=slice_bytes))
    shared = prose(7, 60)
    words = shared.split()
    rows = [(i, f"{prose(100 + i, 60)} {' '.join(words[10 * i:10 * i + 15])} {prose(200 + i, 60)}") for i in range(6)]
    rows += [(10 + i, f"{prose(300 + i, 60)} {' '.join(words[10 * i:10 * i + 15])} {prose(400 + i, 60)}") for i in range(6)]
    rows += [(20, f"{prose(20, 70)} {shared}"), (21, f"{prose(21, 80)} {shared}"), (22, f"{shared} {prose(22, 90)}")]
    out = {r["doc_id"]: r for r in repeated_passages(table(rows)).collect()}
    assert [(out[i]["n_repeated"], out[i]["n_dropped"]) for i in (20, 21, 22)] == [(60, 0), (60, 60), (60, 60)]
    assert all(out[i]["n_repeated"] == 0 for i in range(16) if i in out)


def test_passage_twice_in_the_first_document(table):
    part = prose(7, 60).split()
    rows = [(1, f"{' '.join(part[:30])} {prose(1, 60)} {' '.join(part)} {prose(2, 40)}"), (2, f"{prose(3, 50)} {' '.join(part)}")]
    out = {r["doc_id"]: r for r in repeated_passages(table(rows)).collect()}
    assert [(out[i]["n_repeated"], out[i]["n_dropped"]) for i in (1, 2)] == [(60, 0), (60, 60)]


def sentences(r, words, n):
    some = [r.choice(words) for _ in range(n)]
    return " ".join((w.capitalize() if i % 8 == 0 else w) + ("." if i % 8 == 7 else "") for i, w in enumerate(some))


def running_case(spark, more):
    r = random.Random(6)
    words = ["".join(r.choice(["an", "the", "on", "er", "in", "re", "st", "al"]) for _ in range(k % 3 + 1)) for k in range(60)]
    rows = [(i, sentences(r, words, 80), "en", "s", 1) for i in range(300)] + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(more(r, words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return {x["doc_id"]: x["kept"] for x in classify(docs, spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")).collect()}


def test_repeated_words_are_junk(spark):
    kept = running_case(spark, lambda r, words: [" ".join([w.capitalize()] * 60) for w in words[:10]])
    assert not any(kept[1000 + i] for i in range(10)) and sum(kept[i] for i in range(300)) >= 297


def test_a_few_odd_words_in_a_long_text(spark):
    def more(r, words):
        text = sentences(r, words, 800).split()
        return [" ".join(text), " ".join([*text[:400], "zqxjk", "wpfvyb", "kgdq", *text[400:]])]

    kept = running_case(spark, more)
    assert kept[1000] and not kept[1001] and sum(kept[i] for i in range(300)) >= 290


@pytest.mark.parametrize("swap", [False, True])
@pytest.mark.parametrize("more", [8, 12])
def test_passage_with_words_inserted(table, swap, more):
    part = prose(7, 92).split()
    longer = part[:46] + prose(50, more).split() + part[46:]
    one, two = (longer, part) if swap else (part, longer)
    out = {r["doc_id"]: r for r in repeated_passages(table([(1, f"{prose(1, 60)} {' '.join(one)}"), (2, f"{' '.join(two)} {prose(2, 70)}")])).collect()}
    assert (out[1]["n_repeated"], out[2]["n_dropped"]) == (len(one), len(two))


def test_lines_of_a_component_held_together_by_chance_are_parted(table, monkeypatch):
    # every key ties each of its lines to one common line, as chance ties do in large tables
    def tied(*_):
        raise AssertionError("unlike lines are compared pair by pair")

    rows = line_case() + [(100 + i, prose(200 + i, 40)) for i in range(60)]
    one = line_dedup.components
    chance = lambda ties: one(ties.union(ties.select("a", ties["b"] * 0)).union(ties.select("b", ties["b"] * 0)))
    monkeypatch.setattr(line_dedup, "components", chance)
    monkeypatch.setattr(near_dup, "TASK_SHINGLES", 3_000)
    monkeypatch.setattr(near_dup, "_settle_large", tied)
    rows = [(i, t) for i, t in rows if i not in (43, 44)]
    got = {r["doc_id"]: list(r["dropped"]) for r in repeated_lines(table(rows)).collect()}
    assert got == brute_lines(rows)


def test_chains_of_near_sketches_stay_together():
    r = np.random.default_rng(1)
    one = r.integers(0, 256, 48, dtype=np.uint8)
    two, three, other = one.copy(), one.copy(), r.integers(0, 256, 48, dtype=np.uint8)
    two[:20] += 1
    three[:40] += 1
    assert sorted(near_dup.near_ties(np.array([4, 5, 6, 7, 8]), np.stack([one, three, other, two, other]))) == [(5, 4), (7, 4), (8, 6)]
