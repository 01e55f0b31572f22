"""Passages of pairs of documents that earlier documents hold short pieces of, against what was planted and the exact similarity."""

import random

import pytest

from photolake.llm import passages as module
from photolake.llm.passages import repeated_passages
from tests.llm.conftest import prose
from tests.llm.conftest_llm import words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def case(n, size, edits, seed):
    """Rows, and (ids, similarity of the two passages) of each pair; five earlier documents hold 45 words of a passage."""
    r = random.Random(seed)
    rows, pairs, at = [], [], 100_000
    for k in range(n):
        one = prose(seed * 1000 + k, size).split()
        for i in range(5):
            a = r.randrange(size - 45 + 1)
            rows.append((k * 5 + i, f"{prose(at, 60)} {' '.join(one[a : a + 45])} {prose(at + 1, 60)}"))
            at += 2
        two = list(one)
        for i in r.sample(range(size), edits):
            two[i] = f"edit{r.randrange(10**6)}"
        ids = 10_000 + 2 * k, 10_001 + 2 * k
        for i, part in zip(ids, (one, two), strict=True):
            rows.append((i, f"{prose(at, r.randrange(30, 90))} {' '.join(part)} {prose(at + 1, r.randrange(30, 90))}"))
            at += 2
        a, b = shingles(" ".join(one)), shingles(" ".join(two))
        pairs.append((ids, len(a & b) / len(a | b)))
    return rows, pairs


@pytest.mark.parametrize("slice_bytes", [8 << 20, 1])
@pytest.mark.parametrize("size, edits, least", [(120, 0, 1.0), (80, 0, 1.0), (52, 0, 1.0), (120, 2, 0.98), (80, 1, 0.98)])
def test_every_pair_is_found_whatever_earlier_documents_hold(table, monkeypatch, slice_bytes, size, edits, least):
    whole = module.text_slices
    monkeypatch.setattr(module, "text_slices", lambda b, **_: whole(b, limit=slice_bytes))
    rows, pairs = case(60, size, edits, seed=size + edits)
    out = {r["doc_id"]: r for r in repeated_passages(table(rows)).collect()}
    assert len(out) == len(rows)
    due = [ids for ids, similarity in pairs if similarity >= 0.8]
    found = sum(out[b]["n_dropped"] >= 0.9 * size - 10 * edits and out[a]["n_repeated"] >= 0.9 * size - 10 * edits for a, b in due)
    assert len(due) >= 20 and found >= least * len(due)
    if not edits:
        # no word outside of a passage is taken, but for words that stand next to both by chance
        assert all(out[i]["n_repeated"] <= size + 4 for ids, _ in pairs for i in ids)
        assert not any(out[i]["n_dropped"] for i in range(300))


def test_many_near_copies_of_an_original_among_documents_with_its_common_line(table):
    line, original = prose(1, 20), prose(2, 64).split()
    rows = [(i, f"{prose(100 + i, 50)} {line} {prose(600 + i, 50)}") for i in range(150)]
    for i in range(40):
        copy = list(original)
        for k in random.Random(i).sample(range(64), 1):
            copy[k] = f"edit{i}x{k}"
        rows.append((200 + i, f"{line} {' '.join(copy)}"))
    rows.append((900, f"{line} {' '.join(original)}"))
    out = {r["doc_id"]: r for r in repeated_passages(table(rows)).collect()}
    assert not any(out[i]["n_repeated"] for i in range(150)) and out[900]["n_dropped"] >= 60
    assert sum(out[200 + i]["n_repeated"] >= 50 for i in range(40)) >= 39


def test_one_word_repeated_costs_a_window(table):
    rows = [(i, f"{prose(i, 60)} {'junk ' * 5000}{prose(50 + i, 60)}") for i in range(6)]
    out = {r["doc_id"]: r for r in repeated_passages(table(rows)).collect()}
    assert out[0]["n_dropped"] == 0 and all(out[i]["n_dropped"] >= 5000 for i in range(1, 6))


def test_whole_copies(table):
    long, short = prose(1, 50), prose(2, 49)
    rows = [(5, long), (3, long), (3, long), (None, None), (1, short), (2, short), (7, ""), (8, ""), (9, f"{long} {prose(3, 60)}")]
    out = {(r["doc_id"]): (r["n_repeated"], r["n_dropped"]) for r in repeated_passages(table(rows)).collect()}
    assert out == {5: (50, 50), 3: (50, 0), 9: (50, 50), **dict.fromkeys((None, 1, 2, 7, 8), (0, 0))}
