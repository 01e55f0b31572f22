"""Passages are found without work that can't change them, and what is looked up once is what each window would give."""

import random

import numpy as np
import pyarrow as pa
import pytest

from photolake.llm import passages as module
from photolake.llm.passages import LEAST, confirmed, settled


def counted(monkeypatch, name):
    calls, real = [], getattr(module, name)

    def call(*args, **kwargs):
        calls.append(args)
        return real(*args, **kwargs)

    monkeypatch.setattr(module, name, call)
    return calls


def test_no_span_is_looked_for_once_one_is_confirmed(monkeypatch):
    calls = counted(monkeypatch, "_longest")
    x = np.random.default_rng(1).integers(2, 2**63, 300, dtype=np.uint64)
    assert module._grown(x, x, (100, 0, 299), (100, 0, 299)) == (0, 299, 0, 299)
    assert len(calls) == 1


def test_texts_are_sorted_once_for_all_windows(monkeypatch):
    calls = counted(monkeypatch, "_places")
    x = np.random.default_rng(2).integers(2, 2**63, 400, dtype=np.uint64)
    y = np.concatenate((x[:100], np.arange(2, 400, 2, dtype=np.uint64), x[150:300]))
    ties = [(v, [(c, l, l + 80)], [(c + d, l + d, l + d + 80)]) for v, c, l, d in ((1, 40, 5, 0), (2, 60, 15, 0), (3, 200, 160, 149), (4, 210, 180, 149))]
    found = confirmed(x, y, ties)
    assert {p[:2] for p in found} >= {(0, 99), (150, 299)} and not calls


def test_covered_windows_look_nothing_up(monkeypatch):
    """Equal windows are settled by the first of them; that no other one shares more isn't looked up again."""
    calls = counted(monkeypatch, "_sums")
    x = np.arange(80, dtype=np.uint32)
    found = settled(list(range(30)), [x] * 30, [40] * 30)
    assert {f[0] for f in found} == set(range(1, 30)) and not calls


def spans(place, at):
    """All candidates of ``_reaches``, by trying every start and end."""
    hits = [k for k in range(len(place)) if place[k] >= 0]
    left, right = [k for k in hits if k <= at][::-1], [k for k in hits if k >= at]
    out = set()
    for weight, both in ((4, True), (4, False), (8, False)):

        def gain(side, lead):
            got = []
            for k, s in enumerate(side):
                there = [place[z] for z in side[: k + 1]]
                far = max(there) - place[at] + 1 if lead else place[at] - min(there)
                n = k + lead
                got.append(n - weight * (abs(s - at) + lead - n) - (weight * max(far - n, 0) if both else 0))
            return got

        back, ahead = gain(left, 0), gain(right, 1)
        out.add((left[max(range(len(left)), key=lambda k: (back[k], k))], right[max(range(len(right)), key=lambda k: (ahead[k], k))]))
        least = 0
        while fits := [(-(right[e] - left[s]), at - left[s], right[e] - at) for s in range(len(left)) for e in range(len(right)) if back[s] + ahead[e] >= least]:
            _, a, b = min(fits)
            if a + b + 1 < LEAST:
                break
            out.add((at - a, at + b))
            least = 4 * least + 3
    return sorted((s for s in out if s[1] - s[0] + 1 >= LEAST), key=lambda s: (s[0] - s[1], at - s[0]))


@pytest.mark.parametrize("seed", range(30))
def test_spans_come_longest_first_and_none_is_left_out(seed):
    r = random.Random(seed)
    place = np.array([k + 3 * (k > 70) if r.random() > r.choice((0.02, 0.2)) else -1 for k in range(120)])
    if seed % 3 == 0:
        place[r.randrange(120)] = r.randrange(120)
    place[55] = 55
    assert list(module._reaches(place, 55)) == spans(place, 55)


@pytest.mark.parametrize("seed", range(30))
def test_places_of_windows_are_those_of_a_search_in_the_window(seed):
    r = np.random.default_rng(seed)
    kinds = int(r.choice([8, 60, 5000]))
    x, y = r.integers(0, kinds, 150).astype(np.uint64), r.integers(0, kinds, 130).astype(np.uint64)
    two = module._Two(x, y)
    assert (two.found == np.isin(x, y)).all() and (two.back == np.isin(y, x)).all()
    for _ in range(20):
        a, b = sorted(r.choice(151, 2, replace=False).tolist())
        c, d = sorted(r.choice(131, 2, replace=False).tolist())
        shift = int(r.integers(-60, 60))
        assert (two.places(a, b, c, d, shift) == module._places(x[a:b], y[c:d], shift)).all()
        group = module._Group([0, 1], [x[a:b].astype(np.uint32), y[c:d].astype(np.uint32)], [0, 0])
        n = b - a
        assert (group.places(0, n, n, n + d - c, shift) == module._places(x[a:b], y[c:d], shift)).all()


def test_spans_of_a_hash_are_told_once():
    """Windows of one document that overlap are one row, not a row for each pair."""
    assert module._joined([(60, 70), (5, 9), (0, 4), (7, 8), (11, 12)]) == [(0, 9), (11, 12), (60, 70)]
    x = np.arange(80, dtype=np.uint32).tobytes()
    rows = pa.RecordBatch.from_pylist([{"v": 1, "doc_id": i, "h": 1, "c": 40, "l": 0, "r": 79, "shingles": x} for i in range(30)])
    out = [r for b in module._settle(iter([rows])) for r in b.to_pylist()]
    assert len(out) == 30 and sorted(r["doc_id"] for r in out if not r["later"]) == [0] and all((r["first"], r["last"]) == (0, 83) for r in out)
