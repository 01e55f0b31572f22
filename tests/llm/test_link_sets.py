"""``link_sets`` against all pairs, and that a dense group's pivots are held only against sets outside of it."""

import numpy as np
import pytest

from photolake.llm import near_dup
from photolake.llm.near_dup import link_sets


def case(n, bases, edits, seed):
    r = np.random.default_rng(seed)
    base = [r.integers(0, 2**62, 60, dtype=np.uint64) for _ in range(bases)]
    out = []
    for _ in range(n):
        x = base[r.integers(bases)].copy()
        k = int(r.integers(0, edits + 1))
        x[r.integers(0, 60, k)] = r.integers(0, 2**62, k, dtype=np.uint64)
        out.append(np.unique(x))
    return out


@pytest.mark.parametrize("bases, edits", [(1, 14), (8, 10), (60, 4)])
@pytest.mark.parametrize("pivots", [None, 40])
def test_against_all_pairs(bases, edits, pivots):
    sets = case(120, bases, edits, bases)
    labels = [i // 2 if i < 20 else 1000 + i for i in range(120)]
    want = near_dup.UnionFind(120)
    for i in range(0, 20, 2):
        want.union(i, i + 1)
    for i in range(120 if pivots is None else pivots):
        for j in range(120):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 10 * k >= 8 * (len(sets[i]) + len(sets[j]) - k):
                want.union(i, j)
    got = link_sets(sets, 8, 10, labels, pivots)
    assert [got.find(i) for i in range(120)] == [want.find(i) for i in range(120)]


def test_sets_that_are_linked_are_not_counted_again(monkeypatch):
    """Near copies and ten other sets: every pivot used to be held against all of them."""
    sets, counted = case(1490, 1, 4, 1) + case(10, 10, 0, 2), [0]
    add, count = np.add.reduceat, np.bincount

    class Add:
        def __call__(self, *a, **k):
            return add(*a, **k)

        @staticmethod
        def reduceat(x, at, **k):
            counted[0] += len(x)
            return add(x, at, **k)

    def counts(x, *a, **k):
        counted[0] += len(x)
        return count(x, *a, **k)

    class Numpy:
        def __getattr__(self, name):
            return {"add": Add(), "bincount": counts}.get(name, getattr(np, name))

    monkeypatch.setattr(near_dup, "np", Numpy())
    link_sets(sets, 8, 10, list(range(1500)), 700)
    assert counted[0] < 40 * 1500 * 60
