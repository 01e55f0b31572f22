"""Links of a block's members with its pivots, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from photolake.llm import near_dup
from photolake.llm.common import UnionFind


def _sets(r: np.random.Generator, n: int) -> list[np.ndarray]:
    base = [np.unique(r.integers(0, 80, int(r.integers(1, 40)))).astype(np.uint64) for _ in range(max(1, n // 4))]
    out = []
    for _ in range(n):
        b = base[int(r.integers(len(base)))]
        s = np.unique(np.append(b[r.random(len(b)) > r.choice([0, 0.05, 0.2])], r.integers(0, 80, int(r.integers(0, 3))))).astype(np.uint64)
        out.append(s if len(s) else b[:1])
    return out


def _links(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(x, y))
    return den * shared >= num * (len(x) + len(y) - shared)


@pytest.mark.parametrize("seed", range(40))
def test_pivots_and_members_against_brute_force(seed):
    r = np.random.default_rng(seed)
    num, den = [(8, 10), (85, 100), (80, 100)][seed % 3]
    k, n = int(r.integers(1, 15)), int(r.integers(16, 40))
    sets = _sets(r, n)
    labels = np.arange(n) if seed % 2 else r.integers(0, n, n)
    groups = near_dup.link_across(sets[:k], sets[k:], num, den, labels.tolist())
    plain = UnionFind(n)
    for i in range(n):
        for j in range(i):
            if labels[i] == labels[j] or (j < k <= i and _links(sets[i], sets[j], num, den)):
                plain.union(i, j)
    assert [groups.find(i) for i in range(n)] == [plain.find(i) for i in range(n)]


def test_sets_that_share_common_values_only_are_not_compared(monkeypatch):
    """Many unlike sets with the same frequent values: no candidates, so nothing is counted for them."""
    r = np.random.default_rng(3)
    common = np.arange(60, dtype=np.uint64)
    sets = [np.concatenate([common, r.integers(1 << 20, 1 << 40, 40).astype(np.uint64)]) for _ in range(400)]
    sets = [np.unique(s) for s in sets]
    counted = []

    class Numpy:
        def __getattr__(self, name):
            return getattr(np, name)

        class add:
            @staticmethod
            def reduceat(a, at, **rest):
                counted.append(len(at))
                return np.add.reduceat(a, at, **rest)

    monkeypatch.setattr(near_dup, "np", Numpy())
    groups = near_dup.link_sets(sets, 8, 10)
    assert len({groups.find(i) for i in range(len(sets))}) == len(sets)
    assert sum(counted) == 0
    near_dup.link_across(sets[:100], sets[100:], 8, 10, list(range(400)))
    assert sum(counted) == 0
