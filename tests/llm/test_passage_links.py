"""Passages that a window's first partner, its sketch or its neighbours used to hide."""

import random

import numpy as np
import pytest

from photolake.llm import passages as module
from photolake.llm.passages import LEAST, confirmed, repeated_passages, settled
from tests.llm.conftest import prose


@pytest.mark.parametrize("more", [0, 9])
def test_a_short_earlier_passage_does_not_end_the_search(table, more):
    """Document 1 holds 50 words of the passage of 90 words that documents 2 and 3 share whole; more documents make its hashes large."""
    for seed in range(6):
        whole = prose(seed, 90).split()
        rows = [(1, f"{prose(100, 60)} {' '.join(whole[20:70])} {prose(101, 60)}")]
        rows += [(2 + i, f"{prose(200 + i, 60)} {' '.join(whole)} {prose(300 + i, 60)}") for i in range(2 + more)]
        out = {r["doc_id"]: r for r in repeated_passages(table(rows)).collect()}
        assert all(out[2 + i]["n_repeated"] >= 90 for i in range(2 + more)) and all(out[2 + i]["n_dropped"] >= 90 for i in range(1, 2 + more))
        assert 50 <= out[1]["n_repeated"] <= 54 and out[1]["n_dropped"] == 0 and 50 <= out[2]["n_dropped"] <= 54


def near(x, y):
    x, y = set(x.tolist()), set(y.tolist())
    return 10 * len(x & y) >= 8 * len(x | y)


def chained(n, seed):
    """Windows around one pivot, each a copy of an earlier one with some shingles changed, so similarity fades along the chain."""
    r = random.Random(seed)
    windows, new = [np.arange(60, dtype=np.uint32)], 1000
    while len(windows) < n:
        copy = r.choice(windows[-6:]).copy()
        for k in r.sample([k for k in range(60) if k != 30], r.choice([0, 1, 2, 4, 6])):
            copy[k] = new
            new += 1
        windows.append(copy)
    return windows


@pytest.mark.parametrize("seed", range(4))
def test_settled_covers_what_all_pairs_cover(seed):
    windows = chained(60, seed)
    n = len(windows)
    late, either = [np.zeros(60, bool) for _ in range(n)], [np.zeros(60, bool) for _ in range(n)]
    copies = {}
    for i, x in enumerate(windows):
        copies.setdefault(x.tobytes(), []).append(i)
    for i, a, b, j, c, d in settled(list(range(n)), windows, [30] * n):
        assert j < i and near(windows[i][a : b + 1], windows[j][c : d + 1])
        late[i][a : b + 1] = either[i][a : b + 1] = either[j][c : d + 1] = True
    for i in range(n):
        for j in range(i):
            p = module._grown(windows[i], windows[j], (30, 0, 59), (30, 0, 59))
            if p is not None:
                assert late[i][p[0] : p[1] + 1].all() and either[j][p[2] : p[3] + 1].all()


def test_a_pair_is_grown_past_its_windows():
    x = np.random.default_rng(3).integers(2, 2**63, 140, dtype=np.uint64)
    y = x.copy()
    y[66:74] += np.uint64(2)
    # windows end before the changed shingles, though both whole texts are near
    found = confirmed(x, y, [(1, [(30, 0, 65)], [(30, 0, 65)])])
    assert any(a == 0 and b == 139 for a, b, _, _ in found) and near(x, y)


def test_sketches_keep_pairs_whose_changes_are_around_the_pivot():
    x = np.random.default_rng(4).integers(2, 2**63, LEAST, dtype=np.uint64)
    for at in range(LEAST):
        y = x.copy()
        # five of 46 shingles changed, next to the pivot
        some = [k for k in range(max(at - 3, 0), LEAST) if k != at][:5]
        y[some] += np.uint64(2)
        assert near(x, y)
        one, two = (module._sketches([z])[0][:, at : at + 1] for z in (x, y))
        assert module._near(one, two).all()
