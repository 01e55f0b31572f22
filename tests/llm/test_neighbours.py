import numpy as np
import pytest

from photolake.llm.neighbours import nearest, quantise


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = min(good.get(i, v), v)
    out = set()
    for q, v in good.items():
        if q % every:
            continue
        near = sorted((float(np.sqrt(sum((np.float64(a) - b) ** 2 for a, b in zip(v, w, strict=True)))), i) for i, w in good.items() if i != q and len(w) == len(v))[:k]
        out |= {(q, n, i, d) for n, (d, i) in enumerate(near, 1)}
    return out


def vectors(n, dim, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(7, dim))
    return [(i, [float(np.float32(x)) for x in centre[i % 7] + 0.2 * r.normal(size=dim)]) for i in range(n)]


@pytest.mark.parametrize("block", [64, 4096])
def test_against_brute_force(spark, block):
    rows = vectors(500, 12) + [(1000, [0.0] * 12), (1001, None), (1002, []), (1100, [float("nan")] + [1.0] * 11), (1200, [None] + [1.0] * 11), (1300, [float("inf")] * 12), (1400, [1.0, 2.0]), (1500, [2.0, 1.0]), (None, [1.0] * 12)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)] + [(100, rows[100][1]), (200, rows[3][1])] + [(2100, [1e200] * 12), (2101, [-1e200] * 12)]
    df = spark.createDataFrame([(i, v, i or 0, "x") for i, v in rows], "vec_id long, embedding array<double>, id long, v string")
    got = {tuple(r) for r in nearest(df, 10, 100, block=block).collect()}
    assert got == brute(rows, 10, 100)


def test_many_tiles_merge_in_rounds(spark, monkeypatch):
    from photolake.llm import neighbours

    monkeypatch.setattr(neighbours, "FAN_IN", 3)
    rows = vectors(400, 8, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in nearest(df, 5, 50, block=40).collect()} == brute(rows, 5, 50)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest(df).collect()] == [(0, 1, 1, 1.0)]
    assert nearest(df.limit(0)).count() == 0


def test_error_bounds():
    v = np.random.default_rng(1).normal(size=(50, 30))
    codes, scale, error = quantise(v)
    back = codes * scale[:, None]
    assert np.allclose(np.sqrt(((v - back) ** 2).sum(1)), error)
    far, about = np.linalg.norm(v[:, None] - v[None], axis=2), np.linalg.norm(back[:, None] - back[None], axis=2)
    assert (np.abs(far - about) <= error[:, None] + error[None] + 1e-12).all()
