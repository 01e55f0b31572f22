import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from photolake.llm.common import FastSketch, UnionFind, components, hash_strings, plan_bands, runs, shingle_hashes, sketch_rows, split_words, text_slices


def test_split_words():
    codes, words, offsets = split_words(pa.array([" A b\tB\x0b", None, "", "É x"]))
    assert [words[c].as_py() for c in codes] == ["a", "b", "b", "É x"] and offsets.tolist() == [0, 3, 3, 3, 4]


def test_shingles_and_slices():
    h = hash_strings(pa.array(["a", "b", "c", "d"]))
    rows = list(shingle_hashes(h, np.array([0, 4, 4]), 3))
    assert [len(r) for r in rows] == [2, 0]
    assert [len(r) for r in shingle_hashes(h, np.array([0, 2, 4]), 3)] == [1, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 5, None, "y" * 50, "z"])], names=["text"])
    assert [b.num_rows for b in text_slices(iter([batch]), limit=8)] == [2, 1, 1]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 2**63, 40, dtype=np.uint64)])
    s = FastSketch(512)
    assert abs((s(a) == s(b)).mean() - 360 / 440) < 0.08
    assert (s(a[:1]) != np.iinfo(np.uint64).max).all()
    many = sketch_rows(np.concatenate([a, b, a[:1]]), np.repeat([0, 1, 2], [400, 400, 1]), 3, 64)
    one = FastSketch(64)
    assert (many[0] == one(a)).all() and (many[1] == one(b)).all() and (many[2] == one(a[:1])).all()
    assert plan_bands(0.85, 48) == 8 and plan_bands(0.8, 48) == 6


def test_runs_and_union_find():
    assert runs(np.array([1, 1, 2, 3, 3, 3])).tolist() == [0, 0, 2, 3, 3, 3]
    u = UnionFind(5)
    u.union(3, 4)
    u.union(4, 1)
    assert [u.find(i) for i in range(5)] == [0, 1, 2, 1, 1]


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    u = UnionFind(400)
    for a, b in edges:
        u.union(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == u.find(n) for e in edges if e[0] != e[1] for n in e)
    hub = spark.range(1, 2000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(hub).where("component = 0").count() == 2000
