"""Nearest neighbours by a block matrix join over int8 tiles with error bounds.

Queries and candidates are dealt into blocks of about ``BLOCK`` rows by a hash of their ids; each pair of a query
block and a candidate block is one tile, read by one task. In a tile both sides are quantised to int8 with a
scale for each vector, and one integer matrix product gives every distance up to the two
quantisation errors, which are known exactly: |d - d'| <= e(q) + e(c). Candidates whose lower bound is beyond the
k-th upper bound can't be among the k nearest; the rest are recomputed in double precision. Tiles' best k are merged by heaps,
a bounded number of tiles at a time. The result is exact: recall is 1.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
ids. Vectors of different lengths aren't compared. Rows that repeat an id count once, with the least of its vectors. A
query is no neighbour of itself. Ties go to the smaller id. With fewer candidates than k, all are returned.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.llm.common import stored

BLOCK = 4096
#: Tiles (or merged groups of tiles) that one heap merges.
FAN_IN = 32
FOUND = "query_id long, vec_id long, score double"


def _load(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order, once each, and their vectors."""
    table = table.combine_chunks()
    ids = table.column("id").to_numpy()
    lists = table.column("v").combine_chunks()
    vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    ids, where, times = np.unique(ids, return_index=True, return_counts=True)
    if (times > 1).any():
        all_ids = table.column("id").to_numpy()
        for i in np.flatnonzero(times > 1):
            where[i] = min(np.flatnonzero(all_ids == ids[i]), key=lambda r: tuple(vectors[r]))
    return ids, vectors[where]


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and Euclidean quantisation errors of rows."""
    with np.errstate(all="ignore"):
        scale = np.abs(v).max(axis=1) / 127.0
        codes = np.rint(v / scale[:, None])
        error = np.sqrt(((v - codes * scale[:, None]) ** 2).sum(axis=1))
    return np.nan_to_num(codes).astype(np.int8), scale, error


def tile(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, float, int]]:
    """(query row, distance, candidate id) of the k nearest candidates of each query."""
    qc, qs, qe = quantise(q)
    cc, cs, ce = quantise(c)
    left, right = qc.astype(np.float32), cc.astype(np.float32).T  # products of int8 codes are exact in float32 for up to 1000 components
    out = []
    wide = q.shape[1] > 1000
    with np.errstate(all="ignore"):
        q2, c2 = (qc.astype(np.float64) ** 2).sum(1) * qs**2, (cc.astype(np.float64) ** 2).sum(1) * cs**2
        for at in range(0, len(q), 256):
            rows = slice(at, at + 256)
            dots = left[rows].astype(np.float64) @ right.astype(np.float64) if wide else (left[rows] @ right).astype(np.float64)
            about2 = q2[rows, None] + c2[None, :] - 2 * dots * qs[rows, None] * cs[None, :]
            slack = 1e-9 * (q2[rows, None] + c2[None, :])
            high = np.sqrt(np.maximum(about2 + slack, 0)) + qe[rows, None] + ce[None, :]
            low = np.sqrt(np.maximum(about2 - slack, 0)) - qe[rows, None] - ce[None, :]
            own = qi[rows, None] == ci[None, :]
            high[own | np.isnan(high)] = np.inf
            low[np.isnan(low)] = -np.inf
            kth = np.partition(high, k - 1, axis=1)[:, k - 1] if k <= len(c) else np.full(len(high), np.inf)
            r, x = np.nonzero((low <= kth[:, None] * (1 + 1e-12)) & ~own)
            if not len(r):
                continue
            exact = np.zeros(len(r))
            for d in range(q.shape[1]):
                exact += (q[at + r, d] - c[x, d]) ** 2
            exact = np.sqrt(exact)
            order = np.lexsort((ci[x], exact, r))
            r, x, exact = r[order], x[order], exact[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            best = rank < k
            out += zip((at + r[best]).tolist(), exact[best].tolist(), ci[x[best]].tolist(), strict=True)
    return out


def _tile(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows = []
        if queries.num_rows and candidates.num_rows:
            qi, q = _load(queries)
            ci, c = _load(candidates)
            rows = tile(qi, q, ci, c, k)
        return pa.table({"query_id": pa.array([int(qi[r]) for r, _, _ in rows], pa.int64()), "vec_id": pa.array([i for _, _, i in rows], pa.int64()), "score": pa.array([d for _, d, _ in rows], pa.float64())})

    return run


def _merge(k: int):
    def run(table: pa.Table) -> pa.Table:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for q, i, d in zip(*(table.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
            heap = heaps.setdefault(q, [])
            if len(heap) < k:
                heapq.heappush(heap, (-d, -i))
            else:
                heapq.heappushpop(heap, (-d, -i))
        rows = [(q, rank, -i, -d) for q, heap in heaps.items() for rank, (d, i) in enumerate(sorted(heap, reverse=True), 1)]
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "rank": pa.array([r[1] for r in rows], pa.int32()), "vec_id": pa.array([r[2] for r in rows], pa.int64()), "score": pa.array([r[3] for r in rows], pa.float64())})

    return run


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows of each row whose id ``every`` divides: query_id, rank, vec_id, score."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound).withColumn("dim", F.size("v"))
    n, nq = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(nq / block))
    own = lambda parts, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = rows.where(F.col("id") % every == 0).select("id", "v", "dim", own(query_blocks, 1).alias("qb"), each(blocks).alias("cb"))
    candidates = rows.select("id", "v", "dim", own(blocks, 2).alias("cb"), each(query_blocks).alias("qb"))
    keys = ["dim", "qb", "cb"]
    # the tile's number goes along for the merge
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(lambda key, q, c: _numbered(_tile(k), key, q, c), FOUND + ", cb int")
    found = stored(found, "tiles")
    parts = max(1, math.ceil(nq / 256))
    while blocks > FAN_IN:
        blocks = math.ceil(blocks / FAN_IN)
        grouped = found.withColumn("cb", (F.col("cb") / FAN_IN).cast("int")).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
        found = grouped.groupBy("part", "cb").applyInArrow(lambda key, t: _numbered(lambda x: _merge(k)(x).drop(["rank"]), key[1:], t), FOUND + ", cb int")
        found = stored(found, "tiles")
    last = found.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    return last.groupBy("part").applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


def _numbered(f, key, *tables: pa.Table) -> pa.Table:
    """``f`` of the tables with the tile's number, the last of the key."""
    out = f(*tables)
    return out.append_column("cb", pa.array(np.full(out.num_rows, key[-1].as_py(), np.int32)))
