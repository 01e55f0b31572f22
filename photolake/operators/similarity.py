"""Hamming similarity of 64-bit perceptual hashes: pairs within a radius, and clusters of them.

All strategies are exact and work on distinct hashes. Few hashes: a nested-loop join whose small side is broadcast after
counting it. Small radius: pigeonhole bands, an equi-join on (band, value). Otherwise a block join: each pair of
blocks of hashes is compared by one task in numpy, and only pairs within the radius leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions.exprs import hamming
from photolake.operators.graph import components
from photolake.storage import stored

#: Up to so many distinct hashes (8 bytes each) are broadcast.
NESTED_LOOP = 50_000
#: Radius up to which bands prune enough.
BANDED = 7
BLOCK = 8192
#: Hashes of a task of the nested loop.
NESTED_TASK = 4096
#: Up to so many pairs (16 bytes each) are joined to clusters in one task.
ONE_TASK = 500_000


def _nested(h: DataFrame, r: int, n: int) -> DataFrame:
    # the hashes are few bytes for their work, which would be one task
    pairs = h.repartition(math.ceil(n / NESTED_TASK)).alias("x").join(F.broadcast(h.alias("y")), (F.col("x.h") < F.col("y.h")) & (hamming(F.col("x.h"), F.col("y.h")) <= r))
    return pairs.select(F.col("x.h").alias("a"), F.col("y.h").alias("b"), hamming(F.col("x.h"), F.col("y.h")).cast("int").alias("dist"))


def _banded(h: DataFrame, r: int) -> DataFrame:
    cuts = [64 * i // (r + 1) for i in range(r + 2)]
    bands = F.array(*(F.struct(F.lit(i).alias("band"), (F.shiftrightunsigned("h", a).bitwiseAND(F.lit((1 << b - a) - 1)) if b - a < 64 else F.col("h")).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))
    keyed = h.select("h", F.explode(bands).alias("k")).select("h", "k.band", "k.value")
    pairs = keyed.alias("x").join(keyed.alias("y"), ["band", "value"]).where("x.h < y.h")
    far = hamming(F.col("x.h"), F.col("y.h"))
    return pairs.where(far <= r).select(F.col("x.h").alias("a"), F.col("y.h").alias("b"), far.cast("int").alias("dist")).distinct()


def _blocks(h: DataFrame, r: int, n: int) -> DataFrame:
    parts = math.ceil(n / BLOCK)

    def run(key, x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = x.column("h").to_numpy().view(np.uint64), y.column("h").to_numpy().view(np.uint64)
        out = [np.zeros((0, 3), np.int64)]
        for at in range(0, len(a), 512):
            d = np.bitwise_count(a[at : at + 512, None] ^ b[None, :])
            i, j = np.nonzero(d <= r)
            out.append(np.stack([a[at + i].view(np.int64), b[j].view(np.int64), d[i, j].astype(np.int64)], axis=1))
        rows = np.concatenate(out)
        rows = rows[rows[:, 0] < rows[:, 1]] if key[0].as_py() == key[1].as_py() else np.stack([rows[:, :2].min(1), rows[:, :2].max(1), rows[:, 2]], axis=1)
        return pa.table({"a": rows[:, 0], "b": rows[:, 1], "dist": rows[:, 2].astype(np.int32)})

    own = F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int")
    left = h.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(parts - 1))))
    # a column of its own: one that both sides have is pruned from the second where a join takes the pairs
    right = h.select(F.col("h").alias("h"), own.alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j"))))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "a long, b long, dist int")


def hamming_pairs(images: DataFrame, radius: int, column: str = "dhash", strategy: str | None = None) -> DataFrame:
    """(a, b, dist) of distinct hashes a < b within ``radius``. ``strategy``: nested, banded or blocks; chosen by count if None."""
    h = stored(images.select(F.col(column).alias("h")).where("h is not null").distinct(), "hashes")
    n = h.count()
    strategy = strategy or ("nested" if n <= NESTED_LOOP else "banded" if radius <= BANDED else "blocks")
    return {"nested": lambda: _nested(h, radius, max(n, 1)), "banded": lambda: _banded(h, radius), "blocks": lambda: _blocks(h, radius, max(n, 1))}[strategy]()


def image_pairs(images: DataFrame, radius: int) -> DataFrame:
    """(a, b, dist) of image ids a < b within ``radius``, equal hashes included."""
    images = stored(images.select("id", "dhash"), "dhashes")
    pairs = hamming_pairs(images, radius)
    i, j = images.select(F.col("id").alias("a"), F.col("dhash").alias("ha")), images.select(F.col("id").alias("b"), F.col("dhash").alias("hb"))
    equal = i.join(j, F.col("ha") == F.col("hb")).where("a < b").select("a", "b", F.lit(0).alias("dist"))
    apart = pairs.select(F.col("a").alias("ha"), F.col("b").alias("hb"), "dist").join(i, "ha").join(j, "hb")
    return equal.union(apart.select(F.least("a", "b"), F.greatest("a", "b"), "dist"))


def clusters(images: DataFrame, radius: int, pairs: DataFrame | None = None) -> DataFrame:
    """(id, label): single-linkage clusters of two images or more; the label is the least id in it."""
    pairs = (hamming_pairs(images, radius) if pairs is None else pairs).where(F.col("dist") <= radius)
    found = components(pairs, one_task=ONE_TASK).select(F.col("node").alias("dhash"), F.col("component"))
    each = images.select("id", "dhash").join(found, "dhash", "left").withColumn("component", F.coalesce("component", "dhash"))
    groups = each.groupBy("component").agg(F.min("id").alias("label"), F.count("*").alias("n")).where("n > 1")
    return each.join(groups, "component").select("id", "label", F.col("n").alias("size"))
