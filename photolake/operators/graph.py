"""Graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.storage import stored


def _in_one_task(batches):
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x, y = find(root.setdefault(u, u)), find(root.setdefault(v, v))
            root[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(root.keys(), pa.int64()), pa.array([find(x) for x in root], pa.int64())], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = 0) -> DataFrame:
    """Connected components of an edge table: rows (node, component), component the least node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) over DataFrames; each
    round is written to the shared folder. Only two numbers a round reach the driver. Nodes without an
    edge to another node don't appear. Hubs are safe: minima combine map-side, joins split. Up to ``one_task`` edges
    between longs, counted first, are left to union-find in one task, which saves the rounds.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if one_task and now.count() <= one_task:
        return now.repartition(1).mapInArrow(_in_one_task, "node long, component long")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        # written, so that both sides of the join are plain shuffles, whose large partitions are split
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small-star: every edge points to a smaller node already
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        now = stored(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last:
            break
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def numbered(df: DataFrame, *order: str, column: str = "n") -> DataFrame:
    """``df`` with a row number from 1 in the given order, without putting the rows in one task.

    Rows are dealt by ranges; each range numbers its own, and a row for each range carries what is before it.
    """
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("_part").agg(F.count("*").alias("_c")).select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(base), "_part").withColumn(column, (own + F.col("_base")).cast("long")).drop("_part", "_base")  # base: a row for each range


def least(value: Column, *keys: Column) -> Column:
    """``value`` of the row that is first by ``keys``; combines map-side."""
    return F.min_by(value, F.struct(*keys))
