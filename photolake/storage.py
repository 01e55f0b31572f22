"""Tables on shared storage: cut lineage, versioned tables with an atomic switch, missing columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of at most so many bytes (counted before, never guessed) may be broadcast.
BROADCAST_BYTES = 24 << 20


#: Folders made for applications that name none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or a new local one for each application where it is unset (tests).

    A local folder serves a local master only; on a cluster without the setting this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _OWN.get(spark.sparkContext.applicationId)
        if base is None:
            folder = tempfile.mkdtemp(prefix="photolake-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = _OWN[spark.sparkContext.applicationId] = f"file://{folder}"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends, column pruning stays."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint where its counted size allows it; Spark's own join choice otherwise."""
    return F.broadcast(df) if n_rows * row_bytes <= BROADCAST_BYTES else df


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place, jvm.org.apache.hadoop.fs.Path


class Table:
    """A Parquet table in versioned folders, numbered from 1; the highest one with a ``_SUCCESS`` mark is live.

    The mark is written last, so a failed write changes nothing and there's no moment without a live version. ``append`` adds
    files of its own to a new version that lists its parts, without rewriting what is there. The version before the live one is kept for its
    readers, older ones are removed. Columns that a stored version lacks are filled with their defaults on reading.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, defaults: dict | None = None, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.defaults, self.partition_by = spark, path.rstrip("/"), schema, defaults or {}, partition_by

    def _versions(self) -> list[int]:
        fs, place, new = _filesystem(self.spark, self.path)
        if not fs.exists(place):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(place)]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(new(f"{self.path}/{n}/_SUCCESS")))

    def version(self) -> str | None:
        """The live version's folder."""
        done = self._versions()
        return f"v{done[-1]}" if done else None

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        parts = [f"{self.path}/{version}", *self._appended(version)]
        return with_columns(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(self.spark.read.parquet, parts)), self.schema, self.defaults)

    def _appended(self, version: str) -> list[str]:
        fs, place, new = _filesystem(self.spark, f"{self.path}/added-{version}")
        if not fs.exists(place):
            return []
        parts = [f"{self.path}/added-{version}/{f.getPath().getName()}" for f in fs.listStatus(place)]
        return sorted(x for x in parts if fs.exists(new(f"{x}/_SUCCESS")))

    def write(self, df: DataFrame) -> None:
        done = self._versions()
        version = done[-1] + 1 if done else 1
        fs, place, new = _filesystem(self.spark, f"{self.path}/v{version}")
        fs.delete(place, True)  # what a failed write left
        with_columns(df, self.schema, self.defaults).write.partitionBy(*self.partition_by).parquet(f"{self.path}/v{version}")
        for old in done[:-1]:
            fs.delete(new(f"{self.path}/v{old}"), True)
            fs.delete(new(f"{self.path}/added-v{old}"), True)

    def append(self, df: DataFrame) -> None:
        """Add rows as files of their own; a failed append adds none."""
        version = self.version()
        if version is None:
            self.write(df)
        else:
            with_columns(df, self.schema, self.defaults).write.parquet(f"{self.path}/added-{version}/{uuid.uuid4().hex}")


def with_columns(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """``df`` in the columns of ``schema``: cast, and filled with defaults where they lack or are null."""
    out = []
    for f in schema.fields:
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType))
        out.append(value.alias(f.name))
    return df.select(*out)
