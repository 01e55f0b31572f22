"""Per-album thresholds: the longest prefix of a path decides, with its whole rule."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake import schema
from photolake.storage import small

FIELDS = ("blur_threshold", "dark_threshold", "bright_threshold", "useless_threshold")


def load_overrides(spark: SparkSession, path: str | None) -> DataFrame:
    """Rules of a JSON array file, in file order; no path or no file: no rules; malformed: an error."""
    rows = []
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            rows = [(r.get("prefix", ""), *(None if r.get(k) is None else float(r[k]) for k in FIELDS)) for r in json.load(f)]
    return spark.createDataFrame(rows, schema.OVERRIDES)


def resolve(images: DataFrame, rules: DataFrame) -> DataFrame:
    """``images`` with the fields of the winning rule (null: not set), named ``ov_`` and the field, and ``ov_prefix``.

    Rules are written by hand, so their number is small; they're broadcast after a count, and a path looks up its own
    prefixes of the lengths that occur, longest first, instead of trying every rule.
    """
    rules = rules.dropDuplicates(["prefix"])
    lengths = sorted((r[0] for r in rules.select(F.length("prefix")).distinct().collect()), reverse=True)  # as many as prefixes have lengths
    own = [F.col(f).alias(f"ov_{f}") for f in FIELDS]
    if not lengths:
        return images.withColumns({"ov_prefix": F.lit(None).cast("string")} | {f"ov_{f}": F.lit(None).cast("double") for f in FIELDS})
    known = rules.agg(F.sort_array(F.collect_set("prefix")).alias("_known"))
    head = F.coalesce(*(F.when((F.length("path") >= n) & F.array_contains("_known", F.substring("path", 1, n)), F.substring("path", 1, n)) for n in lengths))
    named = images.crossJoin(F.broadcast(known)).withColumn("ov_prefix", head).drop("_known")  # one row
    return named.join(small(rules.select(F.col("prefix").alias("_p"), *own), rules.count(), 256), F.col("ov_prefix") == F.col("_p"), "left").drop("_p")


def effective(field: str, default: float) -> Column:
    return F.coalesce(F.col(f"ov_{field}"), F.lit(float(default)))
