"""A library on disk and its runs: scan, analyse, tag, review, export."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake import schema
from photolake.operators import detect, feedback, labels, manifest, review
from photolake.operators.graph import numbered
from photolake.operators.overrides import load_overrides
from photolake.options import Options
from photolake.sources.files import list_files, read_images
from photolake.storage import Table, stored


def upsert_images(images: DataFrame, scanned: DataFrame) -> DataFrame:
    """``images`` after a scan: known paths get the scan's columns and keep id and label, new ones get the next ids by path.

    Of several scanned rows of a path one is taken; rows of files that are gone stay.
    """
    new = scanned.select("path", *(F.col(c).alias(f"_{c}") for c in schema.SCANNED)).groupBy("path").agg(*(F.max_by(f"_{c}", F.struct("_mtime_unix", "_sha256")).alias(f"_{c}") for c in schema.SCANNED))
    known = images.join(new, "path", "left")
    known = known.withColumns({c: F.coalesce(f"_{c}", c) for c in schema.SCANNED}).select(*images.columns)
    top = images.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = numbered(new.join(images.select("path"), "path", "left_anti"), "path").crossJoin(F.broadcast(top))  # one row
    fresh = fresh.select((F.col("_top") + F.col("n")).alias("id"), "path", *(F.col(f"_{c}").alias(c) for c in schema.SCANNED), F.lit("").alias("content_label"), F.lit(0.0).alias("content_score"))
    return known.unionByName(fresh.select(*images.columns))


def scan_diff(listing: DataFrame, images: DataFrame) -> DataFrame:
    """``listing`` (path, size_bytes, mtime_unix) with status: skipped (same size and time), changed or new."""
    known = images.select("path", F.col("size_bytes").alias("_size"), F.col("mtime_unix").alias("_mtime"))
    met = listing.join(known, "path", "left")
    same = (F.col("_size") == F.col("size_bytes")) & (F.col("_mtime") == F.col("mtime_unix"))
    return met.withColumn("status", F.when(F.col("_size").isNull(), "new").when(same, "skipped").otherwise("changed")).drop("_size", "_mtime")


class Library:
    """The tables of a photo library under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        table = lambda name, columns, defaults=None, by=(): Table(spark, f"{path.rstrip('/')}/{name}", columns, defaults, by)
        self.images = table("images", schema.IMAGES, schema.IMAGE_DEFAULTS)
        self.suggestions = table("suggestions", schema.SUGGESTIONS, {}, ("category",))
        self.log = table("decision_log", schema.DECISION_LOG)
        self.thumbs = table("thumbs", schema.THUMBS)

    def decisions(self) -> DataFrame:
        return review.latest_decisions(self.log.read())

    def scan(self, *roots: str, now: int | None = None) -> dict[str, int]:
        """Index the image files under ``roots``; returns scanned, skipped, failed and total."""
        images = self.images.read()
        listing = stored(list_files(self.spark, *roots), "listing")
        todo = listing.join(images.select("path", "size_bytes", "mtime_unix"), ["path", "size_bytes", "mtime_unix"], "left_anti")
        rows = stored(read_images(todo, int(time.time()) if now is None else now), "scanned")
        total, n, failed = listing.count(), *rows.agg(F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") != "ok")).first()
        if n:
            self.images.write(upsert_images(images, rows.where("status = 'ok'")))
        return {"scanned": n, "skipped": total - n - failed, "failed": failed, "total": total}

    def analyze(self, options: Options | None = None, overrides: str | None = None) -> tuple[dict[str, int], list[str]]:
        """Rewrite the suggestions; returns flagged images per category and the log of learned thresholds."""
        options, log = feedback.learn(self.suggestions.read(), self.decisions(), options or Options())
        rules = load_overrides(self.spark, overrides)
        self.suggestions.write(detect.detect_all(self.images.read(), options, rules if rules.limit(1).count() else None))
        return {r["category"]: r["n"] for r in detect.summarise(self.suggestions.read()).collect()}, log  # a row for each category

    def tag(self, path: str) -> int:
        """Import a label file; returns how many of its rows matched."""
        rows = self.spark.read.schema(schema.LABELS).json(path, multiLine=True).withColumn("_at", F.monotonically_increasing_id())  # one file, one task: file order
        images, n = labels.apply_labels(self.images.read(), stored(rows, "labels"), "_at")
        self.images.write(images)
        return n

    def decide(self, image_id: int, action: str, now: int | None = None) -> None:
        if action not in review.ACTIONS:
            raise ValueError(f"unknown action: {action}")
        log = self.log.read()
        seq = (log.agg(F.max("seq")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(seq, image_id, action, int(time.time()) if now is None else now)], schema.DECISION_LOG)
        self.log.append(row)

    def apply(self, rows: DataFrame) -> None:
        """Append log rows (from ``review``)."""
        log = self.log.read()
        top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
        self.log.append(rows.crossJoin(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("_top")).select(*log.columns))

    def summary(self) -> DataFrame:
        return review.summary(self.images.read(), self.suggestions.read(), self.decisions())

    def groups(self, category: str) -> DataFrame:
        return review.groups(self.images.read(), self.suggestions.read(), self.decisions(), category)

    def manifest(self) -> DataFrame:
        return manifest.manifest(self.images.read(), self.suggestions.read(), self.decisions())
