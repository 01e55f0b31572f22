"""Delete manifests: what to delete, as JSON and CSV, and what needs a hand."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions.exprs import unsigned

HEADER = ("id", "path", "dhash", "taken_at_unix", "gphotos_url")


def _entries(images: DataFrame) -> DataFrame:
    return images.select("id", "path", unsigned(F.col("dhash")).alias("dhash"), F.col("taken_at_unix").alias("taken_at"), "gphotos_url")


def confirmed(images: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries of images that are decided to be deleted."""
    return _entries(images.join(decisions.where("action = 'delete'").select(F.col("image_id").alias("id")), "id", "left_semi"))


def candidates(images: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Entries of all flagged images, each once."""
    return _entries(images.join(suggestions.where("not is_keeper").select(F.col("image_id").alias("id")), "id", "left_semi"))


def manifest(images: DataFrame, suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Only the decided deletions if there are any, else all flagged images; by time, then id."""
    decided = bool(decisions.where("action = 'delete'").limit(1).count())
    return (confirmed(images, decisions) if decided else candidates(images, suggestions)).orderBy("taken_at", "id")


def split_by_url(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with and without a URL."""
    known = F.coalesce("gphotos_url", F.lit("")) != ""
    return entries.where(known), entries.where(~known)


def read_manifest(spark, path: str) -> DataFrame:
    return spark.read.schema("id long, path string, dhash decimal(20,0), taken_at long, gphotos_url string").json(path, multiLine=True)


def write_json(entries: DataFrame, path: str) -> int:
    """One indented JSON array at a local ``path`` (``[]`` without entries), streamed row by row; returns the number of entries."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in entries.toLocalIterator():
            item = row.asDict()
            item["dhash"] = int(item["dhash"])
            f.write(("," if n else "") + "\n  " + json.dumps(item, ensure_ascii=False, indent=2).replace("\n", "\n  "))
            n += 1
        f.write("\n]\n" if n else "]\n")
    return n


def write_csv(entries: DataFrame, path: str) -> None:
    """CSV part files with a header."""
    entries.withColumnRenamed("taken_at", "taken_at_unix").select(*HEADER).write.csv(path, header=True)


def tally(results: DataFrame, most: int | None = None) -> DataFrame:
    """(outcome, n) of a deletion run's results (id, outcome), of the first ``most`` by id if given."""
    rows = results if most is None else results.orderBy("id").limit(most)
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))
