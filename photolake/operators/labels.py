"""Content labels: import, zero-shot classification from embeddings, classes of a pluggable model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.functions.exprs import USELESS_LABELS, argmax, label_bucket, softmax_at


def apply_labels(images: DataFrame, labels: DataFrame, order: str | None = None) -> tuple[DataFrame, int]:
    """``images`` with imported labels by path, and how many label rows matched a path (repeats counted).

    Of several rows of a path the last by ``order`` wins (without it: the greatest score, then label).
    """
    key = F.col(order) if order else F.struct("score", "label")
    matched = labels.join(images.select("path"), "path", "left_semi").count()
    last = labels.groupBy("path").agg(F.max_by(F.struct("label", "score"), key).alias("_l"))
    met = images.join(last, "path", "left")
    out = met.withColumns({"content_label": F.coalesce("_l.label", "content_label"), "content_score": F.coalesce("_l.score", "content_score")})
    return out.select(*images.columns), matched


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1; zero vectors stay."""
    v = v.cast("array<double>")
    norm = F.sqrt(_dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def zero_shot(images: DataFrame, prompts: DataFrame, scale: float = 100.0) -> DataFrame:
    """(id, label, score) of images (id, vector) for prompts (prompt, bucket, vector).

    The prompt with the greatest softmax of scaled cosines wins; its bucket is the label if that is a useless one, else
    ``photo``; the score is that prompt's own probability. The prompts are a written list, so they're one broadcast row.
    """
    table = prompts.select("prompt", "bucket", unit(F.col("vector")).alias("v")).agg(F.sort_array(F.collect_list(F.struct("prompt", "bucket", "v"))).alias("p"))
    met = images.select("id", unit(F.col("vector")).alias("v")).crossJoin(F.broadcast(table))  # one row
    met = met.withColumn("logits", F.transform("p", lambda p: F.lit(scale) * _dot(F.col("v"), p["v"]))).withColumn("best", argmax(F.col("logits")))
    bucket = F.element_at(F.col("p.bucket"), F.col("best"))
    return met.select("id", F.when(bucket.isin(*USELESS_LABELS), bucket).otherwise(F.lit("photo")).alias("label"), softmax_at(F.col("logits"), F.col("best")).alias("score"))


class ModelUnavailable(RuntimeError):
    """No image model is at hand."""


def classify_unlabelled(images: DataFrame, model: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(path, label, score) of images without a label; ``model`` turns (id, path) rows into (path, class_name, score).

    Classes outside the useless buckets become ``photo``; images the model leaves out are skipped.
    """
    if model is None:
        raise ModelUnavailable("give a model that maps (id, path) rows to (path, class_name, score)")
    found = model(images.where(F.col("content_label") == "").select("id", "path"))
    bucket = label_bucket(F.col("class_name"))
    return found.select("path", F.when(bucket == "", F.lit("photo")).otherwise(bucket).alias("label"), "score")


def class_list(names: list[str]) -> list[str]:
    """Class names of the 1000-class model, checked for their number."""
    if len(names) != 1000:
        raise ValueError(f"expected 1000 class names, got {len(names)}")
    return names


def first_best(scores: DataFrame, *by: str, value: str = "score", tie: str = "label") -> DataFrame:
    """The best row of each group, the first on ties."""
    return scores.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), tie))).where("_n = 1").drop("_n")
