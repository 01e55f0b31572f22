"""Thresholds that learn from decisions on an earlier run's suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.options import HeuristicClassifier, Options
from photolake.schema import LOW_QUALITY, USELESS

LEAST_DECISIONS = 20
KEEP_RATE = 0.5


def decision_counts(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """(category, total, kept) of decided non-keepers; an image counts in every category that flagged it."""
    met = suggestions.where("not is_keeper").join(decisions.select("image_id", "action"), "image_id")
    return met.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("action") == "keep").alias("kept"))


def learn(suggestions: DataFrame, decisions: DataFrame, options: Options) -> tuple[Options, list[str]]:
    """Options with thresholds made stricter where the user kept more than half of the flagged, and a log of it. Nothing is persisted."""
    if options.no_learn:
        return options, []
    counts = {r["category"]: (r["total"], r["kept"]) for r in decision_counts(suggestions, decisions).collect()}  # a row for each category
    log = []
    fires = {c: n >= LEAST_DECISIONS and k / n > KEEP_RATE for c, (n, k) in counts.items()}
    if fires.get(LOW_QUALITY):
        total, kept = counts[LOW_QUALITY]
        now = options.blur_threshold * 0.75
        log.append(f"blur threshold tightened {options.blur_threshold:.0f} -> {now:.0f} ({kept} of {total} low_quality flags kept)")
        options = options.but(blur_threshold=now)
    if fires.get(USELESS) and isinstance(options.classifier, HeuristicClassifier):
        total, kept = counts[USELESS]
        old = options.classifier
        now = max(0.0, min(1.0, old.threshold * 1.15))
        log.append(f"useless threshold raised {old.threshold:.2f} -> {now:.2f} ({kept} of {total} useless_content flags kept)")
        options = options.but(classifier=HeuristicClassifier(old.max_colorfulness, old.min_brightness, now))
    return options, log
