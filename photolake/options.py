"""Options of an analysis and the classifier protocol."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from photolake.functions.exprs import USELESS_LABELS, clamp01


class Classifier(Protocol):
    """Column expressions over an images row: label, score and whether it's useless."""

    threshold: float

    def classify(self) -> tuple[Column, Column, Column]: ...


@dataclass(frozen=True)
class HeuristicClassifier:
    """Documents, receipts and screenshots by pixel statistics; an imported label goes first and ignores the threshold."""

    max_colorfulness: float = 20.0
    min_brightness: float = 165.0
    threshold: float = 0.45

    def classify(self) -> tuple[Column, Column, Column]:
        color = clamp01((F.lit(self.max_colorfulness) - F.col("colorfulness")) / F.lit(self.max_colorfulness))
        bright = clamp01((F.col("brightness") - F.lit(self.min_brightness)) / F.lit(255.0 - self.min_brightness))
        both = (color > 0) & (bright > 0)
        mean = F.lit(0.5) * color + F.lit(0.5) * bright
        labelled = F.col("content_label") != ""
        label = F.when(labelled, F.col("content_label")).when(both, F.lit("document")).otherwise(F.lit(""))
        score = F.when(labelled, F.col("content_score")).when(both, mean).otherwise(F.lit(0.0))
        useless = F.when(labelled, F.col("content_label").isin(*USELESS_LABELS)).otherwise(both & (mean >= F.lit(self.threshold)))
        return label, score, useless


@dataclass(frozen=True)
class Options:
    """Thresholds; 0 means the default, as for an unset flag."""

    near_dist: int = 6
    subject_dist: int = 12
    subject_min: int = 5
    subject_keep: int = 3
    blur_threshold: float = 120.0
    dark_threshold: float = 16.0
    bright_threshold: float = 245.0
    classifier: Classifier = field(default_factory=HeuristicClassifier)
    no_learn: bool = False

    def __post_init__(self):
        for name, value in (("near_dist", 6), ("subject_dist", 12), ("subject_min", 5), ("subject_keep", 3), ("blur_threshold", 120.0), ("dark_threshold", 16.0), ("bright_threshold", 245.0)):
            if not getattr(self, name):
                object.__setattr__(self, name, value)

    def but(self, **changes) -> Options:
        return replace(self, **changes)
