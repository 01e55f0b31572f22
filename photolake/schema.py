"""Schemas of the library's tables. Stored columns are never null: sentinels 0 and '' stand for unknown."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    """``name type, ...`` without needing a session."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "decimal(20:0)": T.DecimalType(20, 0)}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (part.split() for part in text.split(","))])


IMAGES = _schema("id long, path string, sha256 string, dhash long, size_bytes long, mtime_unix long, scanned_at_unix long, width int, height int, blur_var double, brightness double, colorfulness double, taken_at_unix long, gphotos_url string, content_label string, content_score double")
SUGGESTIONS = _schema("image_id long, category string, score double, reason string, cluster_id long, is_keeper boolean")
DECISIONS = _schema("image_id long, action string, decided_at_unix long")
DECISION_LOG = _schema("seq long, image_id long, action string, decided_at_unix long")
THUMBS = _schema("image_id long, jpeg binary")
LABELS = _schema("path string, label string, score double")
OVERRIDES = _schema("prefix string, blur_threshold double, dark_threshold double, bright_threshold double, useless_threshold double")
MANIFEST = _schema("id long, path string, dhash decimal(20:0), taken_at long, gphotos_url string")

IMAGE_DEFAULTS = {f.name: "" if isinstance(f.dataType, T.StringType) else 0 for f in IMAGES.fields if f.name not in ("id", "path")}

#: Columns that a scan sets; the others of a known path stay as they are.
SCANNED = ("sha256", "dhash", "size_bytes", "mtime_unix", "scanned_at_unix", "width", "height", "blur_var", "brightness", "colorfulness", "taken_at_unix", "gphotos_url")

EXACT, NEAR, LOW_QUALITY, USELESS, OVERSHOOT = CATEGORIES = ("exact_duplicate", "near_duplicate", "low_quality", "useless_content", "overshoot")
