"""Scalar functions as Column expressions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that mean a deletion candidate.
USELESS_LABELS = ("document", "receipt", "screenshot", "product in a store", "broken item to replace", "whiteboard or notes")

# Parts of class names and the label each means; the first that occurs wins.
LABEL_KEYWORDS = (
    ("web site", "document"),
    ("website", "document"),
    ("menu", "document"),
    ("book jacket", "document"),
    ("comic book", "document"),
    ("envelope", "document"),
    ("packet", "document"),
    ("carton", "document"),
    ("binder", "document"),
    ("notebook", "document"),
    ("crossword", "document"),
    ("monitor", "screenshot"),
    ("screen", "screenshot"),
    ("price tag", "product in a store"),
)

# Prompts of the zero-shot classifier by label.
PROMPTS = {
    "document": ("a scan of a document", "a photo of a printed page of text"),
    "receipt": ("a photo of a receipt", "a photo of a paper bill"),
    "screenshot": ("a screenshot of a phone screen", "a screenshot of a computer screen"),
    "product in a store": ("a photo of a product on a store shelf", "a price tag in a shop", "a product label or packaging"),
    "broken item to replace": ("a close-up photo of a broken part", "a photo of a hardware part to match at the store"),
    "whiteboard or notes": ("a photo of a whiteboard", "a photo of handwritten notes"),
    "photo": ("a photograph of a person", "a landscape photograph", "a photo of food", "a photo of an animal", "a snapshot of an event"),
}

EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".heic", ".heif")


def hamming(a: Column, b: Column) -> Column:
    """Number of different bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def short_path(path: Column, most: int = 48) -> Column:
    """The path, or ``...`` and its last 48 bytes."""
    tail = F.substring(path.cast("binary"), -most, most).cast("string")
    return F.when(F.octet_length(path) <= most, path).otherwise(F.concat(F.lit("..."), tail))


def rounded(v: Column) -> Column:
    """A number without decimals as text; ties go to even."""
    return F.rint(v).cast("long").cast("string")


def pixels(width: Column | None = None, height: Column | None = None) -> Column:
    return (F.col("width") if width is None else width).cast("long") * (F.col("height") if height is None else height).cast("long")


def unsigned(v: Column) -> Column:
    """A bit-cast 64-bit hash as the unsigned number it stands for."""
    return F.conv(F.hex(v), 16, 10).cast("decimal(20,0)")


def label_bucket(name: Column) -> Column:
    """The useless label that a class name means, or ''."""
    low = F.lower(name)
    out = None
    for part, label in LABEL_KEYWORDS:
        out = F.when(low.contains(part), label) if out is None else out.when(low.contains(part), label)
    return out.otherwise("")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def utc_day(unix: Column) -> Column:
    """``yyyy-MM-dd`` of Unix seconds, in UTC whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(unix / 86400).cast("int")), "yyyy-MM-dd")


def softmax_at(logits: Column, at: Column) -> Column:
    """Softmax probability of entry ``at`` (from 1) of an array."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.exp(F.element_at(logits, at) - top) / total


def argmax(values: Column) -> Column:
    """Position (from 1) of the first greatest entry."""
    return F.array_position(values, F.array_max(values)).cast("int")
