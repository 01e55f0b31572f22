"""The five detectors; each gives rows of the suggestions schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.functions.exprs import USELESS_LABELS, clamp01, pixels, rounded, short_path
from photolake.operators.graph import least, numbered
from photolake.operators.overrides import effective, resolve
from photolake.operators.similarity import clusters, hamming_pairs
from photolake.options import Options
from photolake.schema import EXACT, LOW_QUALITY, NEAR, OVERSHOOT, SUGGESTIONS, USELESS
from photolake.storage import stored


def best_first() -> list[Column]:
    """More pixels, then sharper, then earlier, then the shorter path, then the lower id."""
    return [(-pixels()).alias("p"), (-F.col("blur_var")).alias("b"), F.col("taken_at_unix").alias("t"), F.octet_length("path").alias("l"), F.col("id").alias("i")]


def _rows(df: DataFrame, category: str, score: Column, reason: Column, cluster: Column | None = None, keeper: Column | None = None) -> DataFrame:
    return df.select(F.col("id").alias("image_id"), F.lit(category).alias("category"), score.cast("double").alias("score"), reason.alias("reason"), (F.lit(0) if cluster is None else cluster).cast("long").alias("cluster_id"), (F.lit(False) if keeper is None else keeper).alias("is_keeper"))


def exact_duplicates(images: DataFrame, first: int = 0) -> DataFrame:
    """Images with equal content; clusters are numbered in the order of their SHA-256 after ``first``."""
    keeper = least(F.struct("id", "path"), *best_first())
    groups = images.groupBy("sha256").agg(F.count("*").alias("n"), keeper.alias("keeper")).where("n > 1")
    groups = numbered(groups, "sha256", column="cluster")
    met = images.select("id", "sha256").join(groups, "sha256")
    is_keeper = F.col("id") == F.col("keeper.id")
    reason = F.when(is_keeper, F.concat(F.lit("best of "), F.col("n").cast("string"), F.lit(" byte-identical copies"))).otherwise(F.concat(F.lit("byte-identical to "), short_path(F.col("keeper.path"))))
    return _rows(met, EXACT, F.lit(1.0), reason, F.col("cluster") + first, is_keeper)


def near_duplicates(images: DataFrame, options: Options, pairs: DataFrame | None = None, first: int = 0) -> DataFrame:
    """Single-linkage clusters within ``near_dist`` bits; numbered by their least id after ``first``."""
    found = clusters(images, options.near_dist, pairs)
    met = images.join(found, "id")
    groups = numbered(met.groupBy("label").agg(least(F.struct("id", "path"), *best_first()).alias("keeper")), "label", column="cluster")
    met = met.join(groups, "label")
    is_keeper = F.col("id") == F.col("keeper.id")
    reason = F.when(is_keeper, F.concat(F.lit("sharpest of "), F.col("size").cast("string"), F.lit(" near-identical frames"))).otherwise(F.concat(F.lit("near-identical to "), short_path(F.col("keeper.path"))))
    return _rows(met, NEAR, F.lit(0.9), reason, F.col("cluster") + first, is_keeper)


def overshoot(images: DataFrame, options: Options, pairs: DataFrame | None = None, first: int = 0) -> DataFrame:
    """Clusters within ``subject_dist`` bits of ``subject_min`` images or more; the best ``subject_keep`` are kept."""
    found = clusters(images, options.subject_dist, pairs).where(F.col("size") >= options.subject_min)
    met = images.join(found, "id")
    groups = numbered(met.select("label").distinct(), "label", column="cluster")
    ranked = met.select("id", "label", F.row_number().over(Window.partitionBy("label").orderBy(*best_first())).alias("rn"))
    best = ranked.where(F.col("rn") <= options.subject_keep).select("id", F.lit(True).alias("best"))  # pruned map-side
    met = met.join(groups, "label").join(best, "id", "left")
    is_keeper = F.coalesce("best", F.lit(False))
    reason = F.when(is_keeper, F.concat(F.lit("keeper from a set of "), F.col("size").cast("string"), F.lit(" similar photos"))).otherwise(F.concat(F.lit("1 of "), F.col("size").cast("string"), F.lit(" photos of the same subject")))
    return _rows(met, OVERSHOOT, F.lit(0.6), reason, F.col("cluster") + first, is_keeper)


def low_quality(images: DataFrame, options: Options, rules: DataFrame | None = None) -> DataFrame:
    """Blurry, dark or over-exposed, the first that holds; 0 means not measured for blur and darkness."""
    rows, blur, dark, bright = images, F.lit(options.blur_threshold), F.lit(options.dark_threshold), F.lit(options.bright_threshold)
    if rules is not None:
        rows = resolve(images, rules)
        blur, dark, bright = (effective(f, d) for f, d in (("blur_threshold", options.blur_threshold), ("dark_threshold", options.dark_threshold), ("bright_threshold", options.bright_threshold)))
    is_blurry = (F.col("blur_var") > 0) & (F.col("blur_var") < blur)
    is_dark = (F.col("brightness") > 0) & (F.col("brightness") < dark)
    is_bright = F.col("brightness") > bright
    score = F.when(is_blurry, clamp01((blur - F.col("blur_var")) / blur)).otherwise(0.7)
    text = lambda start, column: F.concat(F.lit(start), rounded(F.col(column)), F.lit(")"))
    reason = F.when(is_blurry, text("blurry / soft focus (sharpness ", "blur_var")).when(is_dark, text("very dark (brightness ", "brightness")).otherwise(text("over-exposed (brightness ", "brightness"))
    return _rows(rows.where(is_blurry | is_dark | is_bright), LOW_QUALITY, score, reason)


def useless(images: DataFrame, options: Options, rules: DataFrame | None = None) -> DataFrame:
    """Images that the classifier calls useless; an album's own threshold decides anew, also on imported labels."""
    rows = images if rules is None else resolve(images, rules)
    label, score, flag = options.classifier.classify()
    rows = rows.withColumns({"_label": label, "_score": score, "_useless": flag})
    verdict = F.col("_useless")
    if rules is not None:
        own = F.col("ov_useless_threshold")
        verdict = F.when(own.isNotNull(), F.col("_label").isin(*USELESS_LABELS) & (F.col("_score") >= own)).otherwise(verdict)
    return _rows(rows.where(verdict), USELESS, F.col("_score"), F.col("_label"))


def detect_all(images: DataFrame, options: Options, rules: DataFrame | None = None) -> DataFrame:
    """All five categories; cluster numbers run on from exact to near to over-shot. The pairs are found once, with their distance."""
    pairs = stored(hamming_pairs(images, max(options.near_dist, options.subject_dist)), "pairs")
    last = lambda df: df.agg(F.max("cluster_id")).first()[0]
    exact = stored(exact_duplicates(images), "exact")
    n = last(exact) or 0
    near = stored(near_duplicates(images, options, pairs, n), "near")
    n = last(near) or n
    out = exact.unionByName(near).unionByName(overshoot(images, options, pairs, n)).unionByName(low_quality(images, options, rules)).unionByName(useless(images, options, rules))
    return out.select(*SUGGESTIONS.fieldNames())


def duplicate_report(images: DataFrame) -> DataFrame:
    """(sha256, copies, paths): groups of equal files with their paths in order."""
    return images.groupBy("sha256").agg(F.count("*").alias("copies"), F.sort_array(F.collect_list("path")).alias("paths")).where("copies > 1")


def summarise(suggestions: DataFrame) -> DataFrame:
    """(category, n): flagged images of each category."""
    return suggestions.where("not is_keeper").groupBy("category").agg(F.count("*").alias("n"))
