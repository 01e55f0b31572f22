"""Review: decisions, groups, summaries, and batches of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photolake.schema import DECISION_LOG

ACTIONS = ("delete", "keep", "clear")


def check_actions(log: DataFrame) -> DataFrame:
    """The log; an unknown action is an error when the row is read."""
    known = F.col("action").isin(*ACTIONS)
    return log.withColumn("action", F.when(known, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit("null"))))))


def latest_decisions(log: DataFrame) -> DataFrame:
    """(image_id, action, decided_at_unix): the last action of each image by ``seq``; ``clear`` takes it back."""
    last = log.groupBy("image_id").agg(F.max_by(F.struct("action", "decided_at_unix"), "seq").alias("l"))
    return last.where("l.action <> 'clear'").select("image_id", "l.action", "l.decided_at_unix")


def summary(images: DataFrame, suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: total images, candidates (distinct flagged images), decided, and the flagged per category as a map."""
    flagged = suggestions.where("not is_keeper")
    counts = flagged.groupBy("category").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("counts"))
    rows = [images.agg(F.count("*").alias("total")), flagged.agg(F.countDistinct("image_id").alias("candidates")), decisions.agg(F.count("*").alias("decided")), counts]
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(F.broadcast(r))  # one row each
    return out


def group_rows(images: DataFrame, suggestions: DataFrame, decisions: DataFrame, category: str) -> DataFrame:
    """Flat rows of a category: group_key, the image's columns, is_keeper, reason, score, decision.

    Images without a cluster are each a group of their own, with their negative id as key.
    """
    own = suggestions.where(F.col("category") == category)
    met = own.join(images.select(F.col("id").alias("image_id"), "path", "width", "height", "blur_var", "taken_at_unix", "gphotos_url"), "image_id").join(decisions.select("image_id", F.col("action").alias("decision")), "image_id", "left")
    key = F.when(F.col("cluster_id") == 0, -F.col("image_id")).otherwise(F.col("cluster_id"))
    return met.select(key.alias("group_key"), "cluster_id", F.col("image_id").alias("id"), "path", "width", "height", "blur_var", F.col("taken_at_unix").alias("taken_at"), "gphotos_url", "is_keeper", "reason", "score", F.coalesce("decision", F.lit("")).alias("decision"))


def groups(images: DataFrame, suggestions: DataFrame, decisions: DataFrame, category: str) -> DataFrame:
    """(cluster_id, category, images): groups with their images, keepers first, then by time and id."""
    if not category:
        raise ValueError("category is required")
    rows = group_rows(images, suggestions, decisions, category)
    item = F.struct((~F.col("is_keeper")).alias("_k"), F.col("taken_at").alias("_t"), "id", "path", "width", "height", "blur_var", "taken_at", "gphotos_url", "is_keeper", "reason", "score", "decision")
    found = rows.groupBy("group_key", "cluster_id").agg(F.sort_array(F.collect_list(item)).alias("images"))
    return found.select("cluster_id", F.lit(category).alias("category"), F.transform("images", lambda x: x.dropFields("_k", "_t")).alias("images"))


def _log(rows: DataFrame, action: str, seq: int, now: int) -> DataFrame:
    order = F.row_number().over(Window.orderBy("id"))
    return rows.select((order + seq).cast("long").alias("seq"), F.col("id").alias("image_id"), F.lit(action).alias("action"), F.lit(now).cast("long").alias("decided_at_unix")).select(*DECISION_LOG.fieldNames())


def accept_default(rows: DataFrame, seq: int = 0, now: int = 0) -> DataFrame:
    """Log rows that delete the non-keepers of ``group_rows`` which aren't deleted yet. A batch is what one screen shows."""
    return _log(rows.where((~F.col("is_keeper")) & (F.col("decision") != "delete")), "delete", seq, now)


def keep_all(rows: DataFrame, seq: int = 0, now: int = 0) -> DataFrame:
    """Log rows that take every decision in ``group_rows`` back."""
    return _log(rows.where(F.col("decision") != ""), "clear", seq, now)


def select_all(rows: DataFrame, seq: int = 0, now: int = 0) -> DataFrame:
    """Log rows that delete every non-keeper."""
    return _log(rows.where(~F.col("is_keeper")), "delete", seq, now)


def undo(before: DataFrame, after: DataFrame, seq: int = 0, now: int = 0) -> DataFrame:
    """Log rows that bring decisions (id, decision) from ``after`` back to ``before``."""
    met = before.join(after.select("id", F.col("decision").alias("_now")), "id").where("decision <> _now")
    rows = _log(met, "x", seq, now).drop("action")
    action = F.when(F.col("decision") == "", F.lit("clear")).otherwise(F.col("decision"))
    return rows.join(met.select(F.col("id").alias("image_id"), action.alias("action")), "image_id").select(*DECISION_LOG.fieldNames())
