"""Nearest thumbnail of the same day, with an ambiguity margin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions.exprs import hamming

MOST = 4
MARGIN = 6
NONE = 999


def match_by_day(entries: DataFrame, candidates: DataFrame, most: int = MOST, margin: int = MARGIN) -> DataFrame:
    """Per entry (id, taken_at_unix, dhash): qid, cid, best, second_best, status, among candidates (cid, day, h) of its UTC day.

    accepted: best <= most and second_best - best >= margin (a lone candidate passes); ambiguous: too near; unmatched: the rest,
    also entries without a time. The two nearest come from an aggregate by distance that combines map-side, ties by cid.
    """
    q = entries.select(F.col("id").alias("qid"), "dhash", F.when(F.col("taken_at_unix") != 0, F.floor(F.col("taken_at_unix") / 86400)).alias("day"))
    met = q.join(candidates.select("cid", "day", "h"), "day").select("qid", F.struct(hamming(F.col("dhash"), F.col("h")).cast("int").alias("d"), F.col("cid")).alias("c"))
    # at most 65 distances an entry, counted map-side; the pairs are made once
    far = met.groupBy("qid", F.col("c.d").alias("d")).agg(F.min("c.cid").alias("cid"), (F.min("c.cid") < F.max("c.cid")).alias("several"))
    near = far.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("d", "cid", "several"))).alias("near"))
    near = near.select("qid", F.get("near", F.lit(0)).alias("one"), F.when(F.get("near", F.lit(0))["several"], F.get("near", F.lit(0))["d"]).otherwise(F.get("near", F.lit(1))["d"]).alias("two"))
    out = q.select("qid").join(near, "qid", "left")
    best, two = F.col("one.d"), F.coalesce("two", F.lit(NONE))
    status = F.when(best.isNull() | (best > most), "unmatched").when(two - best < margin, "ambiguous").otherwise("accepted")
    return out.select("qid", F.col("one.cid").alias("cid"), best.alias("best"), two.cast("int").alias("second_best"), status.alias("status"))
