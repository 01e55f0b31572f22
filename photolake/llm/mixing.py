"""Mixing sources to target weights by subset-sum budget fitting.

Sources in order of their names weigh 5, 2, 1, 5, ... and share all words; a target stops at three times its
source's size and the excess is shared again by weight. Each source is taken whole as often as its
target allows, and the remaining budget is fitted on its histogram of exact document lengths: a
proportional part of each length first, then a bounded-knapsack DP for the rest. So a source costs its
number of distinct lengths, not of documents. Which documents of a length are taken follows a seeded
hash: a threshold per length, found by counting hash ranges and ranking only inside one of them.

Defined results: null text: size 0; documents of size 0 are never taken. A null source is the last one.
Rows with the same id, source and text have the same hash; where such rows tie at
a threshold, the exact number that's lacking is taken of them, and since they are alike reruns agree. The empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.llm.common import small, stored

WEIGHTS = (5, 2, 1)
MOST = 3
#: Budget in words that is left to the dynamic programme.
DP_WORDS = 1 << 14
RANGES = 1024
SEED = 20240229


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ticket() -> Column:
    return F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each distinct size > 0 to take so that their words are as near to ``budget`` as found."""
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    order = np.argsort(-sizes)
    rest = budget
    if budget > 2 * DP_WORDS:
        # a proportional part of each length; some of each is given back, so that the programme has room
        take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
        take -= np.minimum(take, DP_WORDS // (2 * len(sizes) * sizes))
        rest = budget - int((take * sizes).sum())
    for i in order:
        k = min(int(counts[i] - take[i]), max(0, (rest - 2 * DP_WORDS) // int(sizes[i])))
        take[i] += k
        rest -= k * int(sizes[i])
    left = counts - take
    if not (left > 0).any() or rest <= 0:
        return take
    cap = rest + int(sizes[left > 0].max())
    mask = (1 << (cap + 1)) - 1
    reach, before, items = 1, [], []
    for i in order:
        n, part = min(int(left[i]), cap // int(sizes[i])), 1
        while n > 0:
            part = min(part, n)
            before.append(reach)
            items.append((i, part))
            reach |= (reach << (part * int(sizes[i]))) & mask
            n -= part
            part *= 2
        if reach >> rest & 1:
            break
    best = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    over = reach >> (rest + 1)
    if over and (over & -over).bit_length() < rest - best:
        best = rest + (over & -over).bit_length()
    for (i, part), reached in zip(reversed(items), reversed(before), strict=True):
        if not reached >> best & 1:
            take[i] += part
            best -= part * int(sizes[i])
    return take


def _fit(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    sizes, counts = (table.column(c).to_numpy() for c in ("size", "n"))
    whole = int(table.column("source_size")[0].as_py())
    target = min(round(table.column("target")[0].as_py()), MOST * whole)
    copies = target // whole if whole else 0
    extra = fit_budget(sizes, counts, target - copies * whole)
    return table.select(["source", "size", "source_size", "target"]).append_column("copies", pa.array(np.full(len(sizes), copies, np.int64))).append_column("extra", pa.array(extra))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with a double column target: weighted shares, capped and shared again."""
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1))
    ranked = stored(ranked, "sources")
    level = 0.0
    while True:
        above = F.col("weight") * level > MOST * F.col("source_size")
        total, capped, weight = ranked.agg(F.sum("source_size"), F.sum(F.when(above, MOST * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        now = ((total or 0) - (capped or 0)) / weight if weight else level
        if now <= level:
            break
        level = now
    return ranked.select("source", "source_size", F.least(F.col("weight") * level, (MOST * F.col("source_size")).cast("double")).alias("target"))


def plan_mix(docs: DataFrame) -> DataFrame:
    """(source, size, source_size, target, copies, bound, within, ties): a document of that source and size is taken ``copies``
    times, and once more if its ticket is below ``bound``; of the ``ties`` rows at the bound ``within`` are."""
    rows = stored(docs.select(F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _ticket().alias("ticket")), "tickets")
    ranges = rows.groupBy("source", "size", F.shiftright("ticket", 54).alias("range")).agg(F.count("*").alias("n"))
    ranges = stored(ranges, "ranges")
    lengths = ranges.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    schema = "source string, size long, source_size long, target double, copies long, extra long"
    same = lengths.where("size > 0").withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    fitted = stored(same.groupBy("source").applyInArrow(_fit, schema), "fitted")
    # the range in which the last document of a length is, and how many it lacks there
    run = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    keys = F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size"))
    ends = fitted.where("extra > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), "extra").join(ranges.withColumn("upto", F.sum("n").over(run)), keys)
    ends = ends.where("upto >= extra and upto - n < extra").select("s", "z", "range", (F.col("extra") - F.col("upto") + F.col("n")).alias("lacks"))
    ends = stored(ends, "ends")
    inside = rows.withColumn("r", F.shiftright("ticket", 54)).join(small(ends, ends.count(), 64), keys & (F.col("r") == F.col("range")))
    # equal tickets are one row from here on
    inside = inside.groupBy("source", "size", "ticket", "lacks").agg(F.count("*").alias("ties"))
    inside = inside.withColumn("upto", F.sum("ties").over(Window.partitionBy("source", "size").orderBy("ticket").rowsBetween(Window.unboundedPreceding, 0)))
    bounds = inside.where("upto >= lacks and upto - ties < lacks").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("ticket").alias("bound"), (F.col("lacks") - F.col("upto") + F.col("ties")).alias("within"), "ties")
    return fitted.join(bounds, keys, "left").drop("s", "z", "extra")


#: Names of the columns that are added to a user's table while it's mixed.
OWN = "__mix_"


def _taken(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with ``OWN`` columns: words, source_size, target, copies."""
    some = plan.where("within < ties").limit(1).count() > 0
    plan = plan.select(*[F.col(c).alias(OWN + c) for c in plan.columns])
    own = lambda c: F.col(OWN + c)
    rows = docs.withColumns({OWN + "words": n_words(docs["text"]), OWN + "ticket": F.xxhash64(F.lit(SEED), docs["doc_id"], docs["text"])})
    bytes_ = plan.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(own("source")), F.lit(0)) + 80), F.lit(0))).first()[0]
    met = rows.join(small(plan, bytes_, 1), own("source").eqNullSafe(docs["source"].cast("string")) & (own("size") == own("words")), "left")
    once = F.coalesce((own("ticket") <= own("bound")).cast("long"), F.lit(0))
    out = met.withColumn(OWN + "copies", F.coalesce(own("copies") + once, F.lit(0)))
    if not some:
        return out
    tied = F.coalesce((own("ticket") == own("bound")) & (own("within") < own("ties")), F.lit(False))
    # rows that tie are alike: written with numbers, each part of the table counts its own
    rest = stored(met.where(tied).withColumn(OWN + "part", F.spark_partition_id()).withColumn(OWN + "at", F.monotonically_increasing_id()), "ties")
    group = [OWN + "source", OWN + "size"]
    parts = rest.groupBy(*group, OWN + "part").agg(F.count("*").alias(OWN + "n"))
    ahead = F.sum(OWN + "n").over(Window.partitionBy(*group).orderBy(OWN + "part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored(parts.select(F.col(group[0]).alias(OWN + "s"), F.col(group[1]).alias(OWN + "z"), own("part").alias(OWN + "p"), F.coalesce(ahead, F.lit(0)).alias(OWN + "ahead")), "tieparts")
    same = own("source").eqNullSafe(own("s")) & (own("size") == own("z")) & (own("part") == own("p"))
    number = F.row_number().over(Window.partitionBy(*group, OWN + "part").orderBy(OWN + "at")) + own("ahead")
    counted = rest.join(parts, same).withColumn(OWN + "number", number).withColumn(OWN + "copies", own("copies") + (own("number") <= own("within")).cast("long"))
    return out.where(~tied).unionByName(counted.select(*out.columns))


def mix(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken (in words)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    plan = stored(plan_mix(docs), "plan")
    met = _taken(docs, plan)
    known = met.select(F.col("doc_id"), "source", F.col(OWN + "words").alias("size"), OWN + "source_size", OWN + "target", (F.col(OWN + "copies") * F.col(OWN + "words")).alias("taken"))
    # documents without words aren't in the plan; their source may be
    sources = stored(plan.select(F.col("source").alias("_s"), F.col("source_size").alias("_w"), F.col("target").alias("_t")).distinct(), "targets")
    out = known.join(small(sources, sources.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("_s"), F.lit(0)) + 48), F.lit(0))).first()[0], 1), F.col("_s").eqNullSafe(F.col("source")), "left")
    return out.select("doc_id", "source", "size", F.coalesce("_w", F.lit(0)).alias("source_size"), F.coalesce("_t", F.lit(0.0)).alias("target"), "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    columns = docs.columns
    met = _taken(docs, stored(plan_mix(docs), "plan")).where(F.col(OWN + "copies") > 0)
    return met.withColumn(OWN + "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(OWN + "copies")))).select(*[F.col(f"`{c}`") for c in columns])
