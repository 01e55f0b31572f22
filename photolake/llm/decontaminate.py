"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is 13 consecutive words of an
item, or a whole shorter item. In every window the term with the shortest posting list in the corpus
leads (ties: leftmost); windows that share a leading position share one list read. A posting of a leading
term at word q puts the item on the diagonal q - p. The neighbouring lists, moved by their offsets, are intersected
with it next, by looking the position up in the document, and the run of matches around the posting is
grown as far as it goes: a run of a window's length is an exact phrase match, and every such run holds
a leading position, so none is missed. Only postings of benchmark terms leave the scan.

The benchmark's side is broadcast if its counted size allows, else joined by term through a shuffle.

Defined results: null or wordless texts have no words, hits or items; rows with the same id and text get the
same result, rows with the same id and other texts their own; items without id or words take no part;
an id given to several items counts once. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.llm.common import ASCII_LOWER, ASCII_UPPER, small, stored

WINDOW = 13
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER), BREAK), "")


def _items(bench: DataFrame) -> DataFrame:
    items = bench.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    return items.where(F.size("w") > 0).distinct().withColumn("n", F.size("w"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))


def leading_terms(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(term, item_id, p, need, back, ahead): the rarest term of each window with its neighbours, nearest first."""
    items = _items(bench)
    terms = items.select(F.explode("w").alias("term")).distinct()
    n = terms.count()
    seen = _rows(docs).select(F.explode(words(F.col("text"))).alias("term"))
    lengths = seen.join(small(terms, n, 128), "term", "left_semi").groupBy("term").agg(F.count("*").alias("postings"))
    placed = items.select("item_id", "w", "n", F.posexplode("w").alias("p", "term")).join(lengths, "term", "left")
    item = Window.partitionBy("item_id", "w").orderBy("p").rowsBetween(0, window - 1)
    lead = F.min(F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), F.col("p"), F.col("term"))).over(item)
    windows = placed.select("item_id", "w", "n", "p", lead.alias("lead")).where("p <= n - least(n, {})".format(window)).select("item_id", "w", "n", "lead.*").where("postings > 0").distinct()
    return windows.select(
        "term",
        "item_id",
        "p",
        F.least("n", F.lit(window)).alias("need"),
        F.expr(f"reverse(slice(w, greatest(p - {window - 2}, 1), least(p, {window - 1})))").alias("back"),
        F.expr(f"slice(w, p + 2, {window - 1})").alias("ahead"),
    )


def postings(docs: DataFrame, lead: DataFrame) -> DataFrame:
    """The postings (doc_id, h, q, prev, next) of the leading terms, with the leading positions each may be.

    ``prev`` and ``next`` are the words around word q: entries q - 1 and q + 1 of the lists next to it.
    """
    toks = _rows(docs).select("doc_id", "h", words(F.col("text")).alias("term"))
    edge = F.array(F.lit(""))
    lists = toks.select("doc_id", "h", "term", F.concat(edge, "term").alias("prev"), F.concat(F.expr("slice(term, 2, size(term))"), edge).alias("next"))
    around = lists.where(F.size("term") > 0).select("doc_id", "h", F.posexplode(F.arrays_zip("term", "prev", "next")).alias("q", "at"))
    placed = around.select("doc_id", "h", "q", "at.term", "at.prev", "at.next")
    return placed.join(small(lead, lead.count(), 1024), "term")


def _looked_up(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc_id, h, toks, found) of ``docs``; found: what its postings have, or null."""
    lists = found.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.collect_set(F.struct("item_id", "q", "term", "need", "back", "ahead")).alias("found"))
    # matched postings grow with the corpus: always a shuffle, of texts rather than of their words
    met = _rows(docs).join(lists.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    return met.select("doc_id", "h", words(F.col("text")).alias("toks"), "found")


def _run(item: Column, doc: Column) -> Column:
    """Length of the common start of two arrays."""
    other = F.array_position(F.zip_with(item, doc, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return F.when(other > 0, other - 1).otherwise(F.greatest(F.size(item), F.size(doc))).cast("int")


def _phrases(docs: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    """(doc_id, h, toks, runs): the runs (item_id, first, last) of a window or more, an array, null without postings."""
    lead = stored(leading_terms(docs, bench, window), "leading")
    # the nearest lists first: a run of two words or more has one of the neighbours
    met = postings(docs, lead).where("need = 1 or next = get(ahead, 0) or prev = get(back, 0)")

    def grown(x: Column) -> Column:
        q = x["q"]
        left = F.reverse(F.slice("toks", F.greatest(q - (window - 2), F.lit(1)), F.least(q, F.lit(window - 1))))
        right = F.slice("toks", q + 2, F.lit(window - 1))
        return F.struct(x["item_id"].alias("item_id"), x["need"].alias("need"), (q - _run(x["back"], left)).alias("first"), (q + _run(x["ahead"], right)).alias("last"))

    rows = _looked_up(docs, met).withColumn("runs", F.transform("found", grown))
    return rows.select("doc_id", "h", F.size("toks").cast("long").alias("n_words"), F.filter("runs", lambda r: r["last"] - r["first"] + 1 >= r["need"]).alias("runs"))


def phrase_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact phrase matches: (doc_id, h, item_id, first, last), word positions of runs of a window or more."""
    return _phrases(docs, bench, window).select("doc_id", "h", F.explode("runs").alias("r")).select("doc_id", "h", "r.item_id", "r.first", "r.last").distinct()


def proximity_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, least: int = 11) -> DataFrame:
    """Proximity matches: (doc_id, h, item_id, q, terms) where ``least`` distinct words around an item's leading
    position are also within ``window`` - 1 words of its posting in the document, in any order."""
    lead = stored(leading_terms(docs, bench, window), "leading")

    def near(x: Column) -> Column:
        start = F.greatest(x["q"] - (window - 2), F.lit(1))
        around = F.slice("toks", start, x["q"] - start + window + 1)
        return F.struct(x["item_id"].alias("item_id"), x["q"].alias("q"), F.size(F.array_intersect(around, F.concat(x["back"], F.array(x["term"]), x["ahead"]))).alias("terms"))

    rows = _looked_up(docs, postings(docs, lead)).select("doc_id", "h", F.explode(F.transform("found", near)).alias("r"))
    return rows.select("doc_id", "h", "r.item_id", "r.q", "r.terms").where(F.col("terms") >= least).distinct()


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, h (its text's hash), n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = _phrases(docs, bench, window)
    hit = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["first"], x["last"])))))
    rows = rows.select("doc_id", "h", "n_words", F.when(F.size("runs") > 0, hit).otherwise(0).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.transform(F.coalesce("runs", F.array()), lambda x: x["item_id"]))).alias("items"))
    return rows.select("doc_id", "h", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    bad = stored(contamination(docs, bench, window).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct(), "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_h"))
    return docs.join(small(bad, bad.count(), 32), same, "left_anti")
