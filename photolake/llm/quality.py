"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, thresholds by language.

The model predicts UTF-16 units of the running text from the three units before them (a text starts with start marks and ends with
an end mark, one space stands between words), one model for each language, trained on the trusted documents (labelled good and not toxic) outside a held-out fold.
One scan counts the 4-grams of all documents, so what is gathered grows with the corpus: counts of trusted text and the
grams that will be asked for. Counts and continuation counts of each order are sharded by (language, gram) and joined by
shuffles; the joins give the probability of every gram asked for. A document's perplexity is that of its
units and of some usual ones of its language. Documents above the ``QUANTILE`` of the perplexities of the held-out trusted documents of
their language are rejected; so are those whose ``WORST_WORDS`` most surprising words, by their surprise for a unit, are together above the
``WORST_QUANTILE`` of what trusted ones have, since a few words don't show in a whole document.

The probabilities of all grams are broadcast to the scoring scan if their counted size allows it; otherwise documents are
dealt in chunks and each chunk gets the grams it has. Both give the same scores.

Defined results: documents without words, or in a language without trusted text, get no perplexity and are kept. A null
language is a language of its own. A document whose labels disagree isn't trusted. Repeated rows get the same scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.llm.common import BROADCAST_BYTES, small, split_words, stored, text_slices

ORDER = 4
#: One trusted document in so many sets the thresholds instead of the counts.
FOLD = 4
#: Words whose surprise counts apart from the whole document's.
WORST_WORDS = 3
#: The thresholds: parts of a language's held-out trusted documents that stay below.
QUANTILE = 0.99
WORST_QUANTILE = 0.995
#: The threshold of the most surprising words is this at least, 3 nats for a unit of each: less is no odd word, however few words a language has.
LEAST_WORST = 3.0 * WORST_WORDS
#: A quantile of n documents is raised by this, over n, times its distance from the median: a few documents hardly reach it.
ALLOWANCE = 25.0
#: Units of a language's usual text that are added to each document, so that a few odd words don't decide on short ones.
PRIOR_UNITS = 60
#: Text bytes of a chunk.
CHUNK_BYTES = 24 << 20
START, END = "￾", "￿"
_START = 0xFFFE
LOW = 0xFFFF


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of texts as unsigned 64-bit numbers, and the text each belongs to."""
    text = "".join(f"{START * 3}{w}{END}" for w in (x.replace(START, "?").replace(END, "?") for x in texts))
    u = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    g = u.copy()
    g[1:] |= u[:-1] << np.uint64(16)
    g[2:] |= u[:-2] << np.uint64(32)
    g[3:] |= u[:-3] << np.uint64(48)
    ends = np.cumsum(u == 0xFFFF) - (u == 0xFFFF)
    inside = u != _START
    return g[inside], ends[inside]


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """(language, row numbers, running texts) of a batch's rows that have words; one space stands between words."""
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        rows = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
        codes, words, offsets = split_words(batch.column("text").take(pa.array(rows)), lower=False)
        some = np.flatnonzero(np.diff(offsets))
        if len(some):
            each = words.take(pa.array(codes)).to_pylist()
            yield lang, rows[some], [" ".join(each[offsets[i] : offsets[i + 1]]) for i in some.tolist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        train = batch.column("train").to_numpy(zero_copy_only=False)
        for lang, rows, texts in _by_language(batch):
            grams, owner = _grams(texts)
            values = np.unique(grams)
            own, times = np.unique(grams[train[rows][owner]], return_counts=True)
            n = np.zeros(len(values), np.int64)
            n[np.searchsorted(values, own)] = times
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.view(np.int64)), pa.array(n)], names=["lang", "g", "n"])


def _worst(surprise: np.ndarray, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the surprise for a unit of its ``WORST_WORDS`` most surprising words, added up."""
    last = grams & np.uint64(LOW)
    ends = np.flatnonzero((last == np.uint64(0x20)) | (last == np.uint64(LOW)))
    whose = owner[ends]
    cuts = np.concatenate(([0], ends + 1))
    each = np.diff(np.concatenate(([0.0], np.cumsum(surprise)))[cuts]) / np.diff(cuts)
    order = np.lexsort((-each, whose))
    place = np.arange(len(order)) - np.searchsorted(whose, whose)  # in a text, whose words stand together
    worst = np.zeros(n)
    some = place < WORST_WORDS
    np.add.at(worst, whose[order][some], each[order][some])
    return worst


def _scores(batch: pa.RecordBatch, model: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: sum of log probabilities and its worst words' (NaN without a model or words), and number of units."""
    total, worst, units = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows, np.int64)
    for lang, rows, texts in _by_language(batch):
        grams, owner = _grams(texts)
        units[rows] = np.bincount(owner, minlength=len(rows))
        if lang in model:
            known, logp = model[lang]
            values, place = np.unique(grams, return_inverse=True)
            each = logp[np.searchsorted(known, values)][place]
            total[rows] = np.bincount(owner, weights=each, minlength=len(rows))
            worst[rows] = _worst(-each, grams, owner, len(rows))
    return total, worst, units


def _model(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for lang in pc.unique(table.column("lang")).to_pylist():
        own = table.filter(pc.equal(table.column("lang"), lang)).combine_chunks()
        grams = own.column("g").to_numpy().view(np.uint64)
        order = np.argsort(grams)
        out[lang] = grams[order], own.column("logp").to_numpy()[order]
    return out


SCORED = "doc_id long, h long, lang string, held boolean, units long, logp double, worst double"


def _scored(batch: pa.RecordBatch, model) -> pa.RecordBatch:
    total, worst, units = _scores(batch, model)
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h", "lang", "held")), pa.array(units), pa.array(total, mask=np.isnan(total)), pa.array(worst, mask=np.isnan(worst))], names=["doc_id", "h", "lang", "held", "units", "logp", "worst"])


def gram_log_probabilities(counts: DataFrame) -> DataFrame:
    """(lang, g, logp) of every gram of ``counts`` (lang, g, n) in a language with counts, by modified Kneser-Ney.

    The highest order has counts n; the orders below have continuation counts. Grams with n = 0 are only asked for.
    """
    # a gram's suffix is asked for too, and counts how many different seen grams end in it
    orders = [counts.select("lang", "g", F.expr("nullif(n, 0)").alias("c"))]
    for k in range(ORDER - 1, 0, -1):
        orders.append(orders[-1].groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("g")).agg(F.expr("nullif(count(c), 0)").alias("c")))
    below = None
    for k, table in zip(range(1, ORDER + 1), reversed(orders), strict=True):
        n = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        d = table.where("c is not null").groupBy("lang").agg(*n)
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

        def step(i: int, y: Column = y) -> Column:
            value = i - F.try_divide((i + 1) * y * F.col(f"n{i + 1}"), F.col(f"n{i}"))
            return F.coalesce(F.when((value > 0) & (value < i), value), F.lit(i / 2)).alias(f"d{i}")

        d = d.select("lang", step(1), step(2), step(3))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).when(F.col("c") > 2, F.col("d3"))
        own = table.join(F.broadcast(d), "lang").select("lang", "g", "c", cut.alias("cut"))  # d: a row for each language code of the trusted text
        # the seen grams of a context are among those asked for; a context has one gram for each unit at most
        same = Window.partitionBy("lang", F.shiftrightunsigned("g", 16))
        own = own.select("lang", "g", "c", "cut", F.sum("c").over(same).alias("all"), F.sum("cut").over(same).alias("cuts"), F.count("c").over(same).alias("types"))
        if below is None:
            # order 0: the same chance for each unit and one unseen
            base = F.lit(1.0) / (F.col("types") + 1)
        else:
            own = own.withColumn("low", F.col("g").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))).join(below, ["lang", "low"])
            base = F.col("q")
        p = F.coalesce((F.coalesce(F.col("c") - F.col("cut"), F.lit(0.0)) + F.col("cuts") * base) / F.col("all"), base)
        # written order by order, so that each plan is small
        below = stored(own.select("lang", F.col("g").alias("low"), p.alias("q")), f"order{k}")
    return below.select("lang", F.col("low").alias("g"), F.log("q").alias("logp"))


def score(docs: DataFrame, labels: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, h, lang, held, units, logp, worst) of each row; held: trusted and in the held-out fold; h: the text's hash."""
    trusted = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("t")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("quality = 1 and toxic = 0").select("t")
    trusted = stored(trusted, "trusted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("h"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), docs["text"].cast("string").alias("text"))
    rows = rows.join(small(trusted, trusted.count(), 48), F.col("doc_id") == F.col("t"), "left")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLD)) == 0
    rows = rows.select("doc_id", "h", "lang", "text", (F.col("t").isNotNull() & ~fold).alias("train"), (F.col("t").isNotNull() & fold).alias("held"))
    counts = rows.select("lang", "text", "train").mapInArrow(_count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    logp = gram_log_probabilities(stored(counts, "grams"))
    rows = rows.select("doc_id", "h", "lang", "held", "text")
    if logp.count() * 24 <= broadcast_bytes:
        model = docs.sparkSession.sparkContext.broadcast(_model(logp.toArrow()))

        def run(batches):
            for batch in text_slices(batches):
                yield _scored(batch, model.value)

        return rows.mapInArrow(run, SCORED)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("h", "doc_id"), F.lit(math.ceil(size / CHUNK_BYTES) + 1)).cast("int")
    dealt = rows.withColumn("chunk", chunk)

    def ask(key, table):
        parts = [pa.table({"chunk": pa.array(np.full(len(g), key[0].as_py(), np.int32)), "lang": pa.array([lang] * len(g)), "g": pa.array(g.view(np.int64))}) for batch in text_slices(table.combine_chunks().to_batches()) for lang, _, texts in _by_language(batch) for g in [np.unique(_grams(texts)[0])]]
        return pa.concat_tables(parts) if parts else pa.table({"chunk": pa.array([], pa.int32()), "lang": pa.array([], pa.string()), "g": pa.array([], pa.int64())})

    def answer(key, table, told):
        model = _model(told)
        parts = [_scored(batch, model) for batch in text_slices(table.combine_chunks().to_batches())]
        return pa.Table.from_batches(parts)

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk int, lang string, g long").distinct().join(logp, ["lang", "g"])
    return dealt.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(answer, SCORED)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, worst_quantile: float = WORST_QUANTILE) -> DataFrame:
    """Per row: doc_id, h, lang, units, perplexity (of a unit), threshold (its language's), worst, worst_threshold (of the most surprising words), kept."""
    rows = stored(score(docs, labels), "scores")
    held = rows.where("held and logp is not null")
    usual = held.groupBy(F.col("lang").alias("u")).agg(F.try_divide(-F.sum("logp"), F.sum("units")).alias("usual"))
    rows = rows.join(F.broadcast(usual), F.col("lang") == F.col("u"), "left")  # a row for each language code
    rows = rows.withColumn("perplexity", F.exp((PRIOR_UNITS * F.col("usual") - F.col("logp")) / (F.col("units") + PRIOR_UNITS)))
    at = lambda c, q, name: F.percentile_approx(c, [0.5, q], 100_000).alias(name)
    limits = rows.where("held and perplexity is not null").groupBy(F.col("lang").alias("l")).agg(at("perplexity", quantile, "q"), at("worst", worst_quantile, "w"), F.count("*").alias("n"))
    above = lambda q, name: (F.col(q)[1] + ALLOWANCE / F.col("n") * (F.col(q)[1] - F.col(q)[0])).alias(name)
    limits = limits.select("l", above("q", "threshold"), F.greatest(above("w", "worst_threshold"), F.lit(LEAST_WORST)).alias("worst_threshold"))
    out = rows.join(F.broadcast(limits), F.col("lang") == F.col("l"), "left")  # likewise
    return out.select("doc_id", "h", "lang", "units", "perplexity", "threshold", "worst", "worst_threshold", F.coalesce((F.col("perplexity") <= F.col("threshold")) & (F.col("worst") <= F.col("worst_threshold")), F.lit(True)).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, worst_quantile: float = WORST_QUANTILE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    bad = stored(classify(docs, labels, quantile, worst_quantile).where("not kept").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("lang").alias("_l")).distinct(), "rejected")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_h")) & (F.coalesce(docs["lang"].cast("string"), F.lit("")) == F.col("_l"))
    return docs.join(small(bad, bad.count(), 48), same, "left_anti")
