"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Texts are dealt by ranges of doc_id, encoded in Arrow batches and written as one ORC file for each range (a
shard), in ascending order of doc_id; equal ids are ordered by their text's hash. Each row has its
document's ids, ended by ``END``, its shard and its offset in it, so stripes are read in parallel
and a global position needs only the shards' totals. A reader that asks for ids of documents skips files,
stripes and row groups by min/max statistics and Bloom filters.

Encoding is the tokenizers library's. A text is cut at single spaces and newlines before a visible character, where the
pre-tokenizer always cuts too, and each distinct piece is encoded once; a text with other
runs of white space or a special token is encoded whole.

Defined results: a null text is empty and has just ``END``; null ids come first; repeated rows are written
each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolake.llm.common import new_path, small, text_slices

END = 0
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"
ORC = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20)}
#: Text bytes that are encoded together; their distinct pieces are encoded once. A worker takes some 30 bytes for each of them.
SLICE = 6 << 20
#: White space in the sense of Unicode, and more; the same without the newline.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_LINE = SPACE.replace(r"\s\x0b", r"\x09\x0b-\x0d ")
#: ASCII marks; at the end of a piece they are a word of their own to the pre-tokenizer.
MARKS = r"[!-/:-@\[-`{-~]"
#: What can't stand between newlines unchanged: nothing, white space at either end (a space before a character may start it), a newline, a special token.
TOUCHY = f"^$|^ {SPACE}|^[^ ]{SPACE}|^{SPACE}$|{SPACE}$|\n|<\\|"
#: Distinct pieces that a worker remembers, about 40 bytes each.
CACHE = 800_000
#: Pieces that are encoded as one text, a newline after each.
JOINED = 2000


def _np(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


class Encoder:
    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        #: Pieces encoded before, with their ids end to end; only speed depends on it.
        self.known, self.flat, self.lengths = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and lengths, of texts encoded one by one."""
        out = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *out]), np.fromiter(map(len, out), np.int64, len(out))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and lengths, of distinct pieces."""
        place = _np(pc.fill_null(pc.index_in(pieces, value_set=self.known), -1)).astype(np.int64)
        new = np.flatnonzero(place < 0)
        place[new] = len(self.known) + np.arange(len(new))
        missing = pieces.take(pa.array(new))
        ids, lengths = self._new(missing)
        self.flat, self.lengths = np.concatenate((self.flat, ids)), np.concatenate((self.lengths, lengths))
        table = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(self.lengths))).astype(np.int32)), pa.array(self.flat))
        out, lengths = _np(table.take(pa.array(place)).flatten()), self.lengths[place]
        if len(self.lengths) > CACHE:
            self.known, self.flat, self.lengths = pieces, out, lengths
        else:
            self.known = pa.concat_arrays([self.known, missing])
        return out, lengths

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and lengths, of pieces. A newline between two is a token of its own, unless white space touches it."""
        odd = _np(pc.match_substring_regex(pieces, TOUCHY)) if self.line is not None else np.ones(len(pieces), bool)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        cuts = np.append(np.arange(0, len(plain), JOINED), len(plain)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), pieces.take(pa.array(plain))), "\n").to_pylist()
        out = []
        for at in range(0, len(texts), 8):  # what the library keeps of each token is large, so a few texts at a time
            out += [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([t + "\n" for t in texts[at : at + 8]], add_special_tokens=False)]
        if any(np.count_nonzero(x == self.line) != n for x, n in zip(out, np.diff(cuts), strict=True)):
            ids, lengths = self._each(pieces.take(pa.array(plain)).to_pylist())
        else:
            ids = np.concatenate([np.zeros(0, np.int32), *out])
            ends = np.flatnonzero(ids == self.line)
            ids, lengths = ids[ids != self.line], np.diff(np.concatenate(([-1], ends))) - 1
        more = self._each(pieces.take(pa.array(rest)).to_pylist())
        # in the order of ``pieces``
        order = np.argsort(np.concatenate((plain, rest)))
        table = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.concatenate((lengths, more[1]))))).astype(np.int32)), pa.array(np.concatenate((ids, more[0]))))
        return _np(table.take(pa.array(order)).flatten()), np.concatenate((lengths, more[1]))[order]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the ends, and row offsets (rows + 1)."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        counts = _np(pc.list_value_length(lists)).astype(np.int64)
        flat = lists.flatten()
        offsets = np.concatenate(([0], np.cumsum(counts)))
        first = np.zeros(offsets[-1], bool)
        first[offsets[:-1]] = True
        coded = pc.dictionary_encode(flat)
        codes = _np(coded.indices)
        del lists, flat
        odd = _np(pc.match_substring_regex(coded.dictionary, f"^$|^{NOT_LINE}|^\n{SPACE}"))
        bad = np.where(first, _np(pc.equal(coded.dictionary, ""))[codes], odd[codes])
        # newlines that follow one another are one token or two, as the rest of the white space has it
        line, alone = (_np(x)[codes] for x in (pc.starts_with(coded.dictionary, "\n"), pc.equal(coded.dictionary, "\n")))
        bad[:-1] |= alone[:-1] & line[1:] & ~first[1:]
        slow = np.add.reduceat(bad, offsets[:-1]) > 0
        slow |= _np(pc.match_substring(texts, SPECIAL))
        del bad, line, alone
        row = np.repeat(np.arange(n, dtype=np.int32), counts)
        keep = ~slow[row]
        heads, codes, row = first[keep], codes[keep], row[keep]
        del first, keep
        # entries: pieces after a space or a newline, then pieces that start a text
        inner, starts = np.zeros(len(coded.dictionary), bool), np.zeros(len(coded.dictionary), bool)
        inner[codes[~heads]], starts[codes[heads]] = True, True
        entry = np.where(heads, (np.cumsum(starts, dtype=np.int32) + (np.count_nonzero(inner) - 1))[codes], (np.cumsum(inner, dtype=np.int32) - 1)[codes])
        del heads, codes
        inner, starts = np.flatnonzero(inner), np.flatnonzero(starts)
        body = coded.dictionary.take(pa.array(inner))
        lined = pc.starts_with(body, "\n")
        body = pc.if_else(lined, pc.utf8_slice_codeunits(body, 1), pc.binary_join_element_wise("", body, " "))
        body = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (body, coded.dictionary.take(pa.array(starts)))])
        core = pc.replace_substring_regex(body, f"{MARKS}+$", "")
        whole = pc.match_substring_regex(core, f"^$|{SPACE}$")
        tail = pc.if_else(whole, "", pc.replace_substring_regex(body, f"(?s)^.*?({MARKS}*)$", r"\1"))
        core = pc.if_else(whole, body, core)
        parts = pc.dictionary_encode(pa.concat_arrays([pa.array(["", "\n"]), core, tail]))
        numbers = _np(parts.indices).astype(np.int64)
        mark = np.zeros(len(body), np.int64)
        mark[: len(inner)] = _np(lined)
        entries = np.stack([numbers[mark], numbers[2 : 2 + len(body)], numbers[2 + len(body) :]], axis=1)
        ids, lengths = self._pieces(parts.dictionary)
        # texts that are encoded whole are entries of one part
        slow_rows = np.flatnonzero(slow)
        more = self._each(texts.take(pa.array(slow_rows)).to_pylist())
        entries = np.concatenate([entries, np.stack([len(lengths) + np.arange(len(slow_rows)), *[np.full(len(slow_rows), numbers[0])] * 2], axis=1)])
        ids, lengths = np.concatenate((ids, more[0])), np.concatenate((lengths, more[1]))
        places = np.searchsorted(row, slow_rows)
        entry = np.insert(entry, places, len(body) + np.arange(len(slow_rows)))
        row = np.insert(row, places, slow_rows)
        table = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(ids))
        # an entry's ids in one list, then each piece's entry
        joined = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths[entries].sum(axis=1)))).astype(np.int32)), table.take(pa.array(entries.ravel())).flatten())
        per_row = np.zeros(n, np.int64)
        filled = np.flatnonzero(np.diff(row, prepend=-1))
        per_row[row[filled]] = np.add.reduceat(np.diff(joined.offsets.to_numpy())[entry], filled) if len(filled) else 0
        ends = np.cumsum(per_row)
        del row, table
        flat = _np(joined.take(pa.array(entry)).flatten())
        del joined, entry
        ids = np.full(len(flat) + n, END, np.int32)
        inside = np.ones(len(ids), bool)
        inside[ends + np.arange(n)] = False
        ids[inside] = flat
        return ids, np.concatenate(([0], ends + np.arange(1, n + 1)))


def worker_encoder(spec: str) -> Encoder:
    """The encoder of this Python worker, which Spark uses again for later tasks."""
    import tokenizers

    key, encoder = getattr(tokenizers, "_photolake_encoder", (None, None))
    if key != spec:
        encoder = Encoder(spec)
        tokenizers._photolake_encoder = (spec, encoder)
    return encoder


def encoded(batches: Iterator[pa.RecordBatch], encode: Encoder, shard: int) -> Iterator[pa.RecordBatch]:
    """Rows of a shard from batches of (doc_id, text) in order."""
    at = 0
    for batch in text_slices(batches, limit=SLICE):
        ids, offsets = encode(batch.column("text"))
        start, at = at, at + len(ids)
        out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(batch.num_rows, shard, np.int32)), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets).astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])
        batch = ids = offsets = None  # not held while the next slice is encoded
        yield out
        out = None


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizers file ``tokenizer`` into ORC files at ``path``."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, a few MB whatever the data

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between slices
        yield from encoded(batches, worker_encoder(spec.value), TaskContext.get().partitionId())

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(run, SCHEMA).write.format("orc").options(**ORC).save(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of a token table, of the ids from ``first`` to ``last``; the files' metadata prune the rest."""
    rows = spark.read.schema(SCHEMA).orc(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("shard_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("shard").alias("s"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    out = rows.drop("n_tokens").mapInArrow(run, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return out.join(small(bases, totals.count(), 64), F.col("shard") == F.col("s")).select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to a new token table in the shared folder and return ``digest`` of it."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return digest(docs.sparkSession, path)
