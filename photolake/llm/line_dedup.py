"""Fuzzy line dedup: MinHash over character shingles, banding, exact verification, distributed union-find.

1. Texts are cut at newlines; lines are trimmed of ASCII white space and blank ones don't count. A line's id is the
   64-bit hash of its text, so equal lines are one node. Sketches of character shingles give band keys.
2. Lines that share a band key inside a slice of texts are tied to the first of them at once; one row for each key and
   slice is shuffled, so a very common line or template costs a row for each slice. Sorted by key, these are
   tied to the first of each key by a stream that remembers one row.
3. Large components of these ties are parted by longer sketches (``near_dup.parted``). Inside the components links are confirmed by the exact Jaccard similarity of the shingle sets, and
   union-find over the confirmed links gives the components.
4. Of each component the first line by (doc_id, text's hash, line number) stays.

Defined results: null and blank texts have no lines. Rows with the same id and text are one document and share their
result. A line shorter than a shingle is one shingle. Null ids come first. Ids of 64 bits: two different lines that share one
would count as equal, a few in 10^11 lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.llm.common import CACHED, COMBINED_BYTES, band_table, components, mix, runs, sketch_rows, small, stored, text_slices
from photolake.llm.near_dup import settle

WIDTH = 8
BANDS, ROWS = 12, 4
#: Bands that part large components.
PART_BANDS = 16
NUM, DEN = 8, 10
BLANKS = " \t\r\x0b\x0c"


def line_ids(text: str) -> tuple[list[int], list[str]]:
    """Numbers (from 0) and trimmed texts of the lines that aren't blank."""
    numbers, lines = [], []
    for i, line in enumerate(text.split("\n")):
        line = line.strip(BLANKS)
        if line:
            numbers.append(i)
            lines.append(line)
    return numbers, lines


def char_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles (with repeats) and the line each is of."""
    units = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    full = np.empty(max(0, len(units) - WIDTH + 1), np.uint64)
    for at in range(0, len(full), CACHED):
        # pairs, fours, eights
        x = units[at : at + CACHED + WIDTH - 1].astype(np.uint64)
        for step in (1, 2, 4):
            x = x[:-step] * np.uint64(0x9E3779B97F4A7C15) + (x[step:] ^ (x[step:] >> np.uint64(29)))
        full[at : at + CACHED] = mix(x)
    counts = np.maximum(lengths - WIDTH + 1, 0)
    # the last WIDTH - 1 places of a line have no whole shingle
    inside = np.ones(len(units), bool)
    ends = np.cumsum(lengths)
    for back in range(1, WIDTH):
        inside[(ends - back)[lengths >= back]] = False
    items, rows = full[inside[: len(full)]], np.repeat(np.arange(len(lines)), counts)
    short = np.flatnonzero(lengths < WIDTH)
    own = np.array([xxhash.xxh64_intdigest(lines[i].encode(), 7) for i in short], np.uint64)
    return np.concatenate((items, own)), np.concatenate((rows, short))


def line_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    lines = batch.column("text").to_pylist()
    items, rows = char_shingles(lines)
    order = np.argsort(rows, kind="stable")
    items = items[order]
    ends = np.cumsum(np.bincount(rows, minlength=len(lines)))
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        yield np.unique(items[a:b])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with its lines; the slice's keys and ties go with its first document."""
    for batch in text_slices(batches, limit=COMBINED_BYTES):
        numbers, ids, texts, ends = [], [], [], [0]
        for text in batch.column("text").to_pylist():
            n, lines = line_ids(text or "")
            numbers += n
            texts += lines
            ends.append(len(texts))
        ids = np.fromiter((xxhash.xxh64_intdigest(x.encode(), 42) for x in texts), np.uint64, len(texts)).view(np.int64)
        offsets = pa.array(np.array(ends, np.int32))
        _, first = np.unique(ids, return_index=True)
        first.sort()
        keys, nodes, a, b = (np.zeros(0, np.int64) for _ in range(4))
        if len(first):
            items, rows = char_shingles([texts[i] for i in first])
            keys = band_table(sketch_rows(items, rows, len(first), BANDS * ROWS), BANDS, ROWS).reshape(-1).view(np.int64)
            nodes = np.repeat(ids[first], BANDS)
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            head = runs(keys)
            later = head != np.arange(len(keys))
            a, b = nodes[later], nodes[head[later]]
            keys, nodes = keys[~later], nodes[~later]
        lone = lambda x: pa.ListArray.from_arrays(pa.array(np.array([0] + [len(x)] * batch.num_rows, np.int32)), pa.array(x))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(ids)), lone(keys), lone(nodes), lone(a), lone(b)],
            names=["doc_id", "h", "numbers", "ids", "keys", "nodes", "a", "b"],
        )


SCANNED = "doc_id long, h long, numbers array<int>, ids array<long>, keys array<long>, nodes array<long>, a array<long>, b array<long>"


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: (a, b), b the first node of a's key."""
    key = head = None
    for batch in batches:
        keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        if not len(keys):
            continue
        heads = nodes[runs(keys)]
        if key is not None:
            heads = np.where(keys == key, head, heads)
        key, head = keys[-1], heads[-1]
        differ = nodes != heads
        yield pa.RecordBatch.from_arrays([pa.array(nodes[differ]), pa.array(heads[differ])], names=["a", "b"])


def line_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned documents (doc_id, h, numbers, ids), and (id, component) of lines tied to others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.col("text").cast("string").alias("text"))
    scanned = stored(rows.mapInArrow(_scan, SCANNED), "lines")
    keys = scanned.where("size(keys) > 0").select(F.explode(F.arrays_zip("keys", "nodes")).alias("k")).select(F.col("k.keys").alias("key"), F.col("k.nodes").alias("node"))
    ties = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_ties, "a long, b long")
    near = scanned.where("size(a) > 0").select(F.explode(F.arrays_zip("a", "b")).alias("t")).select("t.a", "t.b")
    loose = stored(components(ties.union(near)).select(F.col("node").alias("id"), F.col("component").alias("comp")), "candidates")
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line")).select(F.btrim("line", F.lit(BLANKS)).alias("text")).where("text <> ''").withColumn("doc_id", F.xxhash64("text"))
    wanted = lines.join(small(loose, loose.count(), 48), F.col("doc_id") == F.col("id"))
    texts = wanted.groupBy("doc_id", "comp").agg(F.first("text").alias("text"))
    texts = stored(texts.withColumn("n_shingles", F.length("text").cast("long")), "texts")
    settled = settle(texts, line_sets, NUM, DEN, PART_BANDS)
    return scanned.select("doc_id", "h", "numbers", "ids"), stored(settled.select(F.col("rep").alias("id"), F.col("component_id").alias("component")), "components")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, h, n_lines, n_dropped, dropped (the numbers of lines to drop, ascending)."""
    scanned, found = line_components(docs)
    each = scanned.distinct().select("doc_id", "h", F.explode(F.arrays_zip("numbers", "ids")).alias("l")).select("doc_id", "h", F.col("l.numbers").alias("number"), F.col("l.ids").alias("id"))
    each = each.join(found, "id", "left").select("doc_id", "h", "number", F.coalesce("component", "id").alias("component"))
    place = F.struct("doc_id", "h", "number")
    # written, so that both sides of the join are plain shuffles, whose large partitions are split
    first = stored(each.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first"), "first")
    gone = each.join(first, "component").where(~place.eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.sort_array(F.collect_list("number")).alias("dropped"))
    out = scanned.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select("doc_id", "h", F.size("ids").cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all other columns stay."""
    gone = repeated_lines(docs).where("n_dropped > 0").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("dropped").alias("_dropped")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_h"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_dropped", i))
    met = docs.join(gone, same, "left")
    return met.withColumn("text", F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*[f"`{c}`" for c in docs.columns])
