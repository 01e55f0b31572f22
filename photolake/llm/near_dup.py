"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

1. Each document's set of word shingles is hashed; a fast similarity sketch gives band keys.
   Documents with the same set form a class (128-bit set hash), which its least id stands for.
2. Classes that share a band key are tied to the key's least class: a star for each bucket, never
   its pairs. The components of these stars hold every link that banding can find.
3. Inside each such component links are confirmed on the full sets. A component whose sets fit
   one task is settled there. A larger one is first parted: chance ties of unlike sets, which grow with the
   square of the table, hold most of it together, so only sets that share a key of few rows and much of a longer
   sketch stay tied. What is large still is cut into blocks that are compared with pivots,
   round by round, until no link can be missing. All give the components of all true links.

Defined results: null id: the row is its own, unlinked. Null or wordless text: no shingles, linked
with nothing. Repeated rows of one id: each row is returned, linked as one document. A null id
has a null component and is kept. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.llm.common import FastSketch, UnionFind, band_keys, band_table, components, hash_strings, mix, plan_bands, runs, shingle_hashes, sketch_rows, small, split_words, stored, text_slices

BANDS = 48
#: A component with at most so many shingles over its classes is settled in one task; a block of a larger one has an eighth.
TASK_SHINGLES = 2_000_000
#: Bands of ``PART_ROWS`` that part large components: a link at 0.8 shares none with chance 4e-8 (16 bands: 1e-5).
PART_BANDS, PART_ROWS = 24, 3
#: Part (of 12) of its sketch's entries that a link at 0.8 or above has in common, but for chances under 1e-7.
PART_NEAR = 5
#: A key that more sets share ties them without a comparison.
MOST_COMPARED = 20_000
#: Shuffle partitions that the blocks of large components are dealt over at most.
MOST_TASKS = 20_000


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    codes, words, offsets = split_words(batch.column("text"))
    hashes = hash_strings(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    for row in shingle_hashes(hashes, offsets, width):
        yield np.unique(row)


def signatures(docs: DataFrame, width: int = 3, threshold: float = 0.85, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, keys): set size, 128-bit set hash and band keys of each row."""
    rows = plan_bands(threshold, bands)

    def run(batches):
        sketch = FastSketch(bands * rows)
        for batch in text_slices(batches):
            n, k1, k2, keys = [], [], [], []
            for s in _sets(batch, width):
                n.append(len(s))
                k1.append(int(mix(s).sum(dtype=np.uint64)))
                k2.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(77)))) if len(s) else 0)
                keys.append(band_keys(sketch(s), bands, rows) if len(s) else np.zeros(0, np.uint64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                names=["doc_id", "n_shingles", "k1", "k2", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>")


def link_sets(sets: list[np.ndarray], num: int, den: int, labels: list[int] | None = None, pivots: int | None = None) -> UnionFind:
    """Union-find of the sets with den * |a & b| >= num * |a | b|, by exact counts.

    One pivot at a time is held against all sets at once that aren't linked with it yet and share one of its rarest values, as a linked
    one must (a prefix filter, exact); when it's done it has no pair left.
    Only pivots outside the largest component are needed, so dense groups end after a few.
    With ``pivots`` only the first so many sets are pivots; ``labels`` says what is linked already.
    """
    n = len(sets)
    groups = UnionFind(n)
    if labels is not None:
        first: dict[int, int] = {}
        for i, x in enumerate(labels):
            groups.union(first.setdefault(x, i), i)
    roots = np.fromiter((groups.find(i) for i in range(n)), np.int64, n)
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    # numbers of the values by how many sets have them, each set's rarest first
    _, codes, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.empty(len(times), np.int64)
    number[np.argsort(times, kind="stable")] = np.arange(len(times))
    kinds = max(len(times), 1)
    codes = np.sort(np.repeat(np.arange(n) * kinds, sizes) + number[codes]) % kinds
    # linked sets share one of these: of a set, all values but as many as a link needs, and one more
    leads = np.where(sizes > 0, sizes + 1 + -num * sizes // den, 0)
    lead = np.arange(len(codes)) - np.repeat(starts, sizes) < np.repeat(leads, sizes)
    posts, listed = np.repeat(np.arange(n), sizes)[lead], codes[lead]
    order = np.argsort(listed, kind="stable")
    posts, cuts = posts[order], np.searchsorted(listed[order], np.arange(kinds + 1))
    marked = np.zeros(kinds, bool)
    met = np.zeros(n, bool)
    changed = True
    todo = list(range(n if pivots is None else pivots))
    done = 0
    while todo:
        if changed:
            changed = False
            count = np.bincount(roots)
            if count.max() == n:
                break
            if pivots is None and done >= 4:
                top = int(count.argmax())
                todo = [i for i in todo if roots[i] != top]
                if not todo:
                    break
        p = todo.pop()
        done += 1
        for x in codes[starts[p] : starts[p] + leads[p]].tolist():
            met[posts[cuts[x] : cuts[x + 1]]] = True
        them = np.flatnonzero(met)
        met[them] = False
        them = them[(roots[them] != roots[p]) & (num * np.maximum(sizes[them], sizes[p]) <= den * np.minimum(sizes[them], sizes[p]))]
        if not len(them):
            continue
        own, size = codes[starts[p] : starts[p] + sizes[p]], sizes[them]
        at = np.cumsum(size) - size
        marked[own] = True
        shared = np.add.reduceat(marked[codes[np.arange(at[-1] + size[-1]) + np.repeat(starts[them] - at, size)]], at, dtype=np.int64)
        marked[own] = False
        linked = them[den * shared >= num * (size + sizes[p] - shared)]
        if len(linked):
            changed = True
            for x in linked.tolist():
                groups.union(p, x)
            roots[np.isin(roots, np.append(roots[linked], roots[p]))] = groups.find(p)
    return groups


def link_across(pivots: list[np.ndarray], members: list[np.ndarray], num: int, den: int, labels: list[int]) -> UnionFind:
    """Union-find of pivots, then members, with the links of a pivot and a member; ``labels`` says what is linked already.

    A linked pivot has a member's value among its rarest, and values that no member has are the rarest of all: most pivots end there.
    """
    k, n = len(pivots), len(pivots) + len(members)
    groups = UnionFind(n)
    first: dict[int, int] = {}
    for i, x in enumerate(labels):
        groups.union(first.setdefault(x, i), i)
    roots = np.fromiter((groups.find(i) for i in range(n)), np.int64, n)
    sizes = np.array([len(s) for s in members], np.int64)
    starts = np.cumsum(sizes) - sizes
    values, codes, times = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    if not len(values):
        return groups
    order = np.argsort(codes, kind="stable")
    posts, cuts = np.repeat(np.arange(len(members)), sizes)[order], np.concatenate(([0], np.cumsum(times)))
    flat = np.concatenate(pivots)
    size = np.array([len(s) for s in pivots], np.int64)
    place = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    there = values[place] == flat
    ends = np.cumsum(size)
    # of a pivot, all values but as many as a link needs, and one more; those that no member has first
    hits = np.diff(np.concatenate(([0], np.cumsum(there)))[np.concatenate(([0], ends))])
    leads = size + 1 + -num * size // den - (size - hits)
    marked = np.zeros(len(values), bool)
    met = np.zeros(len(members), bool)
    for p in np.flatnonzero((leads > 0) & (hits > 0)).tolist():
        own = place[ends[p] - size[p] : ends[p]][there[ends[p] - size[p] : ends[p]]]
        for x in own[np.argsort(times[own], kind="stable")[: leads[p]]].tolist():
            met[posts[cuts[x] : cuts[x + 1]]] = True
        them = np.flatnonzero(met)
        met[them] = False
        them = them[(roots[k + them] != roots[p]) & (num * np.maximum(sizes[them], size[p]) <= den * np.minimum(sizes[them], size[p]))]
        if not len(them):
            continue
        each = sizes[them]
        at = np.cumsum(each) - each
        marked[own] = True
        shared = np.add.reduceat(marked[codes[np.arange(at[-1] + each[-1]) + np.repeat(starts[them] - at, each)]], at, dtype=np.int64)
        marked[own] = False
        linked = k + them[den * shared >= num * (each + size[p] - shared)]
        if len(linked):
            for x in linked.tolist():
                groups.union(p, x)
            roots[np.isin(roots, np.append(roots[linked], roots[p]))] = groups.find(p)
    return groups


def word_sets(width: int):
    """How a batch's texts become sets: their word shingles."""
    return lambda batch: _sets(batch, width)


def _resolver(make, num: int, den: int):
    """Of a bucket of whole components (comp, doc_id, text): each member with the least one it's linked to."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("comp", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        comps, ids = table.column("comp").to_numpy(), table.column("doc_id").to_numpy()
        sets = [s for batch in text_slices(table.to_batches()) for s in make(batch)]
        roots = ids.copy()
        cuts = np.flatnonzero(np.concatenate(([True], comps[1:] != comps[:-1], [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a == 2:
                x, y = sets[a], sets[a + 1]
                shared = len(np.intersect1d(x, y, assume_unique=True)) if num * max(len(x), len(y)) <= den * min(len(x), len(y)) else 0
                if shared and den * shared >= num * (len(x) + len(y) - shared):
                    roots[a + 1] = ids[a]
            else:
                groups = link_sets(sets[a:b], num, den)
                for i in range(b - a):
                    roots[a + i] = ids[a + groups.find(i)]
        return pa.table({"rep": pa.array(ids), "component_id": pa.array(roots)})

    return run


def _block_linker(make, num: int, den: int):
    """Of a block of members and its component's pivots: a spanning forest of the links found."""

    def run(key, members: pa.Table, pivots: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not members.num_rows or not pivots.num_rows:
            return empty
        both = pa.concat_tables([t.select(["doc_id", "text", "label"]) for t in (pivots, members)]).combine_chunks()
        sets = [s for batch in text_slices(both.to_batches()) for s in make(batch)]
        ids, labels = both.column("doc_id").to_pylist(), both.column("label").to_pylist()
        before = UnionFind(len(ids))
        first: dict[int, int] = {}
        for i, x in enumerate(labels):
            before.union(first.setdefault(x, i), i)
        # a pair of pivots is settled where one of them is a member
        after = link_across(sets[: pivots.num_rows], sets[pivots.num_rows :], num, den, labels)
        edges = {(labels[before.find(i)], labels[after.find(i)]) for i in range(len(ids))}
        edges = [(a, b) for a, b in edges if a != b]
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return run


def _settle_large(members: DataFrame, make, num: int, den: int) -> DataFrame:
    """(rep, component_id) of components too large for one task: members has doc_id, text, comp, n_shingles."""
    sizes = members.groupBy("comp").agg(F.ceil(8 * F.sum("n_shingles") / TASK_SHINGLES).alias("blocks"))
    # a task for each block: its bytes are few for its work, so adaptive execution would merge all
    tasks = min(max(2, 2 * (sizes.agg(F.sum("blocks")).first()[0] or 1)), MOST_TASKS)
    members = stored(members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))), "members")
    state = stored(members.select("comp", "blocks", "doc_id", "n_shingles", F.col("doc_id").alias("label"), F.lit(False).alias("done")), "state")
    step = 0
    while True:
        # the largest label of each component needs no pivots once the first ones are done
        count = state.groupBy("comp", "label").agg(F.count("*").alias("n"))
        top = count.groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("labels"))
        left = state.join(top, "comp").where("labels > 1 and not done" + (" and label <> top" if step else ""))
        # pivots by a seeded hash range of about the size of a block for each component
        room = left.groupBy("comp").agg(F.sum("n_shingles").alias("open"))
        share = F.lit(TASK_SHINGLES // 16 if not step else TASK_SHINGLES) / F.col("open")
        chosen = left.join(room, "comp").where(F.pmod(F.xxhash64("doc_id", F.lit(step)), F.lit(1 << 20)) < F.greatest(share * (1 << 20), F.lit(1)))
        chosen = stored(chosen.select("comp", "doc_id", "label", "blocks"), "pivots")
        n = chosen.count()
        if not n and not left.limit(1).count():
            break
        step += 1
        if not n:
            continue
        pivots = chosen.join(members.select("doc_id", "text"), "doc_id").select(F.col("comp").alias("comp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(c) for c in ("doc_id", "text", "label")))
        parts = members.join(state.select("doc_id", "label"), "doc_id").select(*(F.col(c).alias(c) for c in ("comp", "block", "doc_id", "text", "label")))
        parts, pivots = (x.repartition(tasks, "comp", "block") for x in (parts, pivots))
        found = parts.groupBy("comp", "block").cogroup(pivots.groupBy("comp", "block")).applyInArrow(_block_linker(make, num, den), "a long, b long")
        merged = components(found).withColumnRenamed("node", "label")
        state = state.join(chosen.select("doc_id", F.lit(True).alias("now")), "doc_id", "left").join(merged, "label", "left")
        state = stored(state.select("comp", "blocks", "doc_id", "n_shingles", F.coalesce("component", "label").alias("label"), (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")), "state")
    return state.select(F.col("doc_id").alias("rep"), F.col("label").alias("component_id"))


def _sketched(make, bands: int):
    """(key, node, sketch) of each band of each text; a byte of each entry of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = list(make(batch))
            n = len(sets)
            sketch = sketch_rows(np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets]), n, bands * PART_ROWS)
            keys = mix(band_table(sketch, bands, PART_ROWS) ^ mix(batch.column("comp").to_numpy().view(np.uint64))[:, None]).reshape(-1)
            low = mix(sketch).astype(np.uint8).tobytes()
            wide = bands * PART_ROWS
            each = pa.array([low[i * wide : (i + 1) * wide] for i in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(batch.column("doc_id").to_numpy(), bands)), each.take(pa.array(np.repeat(np.arange(n), bands)))], names=["key", "node", "sketch"])

    return run


def near_ties(nodes: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """Of one key's sets: each with the first of those that a chain of near sketches leads to."""
    need = PART_NEAR * sketches.shape[1]
    near = lambda rows, p: 12 * (sketches[rows] == sketches[p]).sum(1) >= need
    out, left = [], np.arange(len(nodes))
    while len(left):
        head, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            hit = near(left, front.pop()) if len(nodes) <= MOST_COMPARED else np.ones(len(left), bool)
            found, left = left[hit], left[~hit]
            out += [(int(nodes[x]), int(nodes[head])) for x in found]
            front += found.tolist()
    return out


def _near_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: ``near_ties`` of each key."""
    rest = None

    def whole(table: pa.Table) -> pa.RecordBatch:
        nodes = table.column("node").to_numpy()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(nodes), -1)
        head = runs(table.column("key").to_numpy())
        later = np.flatnonzero(head != np.arange(len(head)))
        # most keys' sets are all near the first one
        alike = 12 * (sketches[later] == sketches[head[later]]).sum(1) >= PART_NEAR * sketches.shape[1]
        mixed = np.isin(head[later], head[later[~alike]])
        a, b = nodes[later[~mixed]].tolist(), nodes[head[later[~mixed]]].tolist()
        for at in np.unique(head[later[mixed]]).tolist():
            end = int(np.searchsorted(head, at, side="right"))
            for x, y in near_ties(nodes[at:end], sketches[at:end]):
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        # the last key may go on
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        rest = table.slice(cut)
        if cut:
            yield whole(table.slice(0, cut))
    if rest is not None:
        yield whole(rest)


def parted(texts: DataFrame, make, bands: int) -> DataFrame:
    """``texts`` of large components with the smaller ``comp`` that each is in, without those that nothing is tied to."""
    keys = texts.select("comp", "doc_id", "text").mapInArrow(_sketched(make, bands), "key long, node long, sketch binary")
    ties = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_near_ties, "a long, b long")
    found = stored(components(ties).select(F.col("node").alias("id"), F.col("component").alias("part")), "parts")
    return texts.join(small(found, found.count(), 48), F.col("doc_id") == F.col("id")).select("doc_id", F.col("part").alias("comp"), "text", "n_shingles")


def settle(texts: DataFrame, make, num: int, den: int, bands: int = PART_BANDS, part: bool = True) -> DataFrame:
    """(rep, component_id): components by exact links inside each candidate component; texts: doc_id, comp, text, n_shingles (stored).

    Texts that are found to be linked with nothing may be left out.
    """
    heavy = texts.groupBy("comp").agg(F.sum("n_shingles").alias("total")).where(F.col("total") > TASK_SHINGLES).select("comp")
    heavy = stored(heavy, "heavy")
    light = texts.join(heavy, "comp", "left_anti").select("comp", "doc_id", "text")
    # buckets of whole components, of about a task's size each
    buckets = math.ceil((texts.agg(F.sum("n_shingles")).first()[0] or 0) / TASK_SHINGLES) + 1
    light = light.withColumn("bucket", F.pmod(F.xxhash64("comp"), F.lit(buckets))).repartition(min(max(2, 2 * buckets), MOST_TASKS), "bucket")
    settled = light.groupBy("bucket").applyInArrow(_resolver(make, num, den), "rep long, component_id long")
    if heavy.limit(1).count():
        large = texts.join(heavy, "comp", "left_semi")
        settled = settled.union(settle(stored(parted(large, make, bands), "parted"), make, num, den, bands, False) if part else _settle_large(large, make, num, den))
    return settled


def near_duplicates(docs: DataFrame, width: int = 3, num: int = 85, den: int = 100, bands: int = BANDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = stored(signatures(docs, width, num / den, bands), "signatures")
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    # written, so that both sides of its joins are plain shuffles, whose large partitions are split
    classes = stored(linked.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    member = signed.drop("keys").join(classes, ["k1", "k2", "n_shingles"], "left")
    rep = linked.join(classes, ["k1", "k2", "n_shingles"]).where("doc_id = rep").dropDuplicates(["rep", "k1", "k2"])
    keys = rep.select("rep", F.explode("keys").alias("key"))
    heads = keys.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("key", "head")
    stars = keys.join(heads, "key").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    loose = components(stars).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    loose = stored(loose, "candidates")
    # a text of each class: repeated rows of one id may hold several texts, the set hash says which
    wanted = stored(rep.select("rep", "k1", "k2", "n_shingles").join(loose, "rep"), "wanted")
    n = wanted.count()
    texts = docs.join(small(wanted.select("rep", "comp").distinct(), n, 64), F.col("doc_id") == F.col("rep"))
    texts = stored(texts.groupBy("doc_id", "comp", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).join(wanted.groupBy("rep").agg(F.sum("n_shingles").alias("n_shingles")), F.col("doc_id") == F.col("rep")).select("doc_id", "comp", "text", "n_shingles"), "texts")
    settled = settle(texts, word_sets(width), num, den).groupBy("rep").agg(F.min("component_id").alias("component_id"))
    out = member.join(settled, "rep", "left")
    component = F.coalesce("component_id", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", F.col("rep").alias("class_id"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those in a group that another document stands for; all columns stay.

    Rows that repeat an id stay together: of equal rows of the kept document one stays.
    """
    found = near_duplicates(docs, width, num, den)
    gone = stored(found.where("not kept").select(F.col("doc_id").alias("_d")).distinct(), "duplicates")
    rest = docs.join(small(gone, gone.count(), 24), docs["doc_id"].cast("long") == F.col("_d"), "left_anti")
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("_d")), "repeated")
    n = again.count()
    if not n:
        return rest
    again = small(again, n, 24)
    same = rest["doc_id"] == F.col("_d")
    return rest.join(again, same, "left_anti").unionByName(rest.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
