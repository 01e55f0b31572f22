"""Helpers that the corpus operators share: Arrow text batches, hashing, sketches, union-find.

Nothing here collects rows of documents. What is cut from its lineage is written as Parquet
under ``spark.checkpoint.dir``, so a lost executor costs only the tasks that ran on it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from photolake.operators.graph import components
from photolake.storage import BROADCAST_BYTES, new_path, small, stored

#: Entries of an array that numpy works on at a time where many passes follow.
CACHED = 1 << 16
#: Text bytes that one numpy pass holds at a time, and where slices are the first stage of combining.
SLICE_BYTES = 4 << 20
COMBINED_BYTES = 8 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- text in Arrow batches


def release() -> None:
    """Give free memory back to the system; a worker that waits for its next task would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``limit`` text bytes (or one row)."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        batch = lengths = ends = None
    release()


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings; call it on distinct values."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(values))


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: codes, the distinct words, and row offsets (rows + 1).

    A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.dictionary_encode(lists.flatten())
    codes = flat.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py()
    offsets = np.concatenate(([0], np.cumsum(counts)))
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return codes, flat.dictionary, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), over whole arrays."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per row the hashes of its ``width``-word shingles in order; a shorter row that has words is one shingle."""
    n = len(hashes)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for i in range(width):
        full = full * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(full)]
    full = mix(full)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            yield full[a : b - width + 1]
        elif b > a:
            short = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                short = short * np.uint64(0x9E3779B97F4A7C15) + h
            yield mix(short)
        else:
            yield full[:0]


# ---------------------------------------------------------------- sketches


class FastSketch:
    """Fast similarity sketching: ``t`` coordinates filled by rounds of hashed bin placement.

    Round i < t drops every element into one bin of round i; round t + j gives bin j the least
    element. A bin keeps the value of its earliest round, so 2t rounds fill every bin, and
    about t log t / n rounds are needed for n elements, which is what makes it fast. Rounds run in
    blocks, since later rounds never change a filled bin.
    """

    def __init__(self, t: int, seed: int = 1, block: int = 4096):
        self.t, self.block = t, block
        self.seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def __call__(self, items: np.ndarray) -> np.ndarray:
        t, n = self.t, len(items)
        best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        if not n:
            return best
        i = 0
        while i < t:
            step = min(t - i, max(1, self.block // n))
            h = mix(items[None, :] ^ self.seeds[i : i + step, None])
            bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            values = (h & np.uint64(0xFFFFFFFF)) | (np.arange(i, i + step, dtype=np.uint64) << np.uint64(32))[:, None]
            np.minimum.at(best, bins.ravel().astype(np.intp), values.ravel())
            i += step
            if best.max() < np.iinfo(np.uint64).max:
                return best
        for j in np.flatnonzero(best == np.iinfo(np.uint64).max):
            best[j] = (mix(items ^ self.seeds[t + j]) & np.uint64(0xFFFFFFFF)).min() | (np.uint64(t + j) << np.uint64(32))
        return best


def sketch_rows(items: np.ndarray, rows: np.ndarray, n_rows: int, t: int, seed: int = 1) -> np.ndarray:
    """``FastSketch`` of many rows at once, for rows of a few hundred items: (n_rows, t). ``rows`` says whose item it is."""
    seeds = FastSketch(t, seed).seeds
    none = np.iinfo(np.uint64).max
    best = np.full(n_rows * t, none, np.uint64)
    active = np.unique(rows)
    for i in range(2 * t):
        for at in range(0, len(items), CACHED):  # arrays that stay in the processor's cache
            part, base = items[at : at + CACHED], rows[at : at + CACHED] * t
            h = mix(part ^ seeds[i])
            values = (h & np.uint64(0xFFFFFFFF)) | (np.uint64(i) << np.uint64(32))
            bins = (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else i - t
            np.minimum.at(best, base + bins, values)
        active = active[(best.reshape(n_rows, t)[active] == none).any(axis=1)]
        if not len(active):
            break
        lacking = np.zeros(n_rows, bool)
        lacking[active] = True
        keep = lacking[rows]
        items, rows = items[keep], rows[keep]
    return best.reshape(n_rows, t)


def band_table(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``band_keys`` of each sketch: (n, bands)."""
    cells = sketches[:, : bands * rows].reshape(len(sketches), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketches), bands))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, r])
    return key


def runs(key: np.ndarray) -> np.ndarray:
    """For sorted keys: the index of the first entry with the same key."""
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    return np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)


def plan_bands(threshold: float, bands: int, miss: float = 1e-6, most_rows: int = 8) -> int:
    """Rows per band: the most for which a pair at ``threshold`` shares no band with chance ``miss`` at most."""
    return max([r for r in range(1, most_rows + 1) if (1 - threshold**r) ** bands <= miss], default=1)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of the key."""
    cells = sketch[: bands * rows].reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, r])
    return key


# ---------------------------------------------------------------- graphs


class UnionFind:
    """Union-find over 0..n-1 whose roots are the least members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True
