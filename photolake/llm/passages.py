"""Substring dedup: near-duplicate passages by compact windows.

1. A text is its sequence of five-word shingles. For each of ``HASHES`` min-hash functions a Cartesian tree over the hashes gives the
   compact windows (l, c, r): every passage of ``LEAST`` shingles or more that starts in [l, c] and ends in [c, r] has its
   minimum at c. So two passages whose minima agree have windows with the same pivot hash, and a passage
   with similarity J is found with chance 1 - (1 - J)^HASHES, an equal one always. Shingles of one repeated word, which many
   texts have in different contexts, come last in every order: they are pivots of passages of nothing else.
2. All windows are shuffled by pivot hash. Of a hash with few windows each pair of documents whose sketches don't rule a passage out is joined
   with its texts. Windows of a hash with more are sent with their shingles and settled in one task (``settled``): what no other window
   could make a passage with is left out, equal ones are compared once, and a window is held against others until none could
   add a word to what its passages cover. So no pair is left out but where both sides' words are covered already.
3. Of two documents a window is tried unless the passages that are found cover all that it could add. The longest passage around the
   pivot is grown inside both windows and confirmed by the exact Jaccard similarity of its two shingle sets, then once more in
   the whole texts.

A document's repeated words are those of its confirmed passages; its dropped words those of passages that an earlier document
(by id, then by text hash) has, so one copy stays.

Defined results: null, empty and short texts have no passages. Rows with the same id and text are one document.
Passages that repeat only inside a document don't count. Null ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.llm.common import CACHED, hash_strings, mix, runs, shingle_hashes, small, split_words, stored, text_slices

WIDTH = 5
#: Shingles of the shortest passage: 50 words.
LEAST = 46
HASHES = 3
NUM, DEN = 8, 10
SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
#: Words that a passage may always have been moved by inside its window; longer ones by a quarter of their length, which similarity 0.8 can't exceed.
SHIFT = 16
#: Windows of a hash up to which all pairs of their documents are compared by their texts.
FEW = 8
#: Windows of a hash from which on none is left out by its sketch: comparing these takes the square of their number.
MANY = 4096


#: The value of repeated words, after all others.
LAST = np.iinfo(np.uint64).max
#: Shingles to a side of a pivot whose bits are its sketch: a passage has all of one side, or its pivots are in their middle.
SIDE = LEAST // 2
LOW = (1 << 64) - 1
#: Part (of 8) of the bits of a side that two pivots share, at least, if a passage is around them. A passage of ``LEAST`` shingles with similarity 0.8
#: shares 12 of ``SIDE`` on one side wherever its other shingles stand, as it has at most 11 of these on both sides together.
NEAR = 4


def _sketches(shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts one after the other: two words of bits of the ``SIDE`` shingles before each place and two of those after it (4, n), and where each text starts.

    Shingles of a neighbouring text only add bits.
    """
    starts = np.cumsum([0, *map(len, shingles)])
    n = int(starts[-1])
    place = mix(np.concatenate([*shingles, np.zeros(2 * SIDE, np.uint64)])) >> np.uint64(57)
    bit = np.uint64(1) << (place & np.uint64(63))
    before, after = [], []
    for word in (0, 1):
        bits = np.where(place >> np.uint64(6) == word, bit, np.uint64(0))
        step, run = 1, bits
        while 2 * step <= SIDE:
            run = run[: len(run) - step] | run[step:]
            step *= 2
        run = run[: len(run) - SIDE + step] | run[SIDE - step :]  # entry i: places i to i + SIDE - 1
        before.append(np.concatenate((np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits[: SIDE - 1]), run))[:n])
        after.append(run[1 : n + 1])
    return np.stack(before + after), starts


def _slack(left: int, right: int) -> int:
    return max(SHIFT, (left + right + 1) // 4)


def _shingled(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Shingle hashes of each text; the last bit says that a shingle is one word repeated."""
    codes, words, offsets = split_words(batch.column("text"))
    hashes = hash_strings(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    change = np.concatenate(([0], np.cumsum(codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    alike = (change[WIDTH - 1 :] == change[: len(change) - WIDTH + 1]).astype(np.uint64) if len(codes) >= WIDTH else np.zeros(0, np.uint64)
    rows = shingle_hashes(hashes, offsets, WIDTH)
    return [(s & ~np.uint64(1)) | alike[a : a + len(s)] if b - a >= WIDTH else s & ~np.uint64(1) for s, a, b in zip(rows, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def compact_windows(g: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(l, c, r) of all compact windows of ``least`` or more entries: the nodes of the Cartesian tree down to that size.

    Entries of ``LAST`` are one word repeated; where there's nothing else, one window is enough. So is one in a periodic text: a pivot that
    the same value stands before, by less than ``least``, with the same ``least`` entries after it, gets none.
    """
    out, todo = [], [(0, len(g), -least)] if len(g) >= least else []
    alike = bool((g == LAST).any())
    while todo:
        a, b, last = todo.pop()
        c = a + int(g[a:b].argmin())
        if c - last < least and g[c] == g[last] and c + least <= b and (g[last : last + least] == g[c : c + least]).all():
            step = c - last
            other = g[c:b] != g[c - step : b - step]
            end = c + int(other.argmax()) if other.any() else b
            c += (end - least - c) // step * step  # the last such pivot of the period
        else:
            out.append((a, c, b - 1))
            if alike and g[c] == LAST:
                continue
            if c - a >= least:
                todo.append((a, c, -least))
        if b - c > least:
            todo.append((c + 1, b, c))
    return out


def _longest(starts: np.ndarray, back: np.ndarray, ends: np.ndarray, most: np.ndarray, least: int) -> tuple[int, int] | None:
    """The farthest (start, end) steps whose gains add up to ``least`` or more. ``most``: the best gain from each end on, the last end first, so it never falls."""
    far = len(most) - 1 - most.searchsorted(least - back)
    k = int(np.where(far >= 0, starts + ends[far], -1).argmax())
    return (int(starts[k]), int(ends[far[k]])) if far[k] >= 0 else None


def _reaches(place: np.ndarray, at: int) -> Iterator[tuple[int, int]]:
    """Spans of ``LEAST`` or more around ``at`` that start and end with a hit (a place from 0 on), longest first.

    With n shared shingles and m others on both sides together the similarity is n / (n + m), so four shared ones make up for each
    other one. Places between hits count as the other side's; where shingles repeat or are moved that is not exact, so
    spans by own misses alone (four hits each, the least that 0.8 needs, and eight) and shorter ones are candidates too.
    """
    hit = place >= 0
    if not hit[at]:
        return
    ends, starts = np.flatnonzero(hit[at:]), np.flatnonzero(hit[: at + 1][::-1])
    n, m = np.arange(1, len(ends) + 1), np.arange(len(starts))
    after, before = ends + 1 - n, starts - m
    kinds: list[tuple[np.ndarray, np.ndarray]] = []
    heap: list[tuple] = []

    def push(span: tuple[int, int] | None, kind: int, least: int) -> None:
        if span is not None and span[0] + span[1] + 1 >= LEAST:
            heappush(heap, (-span[0] - span[1], span, kind, least))

    def more(kind: int, least: int) -> None:
        push(_longest(starts, kinds[kind][0], ends, kinds[kind][1], least), kind, 4 * least + 3)

    # none is longer than by own misses alone, which no other gain is above
    own = n - 4 * after, m - 4 * before
    kinds.append((own[1], np.maximum.accumulate(own[0][::-1])))
    more(0, 0)
    if not heap:
        return
    _, done, _, least = heappop(heap)
    yield at - done[0], at + done[1]
    right, left = np.maximum.accumulate(place[at + ends]) - place[at] + 1, place[at] - np.minimum.accumulate(place[at - starts])
    both = own[0] - 4 * np.maximum(right - n, 0), own[1] - 4 * np.maximum(left - m, 0)
    eight = n - 8 * after, m - 8 * before
    for ahead, back in (own, both, eight):
        push((int(starts[len(back) - 1 - int(back[::-1].argmax())]), int(ends[len(ahead) - 1 - int(ahead[::-1].argmax())])), -1, 0)
    kinds += [(back, np.maximum.accumulate(ahead[::-1])) for ahead, back in (both, eight)]
    more(0, least)
    more(1, 0)
    more(2, 0)
    while heap:
        _, span, kind, least = heappop(heap)
        if kind >= 0:
            more(kind, least)
        if span != done:
            yield at - span[0], at + span[1]
            done = span


Window = tuple[int, int, int]


def _places(own: np.ndarray, other: np.ndarray, shift: int) -> np.ndarray:
    """Where each shingle of ``own`` is in ``other``, of several places the nearest to its own moved by ``shift``; -1: nowhere."""
    order = np.argsort(other, kind="stable")
    values = other[order]
    lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
    place = order[np.minimum(lo, len(other) - 1)]
    more = np.flatnonzero(hi - lo > 1)
    if len(more):
        want = np.clip(more + shift, 0, len(other) - 1)
        after = np.searchsorted(runs(values) * len(other) + order, lo[more] * len(other) + want)
        low, high = order[np.maximum(after - 1, lo[more])], order[np.minimum(after, hi[more] - 1)]
        place[more] = np.where(want - low <= high - want, low, high)
    return np.where(hi > lo, place, -1)


def _before(x: np.ndarray) -> np.ndarray:
    """Where the value of each entry stands last before it; -1: nowhere."""
    order = np.argsort(x, kind="stable")
    alike = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    before = np.full(len(x), -1)
    before[order[alike + 1]] = order[alike]
    return before


class _Two:
    """Two texts, sorted once: where shingles of x are in y, and where each stands before in its own text."""

    def __init__(self, x: np.ndarray, y: np.ndarray, before: np.ndarray | None = None):
        self.x, self.y = x, y
        self.before = _before(x) if before is None else before, _before(y)
        self.repeats = [bool((b >= 0).any()) for b in self.before]
        self.order = np.argsort(y, kind="stable")
        values = y[self.order]
        self.low = np.searchsorted(values, x)
        first = self.order[np.minimum(self.low, len(y) - 1)]
        self.found = y[first] == x
        self.first = np.where(self.found, first, -1)
        self.back = np.zeros(len(y), bool)
        if self.repeats[1]:
            self.high = np.searchsorted(values, x, side="right")
            run = runs(values)
            self.keyed = run * len(y) + self.order
            seen = np.zeros(len(y), bool)
            seen[self.low[self.found]] = True
            self.back[self.order] = seen[run]
        else:
            self.back[first[self.found]] = True

    def places(self, a: int, b: int, c: int, d: int, shift: int) -> np.ndarray:
        """``_places`` of x from a to b in y from c to d."""
        first = self.first[a:b]
        place = np.where((first >= c) & (first < d), first - c, -1)
        if self.repeats[1]:
            lo, hi = self.low[a:b], self.high[a:b]
            more = np.flatnonzero(hi - lo > 1)
            if len(more):
                lo, hi, want = lo[more], hi[more], np.clip(more + shift, 0, d - c - 1) + c
                after = np.searchsorted(self.keyed, lo * len(self.y) + want)
                low, high = self.order[np.maximum(after - 1, lo)], self.order[np.minimum(after, hi - 1)]
                low, high = np.where((after > lo) & (low >= c), low, -FAR), np.where((after < hi) & (high < d), high, FAR)
                near = np.where(want - low <= high - want, low, high)
                place[more] = np.where(np.abs(near) < FAR, near - c, -1)
        return place


def _grown(x: np.ndarray, y: np.ndarray, mine: Window, theirs: Window, two: "_Two | _Group | None" = None) -> tuple[int, int, int, int] | None:
    """The passage (x first, x last, y first, y last; shingles) around the pivots of two windows (c, l, r) whose exact similarity is enough."""
    (cx, lx, rx), (cy, ly, ry) = mine, theirs
    left, right = min(cx - lx, cy - ly), min(rx - cx, ry - cy)
    slack = _slack(left, right)
    at = min(cx - lx, left + slack)
    begin, start = cx - at, cy - min(cy - ly, left + slack)
    end, stop = cx + min(rx - cx, right + slack) + 1, cy + min(ry - cy, right + slack) + 1
    if min(end - begin, stop - start) < LEAST:
        return None
    if two is None:
        two = _Two(x, y)
    place = two.places(begin, end, start, stop, cy - start - at)
    hit = place >= 0
    for a, b in _reaches(place, at):
        inside = hit[a : b + 1]
        there = place[a : b + 1][inside]
        c, d = int(there.min()), int(there.max())
        if d - c + 1 < LEAST:
            continue
        one, other, shared = b - a + 1, d - c + 1, len(there)
        if two.repeats[0]:  # sets count a shingle where it stands first
            first = two.before[0][begin + a : begin + b + 1] < begin + a
            one, shared = np.count_nonzero(first), np.count_nonzero(first & inside)
        if two.repeats[1]:
            other = np.count_nonzero(two.before[1][start + c : start + d + 1] < start + c)
        if DEN * shared >= NUM * (one + other - shared):
            return begin + a, begin + b, start + c, start + d
    return None


def _reach(sums: np.ndarray, hit: np.ndarray, w: Window) -> tuple[int, int] | None:
    """The first and last place that a passage around a window's pivot could have: spans of similarity 0.8 have no negative sum of ``_gains``."""
    c, l, r = w  # noqa: E741
    if not hit[c]:
        return None
    left, right = sums[c] - sums[l : c + 1], sums[c + 1 : r + 2] - sums[c]
    starts = (left >= -right.max()) & hit[l : c + 1]
    ends = (right >= -left.max()) & hit[c : r + 1]
    first, last = l + int(starts.argmax()), r - int(ends[::-1].argmax())
    return (first, last) if last - first + 1 >= LEAST else None


def _gains(hit: np.ndarray, before: np.ndarray) -> np.ndarray:
    """1 for each hit; -4 for each other shingle, of which 0.8 needs four hits, where it stands first."""
    return np.where(hit, 1, np.where(before < 0, -4, 0))


def confirmed(x: np.ndarray, y: np.ndarray, ties: list[tuple[int, list[Window], list[Window]]], before: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Confirmed passages of two documents.

    A tie is (pivot hash, windows of x, windows of y). Every window of one side is tried with all of the other, the longest first, but where
    found passages cover all that both could add. ``before``: ``_before`` of x.
    """
    found: list[tuple[int, int, int, int]] = []
    if not len(x) or not len(y):
        return found
    both = _Two(x, y, before)
    hits = both.found, both.back
    sums = [np.concatenate(([0], np.cumsum(_gains(h, b)))) for h, b in zip(hits, both.before, strict=True)]
    covered = np.zeros(len(x), bool), np.zeros(len(y), bool)
    reached: list[dict[Window, tuple | None]] = [{}, {}]
    spots = [np.flatnonzero(h) for h in hits]
    ends: list[dict[Window, tuple[int, int]]] = []
    for k, side in enumerate(spots):
        some = list(dict.fromkeys(w for tie in ties for w in tie[1 + k] if hits[k][w[0]]))
        low, high = np.searchsorted(side, [w[1] for w in some]), np.searchsorted(side, [w[2] for w in some], side="right") - 1
        ends.append({w: z for w, *z in zip(some, side[low].tolist(), side[high].tolist(), strict=True) if z[1] - z[0] + 1 >= LEAST} if some else {})
    # how many places before each one nothing covers
    bare = [list(range(len(c) + 1)) for c in covered]

    def reach(side: int, w: Window) -> tuple | None:
        """The first and last place of a window that count."""
        if w not in reached[side]:
            reached[side][w] = _reach(sums[side], hits[side], w)
        return reached[side][w]

    def text(side: int, w: Window) -> tuple:
        """What is there."""
        first, last = reached[side][w]
        return w[0] - first, (x, y)[side][first : last + 1].tobytes()

    def done(one: tuple[int, int], two: tuple[int, int]) -> bool:
        return bare[0][one[0]] == bare[0][one[1] + 1] and bare[1][two[0]] == bare[1][two[1] + 1]

    tried = set()
    whole: dict[tuple[int, int], tuple | None] = {}
    every = {(w, u) for _, own, theirs in ties for w in own if w in ends[0] for u in theirs if u in ends[1]}
    for w, u in sorted(every, key=lambda p: (-min(p[0][2] - p[0][1], p[1][2] - p[1][1]), p)):
        if done(ends[0][w], ends[1][u]):
            continue
        one, two = reach(0, w), reach(1, u)
        if one is None or two is None or done(one, two):
            continue
        if tried and (text(0, w), text(1, u)) in tried:
            continue
        passage = _grown(x, y, w, u, both)
        if passage is None:
            tried.add((text(0, w), text(1, u)))
            continue
        at = w[0], u[0]
        if at not in whole:
            whole[at] = _grown(x, y, (w[0], 0, len(x) - 1), (u[0], 0, len(y) - 1), both)
        for p in {passage, whole[at] or passage}:
            found.append(p)
            covered[0][p[0] : p[1] + 1] = True
            covered[1][p[2] : p[3] + 1] = True
        bare = [np.concatenate(([0], np.cumsum(~c))).tolist() for c in covered]
    return list(dict.fromkeys(found))


Found = tuple[int, int, int, int, int, int]
#: Beyond all places.
FAR = 1 << 30


class _Group:
    """One hash's windows in the order of their documents, cut to what a passage with any other of them could have."""

    def __init__(self, docs: list, windows: list[np.ndarray], pivots: list[int]):
        self.docs = docs
        sizes = np.array([len(x) for x in windows])
        self.flat = np.concatenate(windows)
        _, codes = np.unique(self.flat, return_inverse=True)
        kinds = int(codes.max()) + 1
        who = np.repeat(np.arange(len(windows)), sizes)
        starts = np.cumsum(sizes) - sizes
        self.starts, self.ends, self.at = starts, starts + sizes - 1, starts + np.array(pivots)
        before = _before(who * kinds + codes)
        first = before < 0
        self.before, self.repeats = (before, before), [not first.all()] * 2
        self.slot = np.full(kinds, -1)
        place = np.arange(len(codes))
        n = len(windows)
        self.low, self.high = self.starts.copy(), self.ends.copy()
        inside = np.ones(len(codes), bool)
        while True:
            times = np.bincount(codes[inside & (before < self.low[who])], minlength=kinds)
            hit = inside & (times[codes] > 1)
            sums = np.concatenate(([0], np.cumsum(np.where(hit, 1, np.where(first, -4, 0)))))
            bounds = np.stack((self.starts, self.at), 1).reshape(-1)
            left = np.maximum.reduceat(sums[self.at[who]] - sums[:-1], bounds)[::2] if n else sums[:0]  # to the pivot's left, but one for none
            left = np.maximum(left, 0)
            right = np.maximum.reduceat(sums[1:] - sums[self.at[who]], bounds)[1::2]
            fits = hit & hit[self.at[who]]
            head = fits & (place <= self.at[who]) & (sums[self.at[who]] - sums[:-1] + right[who] >= 0)
            tail = fits & (place >= self.at[who]) & (sums[1:] - sums[self.at[who]] + left[who] >= 0)
            low = np.minimum.reduceat(np.where(head, place, len(codes)), self.starts)
            high = np.maximum.reduceat(np.where(tail, place, -1), self.starts)
            alive = high - low + 1 >= LEAST
            low, high = np.where(alive, low, len(codes)), np.where(alive, high, -1)
            now = (place >= low[who]) & (place <= high[who])
            self.low, self.high, self.hit = low, high, hit & now
            if not alive.any() or now.sum() == inside.sum():
                break
            inside = now
        self.codes, self.kinds, self.first = codes, kinds, first
        self.alive = np.flatnonzero(alive).tolist()
        self.form = np.where(self.hit, codes, np.where(first, -1, -2))

    def window(self, i: int) -> Window:
        """(c, l, r) in ``flat``, cut."""
        return int(self.at[i]), int(self.low[i]), int(self.high[i])

    def places(self, a: int, b: int, c: int, d: int, shift: int) -> np.ndarray:
        own, other = self.codes[a:b], self.codes[c:d]
        if self.repeats[0] and (self.before[0][c:d] >= c).any():
            return _places(own, other, shift)
        self.slot[other] = np.arange(d - c)
        place = self.slot[own]
        self.slot[other] = -1
        return place

    def grown(self, i: int, j: int) -> tuple[int, int, int, int] | None:
        return _grown(self.flat, self.flat, self.window(i), self.window(j), self)


def settled(docs: list, windows: list[np.ndarray], pivots: list[int]) -> list[Found]:
    """Passages (i, first, last, j, first, last) of one hash's windows, j of an earlier document than i; places from the window's start on.

    ``docs`` ascend. Windows that are equal as far as a passage could reach are held against the first of them; where all of it is covered so, that
    one stands for them. Each other window is held against those before it, until none could cover a word of its own more by an earlier document,
    or one of the other's that nothing covers.
    """
    g = _Group(docs, windows, pivots)
    out: list[Found] = []
    known: set[tuple[int, int]] = set()
    late, either = np.zeros(len(g.flat), bool), np.zeros(len(g.flat), bool)

    def compare(i: int, j: int) -> bool:
        if docs[i] == docs[j] or (i, j) in known:
            return False
        known.add((i, j))
        p = g.grown(i, j)
        if p is None:
            return False
        late[p[0] : p[1] + 1] = True
        either[p[0] : p[1] + 1] = True
        either[p[2] : p[3] + 1] = True
        a, b = int(g.starts[i]), int(g.starts[j])
        out.append((i, p[0] - a, p[1] - a, j, p[2] - b, p[3] - b))
        return True

    forms: dict[tuple, int] = {}
    rest = []
    for i in g.alive:
        c, l, r = g.window(i)  # noqa: E741
        j = forms.setdefault((g.form[l : r + 1].tobytes(), c - l), i)
        if j == i or not compare(i, j) or not late[l : r + 1].all() or not either[g.low[j] : g.high[j] + 1].all():
            rest.append(i)
    if len(rest) < 2:
        return out
    # for each shingle the windows that have it, and where, counted from the pivot; the nearest of several places
    m = len(rest)
    low, high = g.low[rest] - g.at[rest], g.high[rest] - g.at[rest]
    own, whose, steps, hits, spare = [], [], [], [], np.zeros(m, np.int64)
    for k, i in enumerate(rest):
        c, l, r = g.window(i)  # noqa: E741
        hit = np.flatnonzero(g.hit[l : r + 1]) + l
        codes, at = g.codes[hit], hit
        which = np.arange(len(hit))
        spare[k] = np.count_nonzero(g.before[0][l : r + 1] >= l)
        if spare[k]:
            near = np.argsort(np.abs(hit - c), kind="stable")
            codes, one, back = np.unique(codes[near], return_index=True, return_inverse=True)
            at, which[near] = hit[near][one], back
        own.append(codes)
        steps.append(at - c)
        whose.append(np.full(len(codes), k))
        hits.append((hit, which))
    flat = np.concatenate(own)
    order = np.argsort(flat, kind="stable")
    posts, steps, cuts = np.concatenate(whose)[order], np.concatenate(steps)[order], np.searchsorted(flat[order], np.arange(g.kinds + 1))
    # for each hit where the list of its shingle starts, and how many earlier windows are in it
    entry = np.empty(len(flat), np.int64)
    entry[order] = np.arange(len(flat))
    at = 0
    for k, (hit, which) in enumerate(hits):
        begin = cuts[g.codes[hit]]
        hits[k] = hit, begin, entry[at + which] - begin
        at += len(own[k])
    # at 0.8 two sets of LEAST share 41; less, where shingles repeat
    need = np.maximum(1, -(-8 * (2 * LEAST) // 18) - spare)

    def gaps(i: int, covered: np.ndarray) -> tuple[int, int]:
        """The nearest places on both sides of the pivot that aren't covered."""
        c, l, r = g.window(i)  # noqa: E741
        before, after = covered[l : c + 1][::-1], covered[c : r + 1]
        a, b = int(before.argmin()), int(after.argmin())
        return -FAR if before[a] else -a, FAR if after[b] else b

    def partners(k: int) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
        """The earlier windows with which a passage could cover more; how far it could reach to both sides, in either."""
        closed, fits = late_gap == (-FAR, FAR), (left_gap[:k] > -FAR) | (right_gap[:k] < FAR)
        if closed and not fits.any():
            return
        c, l, r = g.window(rest[k])  # noqa: E741
        at, begin, n = hits[k]
        index = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        them = posts[index]
        shared = np.bincount(them, minlength=k)
        enough = shared >= np.minimum(need[:k], need[k])
        fits = enough & fits if closed else enough
        able = np.flatnonzero(fits)
        if not len(able):
            return
        where, column = steps[index], np.repeat(at - l, n)
        width = r - l + 1
        out = []
        for some in np.array_split(able, -(-len(able) * width // (1 << 22))):
            row = np.full(k, -1)
            row[some] = np.arange(len(some))
            keep = row[them] >= 0
            place = np.full((len(some), width), FAR, np.int32)
            place[row[them[keep]], column[keep]] = where[keep]
            # where shingles repeat, the other side's places don't count
            plain = ((spare[some] == 0) & (spare[k] == 0))[:, None]
            right = _sums(place[:, c - l :], g.first[c : r + 1], plain)
            left = _sums(-place[:, : c - l + 1][:, ::-1], g.first[l : c + 1][::-1], plain)
            gain = [x[0] for x in (left, right)]
            ends = []
            for a, b in ((0, 1), (1, 0)):
                most = np.where((left, right)[b][2], gain[b], -FAR).max(1, keepdims=True)
                ok = (left, right)[a][2] & (gain[a] + most - 1 >= 0)  # the pivot counts once
                end = ok.shape[1] - 1 - ok[:, ::-1].argmax(1)
                ends += [np.where(ok.any(1), end, -1), np.where(ok.any(1), (left, right)[a][1][np.arange(len(some)), end], -1)]
            a, x, b, y = ends
            more = (-a <= late_gap[0]) | (b >= late_gap[1]) | (-x <= left_gap[some]) | (y >= right_gap[some])
            good = (a >= 0) & (b >= 0) & (a + b + 1 >= LEAST) & more
            out += zip((-shared[some[good]]).tolist(), some[good].tolist(), a[good].tolist(), b[good].tolist(), x[good].tolist(), y[good].tolist(), strict=True)
        for _, h, *ends in sorted(out):
            yield h, ends

    left_gap, right_gap = np.full(m, -FAR), np.full(m, FAR)
    hubs: list[int] = []
    for k, i in enumerate(rest):
        late_gap = gaps(i, late)
        for h in hubs[:3]:
            if late_gap == (-FAR, FAR):
                break
            if compare(i, rest[h]):
                late_gap = gaps(i, late)
                left_gap[h], right_gap[h] = gaps(rest[h], either)
                hubs.remove(h)
                hubs.insert(0, h)
                break
        for h, (a, b, x, y) in partners(k) if k else ():
            if -a <= late_gap[0] or b >= late_gap[1] or -x <= left_gap[h] or y >= right_gap[h]:
                if compare(i, rest[h]):
                    late_gap = gaps(i, late)
                    left_gap[h], right_gap[h] = gaps(rest[h], either)
                    if h in hubs:
                        hubs.remove(h)
                    hubs.insert(0, h)
        left_gap[k], right_gap[k] = gaps(i, either)
    return out


def _sums(place: np.ndarray, first: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the pivot on, rows are pairs: gains of spans, how far they go on the other side, and which end with a hit.

    A hit is 1; every other shingle of both sides is -4, of which only first ones of a repeated shingle count. ``place`` is ``FAR`` for no hit.
    """
    hit = np.abs(place) < FAR
    hits = np.cumsum(hit, axis=1, dtype=np.int32)
    far = np.maximum.accumulate(np.where(hit, place, 0), axis=1)
    missed = np.cumsum(~hit & first, axis=1, dtype=np.int32)
    return hits - 4 * missed - 4 * np.where(plain, np.maximum(far + 1 - hits, 0), 0), far, hit


#: Columns of a pivot's sketch: two words before it, two after it.
SKETCH = ("b0", "b1", "a0", "a1")
SCANNED = "v long, doc_id long, h long, c int, l int, r int, b0 long, b1 long, a0 long, a1 long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each text with their pivots' sketches."""
    for batch in text_slices(batches):
        ids, hs = batch.column("doc_id"), batch.column("h").to_numpy()
        rows = _shingled(batch)
        v, d, where = [], [], []
        for i, s in enumerate(rows):
            if len(s) < LEAST:
                continue
            for seed in SEEDS:
                g = mix(s ^ seed)
                # a repeated word is the pivot only where there's nothing else
                w = np.array(compact_windows(np.where(s & np.uint64(1), LAST, g)), np.int64)
                v.append(mix(g[w[:, 1]] + seed))
                d.append(np.full(len(w), i, np.int64))
                where.append(w)
        if not v:
            continue
        v, d, where = np.concatenate(v), np.concatenate(d), np.concatenate(where)
        sketch, texts_at = _sketches(rows)
        sketch = sketch[:, texts_at[d] + where[:, 1]]
        w = where.astype(np.int32)
        columns = [pa.array(v.view(np.int64)), ids.take(pa.array(d)), pa.array(hs[d]), pa.array(w[:, 1]), pa.array(w[:, 0]), pa.array(w[:, 2]), *(pa.array(x.view(np.int64)) for x in sketch)]
        whole = pa.RecordBatch.from_arrays(columns, names=["v", "doc_id", "h", "c", "l", "r", *SKETCH])
        for at in range(0, whole.num_rows, 20_000):
            yield whole.slice(at, 20_000)


PLACES = pa.list_(pa.struct([("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32())]))
TIE = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("y_doc", pa.int64()), ("y_h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("tie", pa.struct([("v", pa.int64()), ("own", PLACES), ("theirs", PLACES)]))])
TIES = "doc_id long, h long, y_doc long, y_h long, lo int, hi int, tie struct<v:long,own:array<struct<c:int,l:int,r:int>>,theirs:array<struct<c:int,l:int,r:int>>>"
#: Rows of a batch of ties.
TIE_ROWS = 5000


def _tie(v: int, x: tuple, y: tuple) -> dict:
    """Windows of two documents (doc_id, h, windows) with the same hash; lo, hi: the words of y that they leave to a passage."""
    left, right = max(c - l for c, l, _ in x[2]), max(r - c for c, _, r in x[2])  # noqa: E741
    lo = min(c - min(left, c - l) - _slack(min(left, c - l), min(right, r - c)) for c, l, r in y[2])  # noqa: E741
    hi = max(c + min(right, r - c) + _slack(min(left, c - l), min(right, r - c)) + WIDTH for c, l, r in y[2])  # noqa: E741
    places = [[{"c": c, "l": l, "r": r} for c, l, r in w] for w in (x[2], y[2])]  # noqa: E741
    return {"doc_id": x[0], "h": x[1], "y_doc": y[0], "y_h": y[1], "lo": max(lo, 0), "hi": hi, "tie": {"v": v, "own": places[0], "theirs": places[1]}}


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pivots' sketches, words (4, ...) of bits, allow a passage around both."""
    shared, one, two = (np.bitwise_count(b).astype(np.int16) for b in (x & y, x, y))
    return (8 * (shared[0::2] + shared[1::2]) >= NEAR * np.maximum(one[0::2] + one[1::2], two[0::2] + two[1::2])).any(axis=0)


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by (v, doc_id, h, c): pairs of documents of a hash with few windows; windows of others, each as a pair with itself."""
    rest, out = None, []

    def windows(table: pa.Table):
        v = table.column("v").to_numpy()
        start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        size = np.diff(np.append(start, len(v)))
        sketch = np.stack([table.column(n).to_numpy().view(np.uint64) for n in SKETCH])
        # most hashes have one window or two that are far apart
        two = start[size == 2]
        size[size == 2] = np.where(_near(sketch[:, two], sketch[:, two + 1]), 2, 0)
        start, size = start[size > 1], size[size > 1]
        if not len(start):
            return
        doc, h, c, l, r = (table.column(n).to_numpy() for n in ("doc_id", "h", "c", "l", "r"))  # noqa: E741
        # all pairs of windows of hashes with few, the later window first
        few = size <= FEW
        of = [np.array(x) for x in zip(*((k, i, j) for j in range(FEW) for i in range(j) for k in range(j + 1, FEW + 1)), strict=True)]  # sizes, and pairs of these
        at, i, j = (np.concatenate([np.add.outer(start[size == n], x[of[0] == n]).ravel() for n in range(2, FEW + 1)]) for x in (0 * of[0], of[1], of[2]))
        keep = ((doc[i] != doc[j]) | (h[i] != h[j])) & _near(sketch[:, i], sketch[:, j])
        at, i, j = at[keep], i[keep], j[keep]
        pairs: dict[tuple, tuple[dict, dict]] = {}
        places = [list(zip(c[k].tolist(), l[k].tolist(), r[k].tolist(), strict=True)) for k in (i, j)]
        them = [list(zip(doc[k].tolist(), h[k].tolist(), strict=True)) for k in (i, j)]
        for value, x, y, own, theirs in zip(v[at].tolist(), them[1], them[0], places[1], places[0], strict=True):
            one, two = pairs.setdefault((value, x, y), ({}, {}))
            one[own] = two[theirs] = None
        for (value, x, y), (one, two) in pairs.items():
            out.append(_tie(value, (*x, list(one)), (*y, list(two))))
            if len(out) >= TIE_ROWS:
                yield pa.RecordBatch.from_pylist(out, TIE)
                out.clear()
        for a, n in zip(start[~few].tolist(), size[~few].tolist(), strict=True):
            # a window of a text that is there twice doesn't count
            d, t, bits = doc[a : a + n], h[a : a + n], sketch[:, a : a + n]
            step = max(1, CACHED // n)
            some = [np.ones(n, bool)] if n > MANY else [(_near(bits[:, k : k + step, None], bits[:, None]) & ((d[k : k + step, None] != d) | (t[k : k + step, None] != t))).any(axis=1) for k in range(0, n, step)]
            some = a + np.flatnonzero(np.concatenate(some))
            for k, *w in zip(*(x[some].tolist() for x in (doc, h, c, l, r)), strict=True):
                out.append({"doc_id": k, "h": w[0], "y_doc": k, "y_h": w[0], "lo": 0, "hi": 0, "tie": {"v": int(v[a]), "own": [dict(zip("clr", w[1:], strict=True))], "theirs": []}})
            if len(out) >= TIE_ROWS:
                yield pa.RecordBatch.from_pylist(out, TIE)
                out.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        # the last hash may go on
        v = table.column("v").to_numpy()
        cut = int(np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))[-1])
        rest = table.slice(cut)
        if cut:
            yield from windows(table.slice(0, cut).combine_chunks())
    if rest is not None:
        yield from windows(rest.combine_chunks())
    if out:
        yield pa.RecordBatch.from_pylist(out, TIE)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans of the same words."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def _packed(shingles: np.ndarray) -> np.ndarray:
    """32 bits of each shingle; what two windows share by chance is one shingle in 10^5 pairs."""
    return (shingles >> np.uint64(32)).astype(np.uint32)


def _unpacked(ties: pa.ListArray) -> list[list[tuple[int, list[Window], list[Window]]]]:
    """Ties of each row: (v, windows of one text, windows of the other)."""

    def cut(lists: pa.ListArray, values: list) -> list[list]:
        ends = np.cumsum(pc.list_value_length(lists).to_numpy()).tolist()
        return [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    v, *sides = ties.flatten().flatten()
    windows = [cut(x, list(zip(*(y.to_pylist() for y in x.flatten().flatten()), strict=True))) for x in sides]
    return cut(ties, list(zip(v.to_pylist(), *windows, strict=True)))


VERIFIED = "doc_id long, h long, first int, last int, later boolean, v long, c int, l int, r int, shingles binary"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of confirmed passages (v is null); of a document's pair with itself, its windows with their shingles (first is null)."""
    for whole in batches:
        for batch in text_slices([whole]):
            # a document's pairs stand together; its text is cut once
            own = batch.column("text").dictionary_encode()
            which, n = own.indices.to_pylist(), len(own.dictionary)
            both = _shingled(pa.RecordBatch.from_arrays([pa.concat_arrays([own.dictionary, batch.column("y_text")])], names=["text"]))
            mine, theirs = both[:n], both[n:]
            before = [_before(x) for x in mine]
            packed: dict[int, np.ndarray] = {}
            spans: dict[tuple, list[tuple[int, int]]] = {}
            every = _unpacked(batch.column("ties"))
            out = []
            ids = {n: batch.column(n).to_pylist() for n in ("doc_id", "h", "y_doc", "y_h", "lo")}
            for i in range(batch.num_rows):
                s, x, y = ids["lo"][i], (ids["doc_id"][i], ids["h"][i]), (ids["y_doc"][i], ids["y_h"][i])
                if x == y:
                    text = packed.get(which[i])
                    if text is None:
                        text = packed[which[i]] = _packed(mine[which[i]])
                    out.extend((*x, None, None, None, v, c, l, r, text[l : r + 1].tobytes()) for v, places, _ in every[i] for c, l, r in places)  # noqa: E741
                    continue
                end = len(theirs[i]) - 1
                ties = [(v, own, [(c - s, max(l - s, 0), min(r - s, end)) for c, l, r in other]) for v, own, other in every[i]]  # noqa: E741
                for a, b, c, e in confirmed(mine[which[i]], theirs[i], ties, before[which[i]]):
                    spans.setdefault((*x, True), []).append((a, b + WIDTH - 1))
                    spans.setdefault((*y, False), []).append((s + c, s + e + WIDTH - 1))
            out.extend((d, h, *span, later, None, None, None, None, None) for (d, h, later), some in spans.items() for span in _joined(some))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(types)], names=["doc_id", "h", "first", "last", "later", "v", "c", "l", "r", "shingles"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows with shingles, sorted by (v, doc_id, h, c): the passages of those of a hash (``settled``)."""
    names = ["doc_id", "h", "first", "last", "later"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    at, group = None, []

    def among() -> list[tuple]:
        # rows that repeat an id and a text are one document
        group[:] = [w for k, w in enumerate(group) if not k or w[:3] != group[k - 1][:3]]
        docs = [(w[0], w[1]) for w in group]
        if docs[0] == docs[-1]:
            return []
        found = settled(docs, [np.frombuffer(w[5], np.uint32) for w in group], [w[2] - w[3] for w in group])
        at = [w[3] for w in group]
        spans: dict[tuple, list] = {}
        for i, a, b, j, c, d in found:
            spans.setdefault((*docs[i], True), []).append((at[i] + a, at[i] + b + WIDTH - 1))
            spans.setdefault((*docs[j], False), []).append((at[j] + c, at[j] + d + WIDTH - 1))
        # a later one counts among all
        return [(d, h, *span, later) for (d, h, later), some in spans.items() for span in _joined(some)]

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(types)], names=names)

    for batch in batches:
        for v, *window in zip(*(batch.column(n).to_pylist() for n in ("v", "doc_id", "h", "c", "l", "r", "shingles")), strict=True):
            if v != at:
                if len(group) > 1 and (out := among()):
                    yield told(out)
                at, group = v, []
            group.append(window)
    if len(group) > 1 and (out := among()):
        yield told(out)


#: Stands for a null id, so that keys are never null and a partitioning by them serves all joins.
NO_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.expr(f"CAST('{NO_ID}' AS BIGINT)")).alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("h"), docs["text"].cast("string").alias("text"))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, h, first, last, later): word positions of confirmed passages; later: an earlier document has it. A null id is ``NO_ID``."""
    rows = _keyed(docs)
    # whole copies of a text are passages as they are: only the first is scanned
    same = {"crc": F.crc32("text"), "size": F.octet_length("text")}
    copies = rows.select("doc_id", "h", *(c.alias(n) for n, c in same.items())).groupBy(F.col("h").alias("k"), "crc", "size").agg(F.min("doc_id").alias("d"), F.max("doc_id").alias("last"))
    copies = stored(copies.where("d < last and size > 0").drop("last"), "copies")
    copies = small(copies, copies.count(), 48)
    alike = (F.col("h") == F.col("k")) & (same["crc"] == F.col("crc")) & (same["size"] == F.col("size"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    whole = rows.join(copies, alike).select("doc_id", "h", F.lit(0).alias("first"), (words - 1).alias("last"), (F.col("doc_id") > F.col("d")).alias("later")).where(F.col("last") >= LEAST + WIDTH - 2)
    rows = rows.join(copies, alike & (F.col("doc_id") > F.col("d")), "left_anti")
    ties = rows.mapInArrow(_scan, SCANNED).repartition("v").sortWithinPartitions("v", "doc_id", "h", "c").mapInArrow(_ties, TIES)
    pairs = stored(ties.groupBy("doc_id", "h", "y_doc", "y_h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("tie").alias("ties")), "pairs")
    used = pairs.select(F.col("doc_id").alias("d"), F.col("h").alias("k")).union(pairs.select("y_doc", "y_h")).distinct()
    used = stored(used, "used")
    texts = rows.join(small(used, used.count(), 32), (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("k"))).select("d", "k", F.col("text").alias("t")).dropDuplicates(["d", "k"])
    # of the other text only the words that its windows leave to the passage are sent on
    met = pairs.join(texts, (F.col("y_doc") == F.col("d")) & (F.col("y_h") == F.col("k"))).drop("d", "k")
    words = F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "")
    met = met.withColumn("y_text", F.array_join(F.slice(words, F.col("lo") + 1, F.col("hi") - F.col("lo")), " ")).drop("t")
    met = met.join(texts, (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("k"))).drop("d", "k").withColumnRenamed("t", "text")
    verified = stored(met.select("doc_id", "h", "y_doc", "y_h", "ties", "lo", "text", "y_text").mapInArrow(_verify, VERIFIED), "verified")
    between = verified.where("v is null").select("doc_id", "h", "first", "last", "later")
    rest = verified.where("v is not null").select("v", "doc_id", "h", "c", "l", "r", "shingles")
    among = rest.repartition("v").sortWithinPartitions("v", "doc_id", "h", "c").mapInArrow(_settle, "doc_id long, h long, first int, last int, later boolean")
    return whole.union(between).union(stored(among, "among"))


def _merged(column: str):
    """Sorted, disjoint spans of an array of (first, last)."""
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def put(done, x):
        joins = (F.size(done) > 0) & (x["first"] <= F.get(done, F.size(done) - 1)["last"] + 1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1)["first"].alias("first"), F.greatest(F.get(done, F.size(done) - 1)["last"], x["last"]).alias("last"))))
        return F.when(joins, longer).otherwise(F.concat(done, F.array(F.struct(x["first"].alias("first"), x["last"].alias("last")))))

    return F.aggregate(F.sort_array(column), empty, put)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, h, n_words, n_repeated, n_dropped, spans, dropped (arrays of first and last word, from 0)."""
    span = F.struct("first", "last")
    found = passages(docs).groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.collect_set(span).alias("all"), F.collect_set(F.when(F.col("later"), span)).alias("gone"))
    found = found.select("d", "k", _merged("all").alias("spans"), _merged("gone").alias("dropped"))
    rows = _keyed(docs).select("doc_id", "h", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(found, (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("k")), "left").withColumn("doc_id", F.when(F.col("doc_id") != F.expr(f"CAST('{NO_ID}' AS BIGINT)"), F.col("doc_id")))
    count = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1), F.lit(0).cast("long"))
    return out.select("doc_id", "h", "n_words", count("spans").alias("n_repeated"), count("dropped").alias("n_dropped"), "spans", "dropped")
