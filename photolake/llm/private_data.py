"""Personal data by patterns and a linear-chain conditional random field.

The patterns give the base spans. The field labels words O, name, address or id. It's trained here, from the small labelled
table below, on shapes of a word and its neighbours and a few cue words, by gradient ascent on the exact
conditional likelihood (forward-backward in numpy). Decoding is Viterbi in numpy batches: words whose
weights can't beat O whatever stands around them are O in the best path, which cuts texts into short
segments without changing the result; segments of all rows of a batch are decoded together.

Defined results: a null or empty text has no spans. Spans of the field that overlap base spans are left out.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.llm.common import split_words, text_slices
from photolake.llm.spans import PRIVATE_KINDS, Span, digest, joined, outside, private_spans

LABELS = ("O", "name", "address", "id")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: The labelled table: words outside braces are O.
TRAINING = """
My name is {name Anna Berg} and I work here.
Please contact {name Maria Lopez} about the offer.
Contact {name John Smith} for more details.
Dear Mr. {name Peter Novak}, thank you for writing.
Dear Mrs. {name Helen Carter}, we have your letter.
Regards, {name Thomas Green}
Sincerely, {name Laura Klein}
Signed by {name Victor Hugo Marin} on Monday.
The patient's name is {name Carla Rossi}.
Written by {name Emil Sand} last week.
Patient: {name Olga Petrov} was seen today.
Name: {name Robert Brown}
Author: {name Ines Duarte}
Mr. {name Frank Weber} was there.
Ms. {name Nina Patel} called.
Dr. {name Alan Moore} will see you.
Mein Name ist {name Karl Schmidt} und ich wohne hier.
Herr {name Jonas Becker} kam zu uns.
Frau {name Eva Lang} schrieb den Brief.
Je m'appelle {name Claire Dubois} et je vis ici.
Madame {name Sophie Martin} est venue.
Monsieur {name Paul Girard} est parti.
Me llamo {name Juan Perez} y vivo aqui.
Nombre: {name Ana Garcia}
I live at {address 12 Elm Street} in town.
My address is {address 448 Oak Avenue} now.
Address: {address 9 Hill Road}
Send it to {address 77 Lake Drive} by noon.
We moved to {address 1500 Park Lane} in May.
He lives at {address 31 Mill Road} there.
Adresse: {address 5 Rue Verte}
SSN: {id 123-45-6789}
My social security number is {id 078-05-1120} as stated.
Her SSN is {id 219-09-9999} here.
Passport: {id C01X00T47}
Passport number {id X1234567} was issued.
My passport is {id K9876543} and valid.
IBAN: {id DE89370400440532013000}
The IBAN {id GB29NWBK60161331926819} is ours.
The the of and in a quiet place by the water.
The House was built on a hill near the river.
Es war ein Haus am Fluss und der Wald war nah.
Die Stadt und der Fluss sind heute ruhig.
Le chat est dans la maison et il dort.
La casa es grande y el perro duerme.
Enheit und Keit sind nicht der Weg zu uns.
Licensed under the Apache License, Version 2.0 of the year.
All rights reserved. The text is here as is.
In 1999 there were 12 of them and 30 more later.
The price is 45 dollars for 3 of them.
He said that it was to be done at once.
Contact us about the offer by noon.
Please send it to us in May or later.
The name is not known to them.
Version 3.2.1 is out since 2001-04-05 for all.
The key is kept in a safe place for now.
A call or a letter will do, and so will a short note.
The results are in Table 4 and Figure 12 of the Annual Report.
On Monday and Tuesday the Council met in Geneva and in Vienna.
We saw the Thames and the Tower near London Bridge on that day.
er Haus und Garten sind bei der Stadt Berlin am Rand
und Herr der Ringe ist ein Buch und Frau Holle auch.
Das Haus, der Garten und die Stadt liegen am Fluss.
Les enfants de la Ville et du Village jouent au Parc.
Los libros de la Casa y del Pueblo son de todos.
By noon. With care. Is it so. At last. In time. It is. That is all.
Yes. No. Perhaps. Then again. Never. Always. Here. There. Now.
Sale! Sale! Sale! Great Deals! Great Deals! Great Deals!
Test Test Test Test Test Test Test Test
Hello Hello Hello Hello Hello Hello Hello
it was Berlin Berlin Berlin Berlin Berlin Berlin on the wall
Banana Banana Banana Banana Banana Banana
Red. | Blue | Green. | Black | White.
City | Total. | Summer | Winter. | Number
Home. About. News. Prices. Offers. Maps. Help.
One. Two three. Four. Five six seven. Eight. Nine ten.
It ended. Rain. Wind came. Snow fell at night. Spring. Birds sang.
Great### deals$$$ now%%% for*** you&&& Today### only!!!
Best*** Price%%% Ever$$$ Call&&& Now###
SALE!! BIG!! DEALS,!! ALL!! DAY!! LONG.!!
BUY!! NOW!! THE!! BEST.!! PRICES,!! EVER!!
HELLO,!! WORLD!! THIS!! IS!! LOUD.!! VERY!! LOUD!!
for%%% you,### from.*** us&&& with*** love$$$ now,%%% here.###
win*** big$$$ prizes%%% today.*** click&&& fast### please$$$
great###
loud!!
Ends.### There,*** Here$$$ Then%%% Click.&&& Soon!!! Last***
One day. In. At noon. By. They left. On. To go. As it is. Of.
from the start, was it. In. Rain and Snow. By. Wind and Water.
il pleut. En. La Ville dort. De. Les Enfants jouent.
es regnet. Im. Der Garten ruht. An. Die Kinder spielen. Von.
llueve. En. La Ciudad duerme. De. Los Perros ladran. Por.
Go. Go. Go. Wind Wind Wind Wind Wind
La La La La La La La La La
Ring, Ring, Ring, Ring, Ring, Ring,
Licensed under the terms of the General Public License here.
Click Here Click Here Click Here Click Here
I can see Duran there, said the man, and Paris too.
Version 2.0 and Part 7 of Chapter 12 are new.
12 34 56 and 78 or 90 in 11 places of 45
He lives at {address 1200 Cedar Avenue} there.
The office is at {address 16 King Street} now.
Address: {address 14B Station Road}
Address: {address 305C North Lane} is new.
Address: {address 221 North Street}
Passport: {id M4471390B}
Passport: {id P04837261}
Dear Ms. {name Nora Field}, hello and thank you.
Dear Mr. {name Ian Wood}, hello.
My address is {address 64 Mill Road} today.
Her address is {address 5 Pine Street} today.
My name is {name Ana Ana} and I work here.
Please contact {name Lea Lea} about the offer.
My name is {name Jon Jon} and I am new here.
Please contact {name Mia Mia} today.
Dear Mrs. {name Zsa Zsa}, hello.
Her name is {name Lulu Lulu} as stated.
SSN: {id 123-45-6789 123-45-6789}
""".strip()

_TABLE = bytes(ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else ord("d") if 48 <= c <= 57 else c for c in range(256))
EDGE = "\x00"


#: So many spellings of each line are in the table.
SPELLINGS = 4


def _spelled(word: str, seed: int) -> str:
    """Another word of the same shape: vowels, consonants and digits are drawn anew by a hash of word and seed."""
    h = hashlib.blake2b(f"{seed} {word.lower().strip('.,:;!')}".encode()).digest()
    out = []
    for i, c in enumerate(word):
        pool = "aeiou" if c.lower() in "aeiou" else "bdfgklmnprstv" if c.isascii() and c.isalpha() else "0123456789" if c.isdigit() else c
        new = pool[h[i % len(h)] % len(pool)]
        out.append(new.upper() if c.isupper() else new)
    return "".join(out)


def training_rows() -> list[tuple[int, int, str, str]]:
    """The labelled table as rows (sentence, position, word, label).

    Each line is there in ``SPELLINGS`` spellings, so that its data is unknown words with a shape and its other words are cues: words in
    braces (but for the kind of a street) and, in lines without braces, words with a capital letter inside a sentence are spelled anew.
    """
    rows = []
    lines = TRAINING.splitlines()
    for s in range(SPELLINGS * len(lines)):
        line, seed = lines[s % len(lines)], s // len(lines)
        at = 0
        for part in re.findall(r"\{(\w+) ([^}]*)\}(\S*)|(\S+)", line):
            words = [(w, part[0]) for w in part[1].split()] if part[0] else [(part[3], "O")]
            if part[0] and part[2]:
                words[-1] = (words[-1][0] + part[2], part[0])
            for i, (w, label) in enumerate(words):
                other = label in ("name", "id") or label == "address" and i < len(words) - 1 or "{" not in line and at and w[:1].isupper() and len(w) > 3
                rows.append((s, at, _spelled(w, seed) if seed and other else w, label))
                at += 1
    return rows


def shape(word: str) -> str:
    """Upper, lower, digit classes with runs of over 3 cut, other characters as they are: ``Xxx``, ``ddd-dd-dddd`` ends as ``ddd-dd-ddd``."""
    return re.sub(r"(.)\1{2,}", r"\1\1\1", word.encode().translate(_TABLE).decode("ascii", "replace"))


#: What a word must gain beyond O before it's labelled: a miss costs less than a label on clean text.
MARGIN = 1.5


def repeats(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many neighbours in the same row (cut by ``offsets``) are the same word: 0, 1 or 2."""
    same = np.zeros(len(words) + 1, np.int64)
    same[1:-1] = words[1:] == words[:-1]
    same[offsets] = 0
    return same[:-1] + same[1:]


def cue(word: str) -> str:
    return word.lower().rstrip(".,:;")


class Field:
    """Weights of features of the word, the one before and the one after, of neighbours that are the same word, and of label pairs.

    O stands before and after a text.
    """

    def __init__(self, rows: list[tuple[int, int, str, str]], rounds: int = 200, rate: float = 0.5, decay: float = 0.01):
        sentences: dict[int, list[tuple[str, int]]] = {}
        for s, _, w, label in sorted(rows):
            sentences.setdefault(s, []).append((w, LABELS.index(label)))
        words = [w for s in sentences.values() for w, _ in s]
        lower = [w for s in sentences.values() for w in {cue(w) for w, _ in s}]
        # words of one sentence only stand for all unknown ones
        self.cues = {w: i + 1 for i, w in enumerate(sorted({w for w in lower if lower.count(w) > 1}))}
        self.shapes = {w: i + 1 for i, w in enumerate(sorted({shape(w) for w in words}))}
        n, width = len(sentences), max(map(len, sentences.values()))
        kinds = len(self.shapes) + 2 + len(self.cues) + 1
        gold = np.zeros((n, width), np.int64)
        mask = np.zeros((n, width), bool)
        feats = np.zeros((n, width, 3, 2), np.int64)
        again = np.zeros((n, width), np.int64)
        for i, s in enumerate(sentences.values()):
            own = [self.features(EDGE), *(self.features(w) for w, _ in s), self.features(EDGE)]
            for t, (_, y) in enumerate(s):
                gold[i, t], mask[i, t], feats[i, t] = y, True, own[t : t + 3]
            again[i, : len(s)] = repeats(np.array([w for w, _ in s]), np.array([0, len(s)]))
        size = len(LABELS)
        self.w, self.t = np.zeros((3, kinds, size)), np.zeros((size, size))
        self.r = np.zeros((3, size))
        gr = np.full_like(self.r, 1e-6)
        gw, gt = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        places = np.arange(3)[None, None, :, None]
        goal = np.eye(size)[gold] * mask[..., None]
        for _ in range(rounds):
            emit = self.w[places, feats].sum(axis=(2, 3)) + self.r[again]
            marginal, pairs = self._marginals(emit, mask)
            dw = np.zeros_like(self.w)
            for p in range(3):
                for j in range(2):
                    np.add.at(dw[p], feats[:, :, p, j][mask], (goal - marginal)[mask])
            dr = -decay * self.r
            np.add.at(dr, again[mask], (goal - marginal)[mask])
            gr += dr**2
            self.r += rate * dr / np.sqrt(gr)
            dt = -pairs
            before = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], axis=1)
            np.add.at(dt, (before[mask], gold[mask]), 1)
            ends = mask.sum(1) - 1
            np.add.at(dt, (gold[np.arange(n), ends], np.zeros(n, np.int64)), 1)
            dw -= decay * self.w
            dt -= decay * self.t
            gw += dw**2
            gt += dt**2
            self.w += rate * dw / np.sqrt(gw)
            self.t += rate * dt / np.sqrt(gt)
        # unseen shapes and cues have no weight of their own
        self.w[:, 0] = 0

    def features(self, word: str) -> tuple[int, int]:
        base = len(self.shapes) + 2
        if word == EDGE:
            return len(self.shapes) + 1, base
        return self.shapes.get(shape(word), 0), base + self.cues.get(cue(word), 0)

    def _marginals(self, emit: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the labels at each place, and summed of label pairs."""
        n, width, size = emit.shape

        def norm(x, axis):
            top = x.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        ahead, back = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0] + self.t[0]
        for t in range(1, width):
            ahead[:, t] = norm(ahead[:, t - 1, :, None] + self.t[None], 1) + emit[:, t]
        ends = mask.sum(1) - 1
        back[:] = self.t[:, 0]
        for t in range(width - 2, -1, -1):
            step = norm(self.t[None] + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where((t < ends)[:, None], step, self.t[:, 0])
        total = norm(ahead[np.arange(n), ends] + self.t[:, 0], 1)
        marginal = np.exp(ahead + back - total[:, None, None]) * mask[..., None]
        pairs = np.zeros((size, size))
        for t in range(1, width):
            p = np.exp(ahead[:, t - 1, :, None] + self.t[None] + (emit[:, t] + back[:, t])[:, None, :] - total[:, None, None])
            pairs += p[mask[:, t]].sum(0)
        pairs[0] += marginal[:, 0].sum(0)
        pairs[:, 0] += marginal[np.arange(n), ends].sum(0)
        return marginal, pairs

    def viterbi(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of padded sequences (n, width, labels), O before and after each."""
        n, width, size = emit.shape
        best = emit[:, 0] + self.t[0]
        came = np.zeros((n, width, size), np.int8)
        final = np.zeros((n, size))
        final[lengths == 1] = best[lengths == 1]
        for t in range(1, width):
            step = best[:, :, None] + self.t[None]
            came[:, t] = step.argmax(1)
            best = step.max(1) + emit[:, t]
            final[lengths == t + 1] = best[lengths == t + 1]
        label = (final + self.t[:, 0]).argmax(1)
        out = np.zeros((n, width), np.int64)
        for t in range(width - 1, -1, -1):
            inside = t < lengths
            out[inside, t] = label[inside]
            label = np.where(inside & (t > 0), came[np.arange(n), t, label], label)
        return out

    def decode(self, codes: np.ndarray, words: list[str], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``codes`` whose label isn't O, and these labels. Rows are cut by ``offsets``."""
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw: dict[bytes, int] = {}
        base, cues, table = len(self.shapes) + 2, self.cues, _TABLE
        pairs = np.zeros((len(words) + 1, 2), np.int64)
        for i, w in enumerate(words):
            key = w.encode().translate(table)
            known = raw.get(key)
            if known is None:
                known = raw[key] = self.features(w)[0]
            pairs[i] = known, base + cues.get(cue(w), 0)
        pairs[-1] = self.features(EDGE)
        tables = [self.w[p, pairs[:, 0]] + self.w[p, pairs[:, 1]] for p in range(3)]
        tables[1][:, 0] += MARGIN
        gains = [(x[:, 1:] - x[:, :1]).max(1) for x in tables]
        before, after = np.concatenate(([len(words)], codes[:-1])), np.concatenate((codes[1:], [len(words)]))
        before[offsets[:-1][offsets[:-1] < len(codes)]] = len(words)
        after[offsets[1:][offsets[1:] > 0] - 1] = len(words)
        t = self.t
        around = max(float((t[:, l][:, None] + t[l, :][None, :] - t[:, :1] - t[0:1, :]).max()) for l in range(1, len(LABELS)))
        again = repeats(codes, offsets)
        may = gains[0][before] + gains[1][codes] + gains[2][after] + (self.r[:, 1:] - self.r[:, :1]).max(1)[again] + around >= 0
        spots = np.flatnonzero(may)
        if not len(spots):
            return spots, spots
        row = np.searchsorted(offsets, spots, side="right")
        new = np.concatenate(([True], (np.diff(spots) > 1) | (np.diff(row) > 0)))
        starts = np.flatnonzero(new)
        lengths = np.diff(np.concatenate((starts, [len(spots)])))
        emit = tables[0][before[spots]] + tables[1][codes[spots]] + tables[2][after[spots]] + self.r[again[spots]]
        labels = np.zeros(len(spots), np.int64)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            width = int(lengths[order[at]])
            stop = at + 1
            while stop < len(order) and lengths[order[stop]] <= 2 * width and (stop - at) < 4096:
                stop += 1
            own = order[at:stop]
            width = int(lengths[own].max())
            place = starts[own][:, None] + np.arange(width)[None, :]
            inside = np.arange(width)[None, :] < lengths[own][:, None]
            padded = emit[np.minimum(place, len(spots) - 1)]
            labels[place[inside]] = self.viterbi(padded, lengths[own])[inside]
            at = stop
        hit = labels > 0
        return spots[hit], labels[hit]


@cache
def trained() -> Field:
    return Field(training_rows())


def field_spans(text: str, places: dict[int, int]) -> list[Span]:
    """Spans of labelled words (word number -> label) without the marks around them."""
    out: list[list[int]] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if (label := places.get(i)) is None:
            continue
        kind = 3 + label
        if out and last == i - 1 and out[-1][1] == kind:
            out[-1][2] = m.end()
        else:
            out.append([m.start(), kind, m.end()])
        last = i
    spans = []
    for a, k, b in out:
        while b > a and not text[b - 1].isalnum():
            b -= 1
        while a < b and not text[a].isalnum():
            a += 1
        if a < b:
            spans.append((a, k, b))
    return spans


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_field long"


def find_private(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_field."""
    field = field or trained()

    def run(batches):
        for batch in text_slices(batches):
            codes, words, offsets = split_words(batch.column("text"), lower=False)
            spots, labels = field.decode(codes, words.to_pylist(), offsets)
            rows = np.searchsorted(offsets, spots, side="right") - 1
            places: dict[int, dict[int, int]] = {}
            for r, s, y in zip(rows.tolist(), (spots - offsets[rows]).tolist(), labels.tolist(), strict=True):
                places.setdefault(r, {})[s] = y
            counts, digests, spans, extra = ([], [], [], []), [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                base = private_spans(text or "")
                more = outside([(s[0], s[2], s) for s in field_spans(text, places[r])], base) if r in places else []
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(digest(base, PRIVATE_KINDS))
                spans.append(joined(base + more, PRIVATE_KINDS))
                extra.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(extra, pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_field"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
