import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from photolake.llm.mixing import fit_budget, mix, mixed
from photolake.llm.token_ids import Encoder, digest, read_tokens, tokenize, write_tokens
from tests.llm.conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.tuples(st.integers(1, 400), st.integers(1, 6)), min_size=1, max_size=30, unique_by=lambda x: x[0]), st.floats(0, 1.2))
@settings(max_examples=60, deadline=None)
def test_budget(lengths, part):
    sizes, counts = (np.array(x, np.int64) for x in zip(*lengths, strict=True))
    budget = int(part * (sizes * counts).sum())
    take = fit_budget(sizes, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    # exact subset sums say how near one can come
    reach = 1
    for s, n in lengths:
        for _ in range(n):
            reach |= reach << s
    best = min(abs(budget - i) for i in range(reach.bit_length()) if reach >> i & 1)
    assert abs(budget - int((take * sizes).sum())) == best


def corpus(spark, n=600):
    r = random.Random(4)
    rows = [(i, prose(i, r.choice([1, 3, 7, 50, 51, 200])), r.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "  ", "z"), (n + 2, "x y", "ü"), (n + 2, "x y", "ü"), (None, "p q r", "b")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def expected_targets(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        rest = total - sum(capped.values())
        w = sum(weight[s] for s in names if s not in capped)
        over = [s for s in names if s not in capped and w and rest * weight[s] / w > 3 * size[s]]
        if not over:
            return size, {s: capped.get(s, rest * weight[s] / w if w else 0) for s in names}
        capped |= {s: 3 * size[s] for s in over}


def test_mix(spark):
    rows, df = corpus(spark)
    out = mix(df).collect()
    assert len(out) == len(rows)
    size, target = expected_targets(rows)
    taken = {}
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["taken"] == 0 if not r["size"] else r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 4, (s, taken[s], t)
    assert sorted(map(str, mix(df.repartition(7)).collect())) == sorted(map(str, out))
    kept = mixed(df)
    assert kept.columns == df.columns
    got = {}
    for r in kept.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert got == {s: n for s, n in taken.items() if n}


def test_mix_of_nothing(spark):
    _, df = corpus(spark, 3)
    assert mix(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mix(blank).collect()] == [(0, 0.0, 0)] * 2


ODD = ["", " ", "a", " a", "a ", "a  b", "a\tb c", "x\n y", "tail...", "... ,,", "don't we've 's", "<|endoftext|> x<|endoftext|>", "日本 語、", "a b c", "é!! É## 12.5%", "a\n\nb \nc", "é x", "A.B. (c) [d]: e;", "emoji 😀!! 😀", "\r\n x", "_a_ __", "1,000 2.0."]


@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(alphabet=st.sampled_from("ab '.,!\n\t-é1😀<|>　"), max_size=30)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_library(texts):
    import pyarrow as pa

    encode, plain = _encoder(), _plain()
    ids, offsets = encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == [*plain.encode(t, add_special_tokens=False).ids, 0]


def _encoder(known=[]):  # noqa: B006
    if not known:
        with open(PATH, encoding="utf-8") as f:
            known.append(Encoder(f.read()))
    return known[0]


def _plain(known=[]):  # noqa: B006
    if not known:
        known.append(Tokenizer.from_file(PATH))
    return known[0]


def test_round_trip(spark, table, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "null id"), (7, None), (7, "again"), (7, "again"), (1000, prose(1, 9000))]
    out = tokenize(table(rows), PATH).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in out] == [r[0] for r in order]
    start = 0
    plain = _plain()
    want = {}
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in out:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        start += r["n_tokens"]
    assert tokenize(table([]), PATH).count() == 0


def test_files_are_pruned(spark, table, tmp_path):
    path = f"file://{tmp_path / 'tokens'}"
    write_tokens(table([(i, f"text {i}") for i in range(500)]), PATH, path)
    part = read_tokens(spark, path, 100, 105)
    assert sorted(r["doc_id"] for r in part.collect()) == list(range(100, 106))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100), LessThanOrEqual(doc_id,105)]" in part._jdf.queryExecution().toString()
    assert digest(spark, path).count() == 500


@pytest.mark.parametrize("rows", [[(None, "a b c d e", "s")] * 1000 + [(5, "x " * 700, "t")], [(1, "a b c d e", "s")] * 100 + [(2, "q " * 33, "t")], [(i // 50, "one two three", "s") for i in range(500)] + [(9999, "z " * 400, "t"), (9998, "z", None)]])
def test_equal_rows_are_taken_to_the_word(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    size, targets = expected_targets(rows)
    for _ in range(2):
        out = mix(df).collect()
        assert len(out) == len(rows)
        for s, target in targets.items():
            own = [r for r in out if r["source"] == s]
            # what whole documents of the source, each up to three times, come nearest to
            unit = min(len((t or "").split()) for _, t, x in rows if x == s)
            assert abs(sum(r["taken"] for r in own) - target) <= unit and all(r["taken"] <= 3 * r["size"] for r in own)
    assert mixed(df).count() == sum(r["taken"] // r["size"] for r in out if r["size"])


def test_mixing_with_clashing_columns(spark):
    names = ("size", "_words", "_ticket", "_copies", "_copy", "target", "ticket", "lacks", "range", "bound")
    df = spark.createDataFrame([(i, prose(i, 5 + i % 7), "ab"[i % 2], *range(len(names))) for i in range(60)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixed(df)
    assert out.columns == df.columns and out.count() > 0 and out.select(*names).distinct().count() == 1
    assert mix(df).count() == 60


def test_a_shard_is_encoded_in_little_memory():
    """A Python worker's part of an executor: twice this and the heap have to fit one (20 MB of words, most of them new)."""
    import subprocess
    import sys

    code = """
import ctypes, random
import public_tokenizers, pyarrow as pa
from photolake.llm.token_ids import Encoder, encoded
pa.set_memory_pool(pa.system_memory_pool())
def memory(key):
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith(key)) // 1024
r = random.Random(1)
words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(50_000)]
texts = pa.array([" ".join(r.choices(words, k=1000)) for _ in range(2_900)])
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["doc_id", "text"])
encode = Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
ctypes.CDLL(None).malloc_trim(0)
before = memory("VmRSS")
n = sum(out.num_rows for out in encoded(iter([batch]), encode, 0))
print(n, memory("VmHWM") - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True)
    n, used = map(int, done.stdout.split())
    assert n == 2900
    assert used < 140
