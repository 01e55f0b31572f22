import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from photolake.llm.private_data import LABELS, Field, find_private, trained, training_rows
from photolake.llm.secrets import find_secrets, ownership
from photolake.llm.spans import PRIVATE_KINDS, SECRET_KINDS, digest, joined, private_spans, secret_spans


def brute_secrets(text):
    any_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def brute_private(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


SECRET_BITS = st.sampled_from(["token", "secret", "TOKEN", "paſſwd", "api_key", "apikey", "ApiKey", "passwd", "password", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "dead", ":", "=", " ", '"', "'", "abc", "x-1", "é", "\n", "toKen"])
PRIVATE_BITS = st.sampled_from(["a", "b.c", "@", ".", "x@y.z", "1", "23", "255", "256", "001", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+", "(555)", "+1 (988) 555-2485", "é", "..", "٣"])


@given(st.lists(SECRET_BITS, max_size=20).map("".join))
@settings(max_examples=300, deadline=None)
def test_secret_patterns(text):
    assert [s for s, _ in secret_spans(text)] == brute_secrets(text)


@given(st.lists(PRIVATE_BITS, max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_private_patterns(text):
    assert private_spans(text) == brute_private(text)


def test_long_runs_are_fast():
    assert private_spans("a" * 200_000 + " " + "1" * 200_000) == [] and secret_spans("f" * 100_000) != []


KEY = "Zk3xQ9vLw2Rt7Yp1Bn5MdA"


def test_ownership(spark, table):
    rows = [(1, f"x {KEY} y", "a"), (2, f"other {KEY}", "a"), (3, "sample Zk3xQ9vLw2Rt7Yp1Bn5Mxx", "a"), (4, "sample Zk3xQ9vLw2Rt7Yp1Bn5Mxx", "b"), (5, 'token = "0123456789abcdef01234567"', "a"), (6, None, "a"), (None, "password=hunter22", None), (7, "", "c"), (1, f"x {KEY} y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner string").withColumn("value", F.lit(1))
    out = {r["doc_id"]: r for r in find_secrets(df, F.col("owner"), F.col("owner")).collect()}
    assert out[1]["spans"] == "token:2:24" and out[2]["spans"] == "token:6:28" and out[3]["spans"] == "" and out[4]["n_copied"] == 1
    assert (out[5]["n_assign"], out[5]["n_hex"], out[5]["n_live"]) == (1, 1, 2) and out[5]["spans"] == "assign:0:33,hex:9:33"
    assert out[5]["base_sha256"] == hashlib.sha256(b"assign:0:33,hex:9:33").hexdigest()
    assert out[None]["n_assign"] == 1 and out[6]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[7]["spans"] == ""
    assert find_secrets(df, F.col("owner"), F.col("owner")).count() == len(rows)
    assert find_secrets(table([]), F.col("source"), F.col("lang")).count() == 0
    found = spark.createDataFrame([("v", "r1", "o1"), ("v", "r1", "o1"), ("v", "r2", "o1"), ("v", "r3", "o2")], "value string, repository string, owner string")
    assert tuple(ownership(found).first()) == ("v", 2, 3, 4)


def test_field_learns_its_table_and_decodes_exactly():
    import itertools

    import numpy as np
    import pyarrow as pa

    from photolake.llm.common import split_words

    field = trained()
    text = " ".join(w for _, _, w, _ in training_rows())
    lines = [" ".join(w for _, _, w, _ in g) for _, g in itertools.groupby(training_rows(), key=lambda r: r[0])]
    codes, words, offsets = split_words(pa.array(lines), lower=False)
    spots, labels = field.decode(codes, words.to_pylist(), offsets)
    got = np.zeros(len(codes), int)
    got[spots] = labels
    gold = np.array([LABELS.index(y) for _, _, _, y in training_rows()])
    assert (got == gold).mean() > 0.95 and ((got > 0) & (gold == 0)).sum() == 0
    # pruned decoding is the full Viterbi path: leave one out of the table as a held-out check of both
    assert len(text.split()) == len(codes)
    rows = training_rows()
    held = [r for r in rows if r[0] % 5 == 0]
    small = Field([r for r in rows if r[0] % 5], rounds=120)
    w = [x for _, _, x, _ in held]
    codes, words, offsets = split_words(pa.array([" ".join(w)]), lower=False)
    spots, labels = small.decode(codes, words.to_pylist(), offsets)
    got = np.zeros(len(codes), int)
    got[spots] = labels
    gold = np.array([LABELS.index(y) for *_, y in held])
    assert (got == gold).mean() > 0.85


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    field = trained()
    emit = np.random.default_rng(0).normal(size=(6, 4, len(LABELS)))
    lengths = np.array([4, 3, 2, 1, 4, 2])
    got = field.viterbi(emit, lengths)
    for i, n in enumerate(lengths):
        score = lambda p, i=i: sum(emit[i, t, y] for t, y in enumerate(p)) + sum(field.t[a, b] for a, b in zip((0, *p), (*p, 0), strict=True))
        assert tuple(got[i, :n]) == max(itertools.product(range(len(LABELS)), repeat=int(n)), key=score)


def test_private_query(table):
    rows = [(1, "Please contact Walter Stone about it: w.s@mail.org or +1 (988) 555-2485."), (2, None), (3, ""), (None, "10.0.0.1"), (4, "Anblewh sttible athawh. Thonre was is anly hend"), (4, "x")]
    out = sorted(find_private(table(rows)).collect(), key=lambda r: (r["doc_id"] or 0, r["spans"]))
    assert len(out) == 6
    by = {r["doc_id"]: r for r in out}
    assert (by[1]["n_email"], by[1]["n_phone"], by[None]["n_ip"], by[2]["spans"]) == (1, 1, 1, "")
    assert set(joined(private_spans(rows[0][1]), PRIVATE_KINDS).split(",")) <= set(by[1]["spans"].split(","))
    assert by[1]["base_sha256"] == digest(private_spans(rows[0][1]), PRIVATE_KINDS) and by[4]["n_field"] == 0
    assert "name:15:27" in by[1]["spans"].split(",")
    assert find_private(table([])).count() == 0 and SECRET_KINDS[:3] == ("assign", "access", "hex")


def test_ownership_against_counting(spark):
    import random

    r = random.Random(8)
    keys = ["".join(r.choice("abcdefghABCDEFGH0123456789") for _ in range(24)) for _ in range(12)]
    rows = [(i, f"word{r.randrange(40)} {r.choice(keys[: 1 + i % 12])} end", r.choice(["a", "b"]) if i % 3 else "a", f"r{r.randrange(1 + i % 6)}") for i in range(160)]
    out = {x["doc_id"]: x for x in find_secrets(spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string"), F.col("owner"), F.col("repo")).collect()}
    from photolake.llm.secrets import looks_random

    for i, text, _, _ in rows:
        key = text.split()[1]
        own = [x for x in rows if x[1].split()[1] == key]
        live = len({x[2] for x in own}) <= 1 and len({(x[2], x[3]) for x in own}) <= 3 and len({(x[2], x[3], x[1]) for x in own}) <= 8
        at = len(text.split()[0]) + 1
        assert out[i]["spans"] == (f"token:{at}:{at + 24}" if live and looks_random(key) else "")


def test_long_texts_take_linear_time(table):
    import time

    start = time.time()
    text = " ".join(f"token = {KEY}{i} mail{i}@site.org {KEY[::-1]}{i} +1 (988) 555-2485" for i in range(100_000))
    assert len(text) > 8_000_000
    from photolake.llm.secrets import candidates

    assert len(candidates(text)) >= 200_000 and len(private_spans(text)) >= 200_000
    assert time.time() - start < 15


def test_decoding_is_the_full_viterbi_path():
    import random

    import numpy as np

    from photolake.llm.private_data import MARGIN, repeats

    field, r = trained(), random.Random(2)
    pool = [w for _, _, w, _ in training_rows()] + ["Zorban", "Milek", "77", "x9", "B12-44", "!!", "Ångström"]
    found = 0
    for _ in range(300):
        # pieces of the table with odd words between
        words = [w for _ in range(3) for a in [r.randrange(len(pool))] for w in [*pool[a : a + r.randrange(1, 9)], r.choice(pool)]]
        words = [w for w in words for _ in range(1 + (r.random() < 0.15))]
        names = list(dict.fromkeys(words))
        codes = np.array([names.index(w) for w in words])
        spots, labels = field.decode(codes, names, np.array([0, len(codes)]))
        got = np.zeros(len(codes), int)
        got[spots] = labels
        own = [field.features("\x00"), *map(field.features, words), field.features("\x00")]
        emit = np.array([sum(field.w[p, k] for p in range(3) for k in own[t + p]) for t in range(len(words))]) + field.r[repeats(codes, np.array([0, len(codes)]))]
        emit[:, 0] += MARGIN
        assert (got == field.viterbi(emit[None], np.array([len(words)]))[0]).all()
        found += (got > 0).any()
    assert found > 50


def test_held_out_lines_of_the_table():
    import numpy as np

    rows = training_rows()
    right = wrong = missed = 0
    for k in range(4):
        held = {s for s, *_ in rows if s % 8 == k}
        field = Field([x for x in rows if x[0] not in held], rounds=100)
        for s in held:
            own = sorted(x for x in rows if x[0] == s)
            names = list(dict.fromkeys(x[2] for x in own))
            spots, labels = field.decode(np.array([names.index(x[2]) for x in own]), names, np.array([0, len(own)]))
            got = dict(zip(spots.tolist(), labels.tolist(), strict=True))
            for i, x in enumerate(own):
                gold = LABELS.index(x[3])
                right += gold > 0 and got.get(i, 0) == gold
                wrong += got.get(i, 0) not in (0, gold)
                missed += gold > 0 and got.get(i, 0) != gold
    assert right / (right + wrong) >= 0.85 and right / (right + missed) >= 0.85
