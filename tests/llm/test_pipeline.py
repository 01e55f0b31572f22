import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from photolake.storage import stored
from tests.llm.conftest import prose
from tests.llm.conftest_llm import brute_components
from tests.llm.test_decontaminate import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('sf')}"
    bench = [(1, prose(500, 40)), (2, prose(501, 20))]
    texts = {i: prose(i, 60 + i % 5) for i in range(160)}
    texts[200] = prose(3, 63)  # an exact copy
    words = prose(5, 60).split()
    texts[201] = " ".join([*words[:30], "odd", *words[31:]])
    texts[202] = prose(600, 30) + " " + bench[0][1]
    texts[203] = " ".join(w.upper() + "###!!" for w in prose(7, 80).split())
    texts |= {204: None, 205: ""}
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in texts.items()], SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(203, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, texts, bench


def test_stages_against_brute_force(spark, folder):
    root, texts, bench = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, root), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert kept["quality"] == sorted(set(texts) - {203})
    rows = [(i, texts[i]) for i in kept["quality"]]
    assert kept["near_duplicates"] == sorted(i for i, (_, _, k) in brute_components(rows, 5, 80, 100).items() if k)
    assert 200 not in kept["near_duplicates"]
    rows = [(i, texts[i]) for i in kept["near_duplicates"]]
    assert kept["decontamination"] == sorted(r[0] for r in brute(rows, bench) if not r[5]) and 202 not in kept["decontamination"]
    assert set(kept["mixing"]) <= set(kept["decontamination"])


def test_run_and_registration(spark, folder):
    root, texts, _ = folder
    out = __spark_entry__.queries()["pipeline"](spark, root).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    for r in sorted(out, key=lambda r: r["start"]):
        ids = [*plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    names = set(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"]
