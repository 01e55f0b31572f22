import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake import schema
from photolake.__main__ import main
from photolake.operators import feedback, labels, manifest, match, overrides, review, similarity
from photolake.operators.graph import components, numbered
from photolake.options import Options
from photolake.plans.library import Library
from photolake.sources.png import bright_page, checkerboard, flat, write_png
from photolake.sources.sidecar import candidate_names, candidates, parse_sidecar, sidecar_for, sidecar_join
from photolake.storage import Table, with_columns


@pytest.fixture(scope="module")
def photos(tmp_path_factory):
    root = tmp_path_factory.mktemp("photos")
    os.makedirs(root / "album")
    files = {"a.png": checkerboard(128, 128, 8), "a_copy.png": checkerboard(128, 128, 8), "blurry.png": flat(128, 128, 128), "doc.png": bright_page(120, 160)}
    files |= {f"album/burst_{c}.png": checkerboard(160, 120, 10, i) for i, c in enumerate("abcdef")}
    for name, img in files.items():
        write_png(str(root / name), img)
        os.utime(root / name, (1_700_000_000, 1_700_000_000))
    (root / "broken.png").write_bytes(b"\x89PNG nothing")
    (root / "note.txt").write_text("no image")
    (root / "a.png.json").write_text(json.dumps({"title": "a", "photoTakenTime": {"timestamp": "1600000000"}, "url": "https://u/a"}))
    return root


@pytest.fixture(scope="module")
def library(spark, photos, tmp_path_factory):
    lib = Library(spark, f"file://{tmp_path_factory.mktemp('library')}")
    assert lib.scan(str(photos), str(photos / "album"), now=1) == {"scanned": 10, "skipped": 0, "failed": 1, "total": 11}
    return lib


def by_name(df, *columns):
    return {r[0].rsplit("/", 1)[-1]: tuple(r[1:]) for r in df.select("path", *columns).collect()}


def test_scan_and_rescan(library, photos):
    rows = by_name(library.images.read(), "id", "taken_at_unix", "gphotos_url", "dhash")
    assert rows["a.png"][1:3] == (1600000000, "https://u/a") and rows["doc.png"][1:3] == (1_700_000_000, "")
    assert sorted(r[0] for r in rows.values()) == list(range(1, 11))
    assert library.scan(str(photos), now=2) == {"scanned": 0, "skipped": 10, "failed": 1, "total": 11}


def test_analyze(library):
    counts, log = library.analyze()
    assert counts == {"exact_duplicate": 1, "near_duplicate": 3, "low_quality": 1, "useless_content": 1, "overshoot": 7} and log == []
    rows = library.suggestions.read().join(library.images.read().select(F.col("id").alias("image_id"), "path"), "image_id")
    keepers = {r["path"].rsplit("/", 1)[-1] for r in rows.where("category = 'near_duplicate' and is_keeper").collect()}
    assert keepers == {"a.png", "burst_b.png", "doc.png"}
    scores = {r["category"]: r["score"] for r in rows.where("category in ('low_quality', 'useless_content')").collect()}
    assert scores["low_quality"] == pytest.approx(104 / 120) and scores["useless_content"] == pytest.approx(0.901582, abs=1e-6)


def test_review_cycle(library, tmp_path):
    ids = by_name(library.images.read(), "id")
    total, candidates_, decided, counts = library.summary().select("total", "candidates", "decided", "counts").first()
    assert (total, decided, counts["exact_duplicate"]) == (10, 0, 1)
    n = library.manifest().count()
    assert n == candidates_
    library.decide(ids["doc.png"][0], "delete", 5)
    assert [r["id"] for r in library.manifest().collect()] == [ids["doc.png"][0]]
    group = library.groups("exact_duplicate").collect()
    assert len(group) == 1 and [x["is_keeper"] for x in group[0]["images"]] == [True, False]
    out = tmp_path / "m.json"
    assert manifest.write_json(library.manifest(), str(out)) == 1
    assert json.loads(out.read_text())[0]["dhash"] == 22517999479029840
    manifest.write_csv(library.manifest(), f"file://{tmp_path / 'csv'}")
    assert any("id,path,dhash,taken_at_unix,gphotos_url" in p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    library.decide(ids["doc.png"][0], "clear", 6)
    assert library.manifest().count() == n
    with pytest.raises(ValueError):
        library.decide(1, "burn")
    with pytest.raises(ValueError):
        library.groups("")


def test_labels_drive_useless(library, photos, tmp_path):
    path = tmp_path / "labels.json"
    burst = str(photos / "album" / "burst_a.png")
    path.write_text(json.dumps([{"path": burst, "label": "photo", "score": 0.5}, {"path": burst, "label": "product in a store", "score": 0.1}, {"path": "/none", "label": "receipt", "score": 1}]))
    assert library.tag(f"file://{path}") == 2
    counts, _ = library.analyze()
    assert counts["useless_content"] == 2
    assert by_name(library.images.read(), "content_label")["burst_a.png"] == ("product in a store",)


def test_cli(library, spark, capsys, tmp_path):
    where = ["--library", library.images.path.rsplit("/", 1)[0]]
    main(["version"])
    main([*where, "summary"], spark)
    main([*where, "export", "-o", str(tmp_path / "x.json")], spark)
    main([*where, "dupes"], spark)
    assert "a_copy.png" in capsys.readouterr().out


def test_sidecar_names():
    assert candidate_names("/d/IMG_4(1).jpg") == ["/d/IMG_4(1).jpg.json", "/d/IMG_4(1).jpg.supplemental-metadata.json", "/d/IMG_4(1).json", "/d/IMG_4.jpg(1).json", "/d/IMG_4.jpg.supplemental-metadata(1).json"]


@pytest.mark.parametrize("media,sidecar", [("IMG_1.jpg", "IMG_1.jpg.json"), ("IMG_2.jpg", "IMG_2.jpg.supplemental-metadata.json"), ("IMG_3.jpg", "IMG_3.json"), ("IMG_4(1).jpg", "IMG_4.jpg(1).json"), ("no.jpg", None)])
def test_sidecar_lookup(spark, tmp_path, media, sidecar):
    if sidecar:
        (tmp_path / sidecar).write_text('{"photoTakenTime": {"timestamp": "1600000000"}}')
    found = sidecar_for(str(tmp_path / media))
    assert (found or {}).get("taken_at") == (1600000000 if sidecar else None)
    path = str(tmp_path / media)
    rows = spark.createDataFrame([(path,)], "path string")
    assert rows.select(candidates(F.col("path"))).first()[0] == candidate_names(path)
    parsed = spark.createDataFrame([(str(tmp_path / (sidecar or "other.json")), True, 7, "u")], "path string, ok boolean, taken_at long, url string")
    assert sidecar_join(rows, parsed).first()["taken_at_unix"] == (7 if sidecar else None)


def test_sidecar_strictness():
    assert parse_sidecar('{"photoTakenTime": {"timestamp": 5}}') is None and parse_sidecar("[1]") is None and parse_sidecar("{") is None
    assert parse_sidecar("{}") == {"title": "", "taken_at": 0, "url": ""}
    assert parse_sidecar('{"PHOTOTAKENTIME": {"Timestamp": "x"}, "creationTime": {"timestamp": "9"}}')["taken_at"] == 0
    assert parse_sidecar('{"photoTakenTime": {"timestamp": ""}, "creationTime": {"timestamp": "9"}}')["taken_at"] == 9


def test_feedback(spark):
    def run(n, keep):
        s = spark.createDataFrame([(i, "low_quality", 1.0, "", 0, False) for i in range(n)], schema.SUGGESTIONS)
        d = spark.createDataFrame([(i, "keep" if i < keep else "delete", 0) for i in range(n)], schema.DECISIONS)
        return feedback.learn(s, d, Options())

    options, log = run(25, 18)
    assert options.blur_threshold == 90 and log == ["blur threshold tightened 120 -> 90 (18 of 25 low_quality flags kept)"]
    options, log = run(5, 5)
    assert options.blur_threshold == 120 and log == []
    assert Options(blur_threshold=0).blur_threshold == 120


def test_overrides(spark, tmp_path):
    assert overrides.load_overrides(spark, None).count() == 0 and overrides.load_overrides(spark, str(tmp_path / "none")).count() == 0
    path = tmp_path / "o.json"
    path.write_text('[{"prefix": "/a/b", "blur_threshold": 50}, {"prefix": "/a/b/c", "blur_threshold": 30}, {"prefix": "/a", "blur_threshold": 80, "useless_threshold": 0}]')
    rules = overrides.load_overrides(spark, str(path))
    df = spark.createDataFrame([("/a/b/c/d.jpg",), ("/a/b/x.jpg",), ("/a/x.jpg",), ("/elsewhere/x.jpg",), ("/ab",)], "path string")
    got = [tuple(r) for r in overrides.resolve(df, rules).select("path", "ov_blur_threshold", "ov_useless_threshold").collect()]
    assert got == [("/a/b/c/d.jpg", 30, None), ("/a/b/x.jpg", 50, None), ("/a/x.jpg", 80, 0.0), ("/elsewhere/x.jpg", None, None), ("/ab", 80, 0.0)]
    path.write_text("{")
    with pytest.raises(ValueError):
        overrides.load_overrides(spark, str(path))


@pytest.mark.parametrize("strategy", ["nested", "banded", "blocks"])
@pytest.mark.parametrize("radius", [0, 3, 8, 16])
def test_pairs_against_brute_force(spark, strategy, radius):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    h = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(4)] + [base, rng.integers(0, 2**63, 100, dtype=np.uint64)])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in h] * 2, "dhash long")
    got = {tuple(r) for r in similarity.hamming_pairs(df, radius, strategy=strategy).collect()}
    want = {(int(a), int(b), int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)))) for a in h for b in h if a < b and np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= radius}
    assert got == want


@pytest.mark.parametrize("few", [0, 50_000])
def test_image_pairs_of_many_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(similarity, "NESTED_LOOP", few)
    monkeypatch.setattr(similarity, "BLOCK", 32)
    monkeypatch.setattr(similarity, "NESTED_TASK", 50)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    h = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64)) for _ in range(3)] + [base[:20]]).view(np.int64)
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(h)] + [(900, None)], "id long, dhash long")
    far = lambda a, b: int(np.bitwise_count(h[a].view(np.uint64) ^ h[b].view(np.uint64)))
    want = [(a, b, far(a, b)) for b in range(len(h)) for a in range(b) if far(a, b) <= 12]
    assert sorted(tuple(r) for r in similarity.image_pairs(df, 12).collect()) == sorted(want)


def test_components_chain_and_numbering(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 300)] + [(500, 501), (500, 500)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(chain).collect()}
    assert all(got[i] == 1 for i in range(1, 301)) and got[501] == 500 and len(got) == 302
    assert {r["node"]: r["component"] for r in components(chain, one_task=1000).collect()} == got
    assert components(chain.where("a < 0")).count() == 0 and components(chain.where("a < 0"), one_task=9).count() == 0
    rows = numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")), "id").collect()
    assert all(r["n"] == r["id"] + 1 for r in rows)


def test_match_margin(spark):
    q = spark.createDataFrame([(1, 86400, 0), (2, 86400 * 2, 0), (3, 86400 * 3, 0), (4, 0, 0), (5, 86400 * 9, 0)], "id long, taken_at_unix long, dhash long")
    c = spark.createDataFrame([(10, 1, 1), (20, 2, 1), (21, 2, 7), (30, 3, 255), (40, 0, 0)], "cid long, day long, h long")
    got = {r["qid"]: (r["cid"], r["best"], r["second_best"], r["status"]) for r in match.match_by_day(q, c).collect()}
    assert got == {1: (10, 1, 999, "accepted"), 2: (20, 1, 3, "ambiguous"), 3: (30, 8, 999, "unmatched"), 4: (None, None, 999, "unmatched"), 5: (None, None, 999, "unmatched")}


def test_undo_and_unknown_actions(spark):
    before = spark.createDataFrame([(1, ""), (2, "keep"), (3, "delete")], "id long, decision string")
    after = spark.createDataFrame([(1, "delete"), (2, "keep"), (3, "keep")], "id long, decision string")
    got = {(r["image_id"], r["action"]) for r in review.undo(before, after).collect()}
    assert got == {(1, "clear"), (3, "delete")}
    with pytest.raises(Exception, match="unknown action"):
        review.check_actions(spark.createDataFrame([(1, 1, "burn", 0)], schema.DECISION_LOG)).collect()


def test_models(spark):
    images = spark.createDataFrame([(1, "/a", ""), (2, "/b", "receipt")], "id long, path string, content_label string")
    with pytest.raises(labels.ModelUnavailable):
        labels.classify_unlabelled(images, None)
    got = labels.classify_unlabelled(images, lambda df: df.select("path", F.lit("menu").alias("class_name"), F.lit(0.5).alias("score"))).collect()
    assert [tuple(r) for r in got] == [("/a", "document", 0.5)]
    with pytest.raises(ValueError):
        labels.class_list(["one"])
    prompts = spark.createDataFrame([("p1", "receipt", [1.0, 0.0]), ("p2", "photo", [0.0, 1.0])], "prompt string, bucket string, vector array<double>")
    got = labels.zero_shot(spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 3.0])], "id long, vector array<double>"), prompts).orderBy("id").collect()
    assert [(r["label"], round(r["score"], 3)) for r in got] == [("receipt", 1.0), ("photo", 1.0)]


def test_table_versions_and_missing_columns(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path / 't'}", schema.IMAGES, schema.IMAGE_DEFAULTS)
    assert t.read().count() == 0
    old = spark.createDataFrame([(1, "/a")], "id long, path string")
    t.write(old)
    row = t.read().first()
    assert (row["content_label"], row["blur_var"], row["taken_at_unix"]) == ("", 0.0, 0)
    t.write(t.read().withColumn("content_label", F.lit("x")))
    assert t.read().first()["content_label"] == "x"
    assert with_columns(old, schema.IMAGES, {}).columns == schema.IMAGES.fieldNames()


def test_live_summary(spark, tmp_path):
    from photolake.streaming.decisions import live_summary, read_log

    images = spark.range(3).withColumnRenamed("id", "id")
    s = spark.createDataFrame([(1, "low_quality", 1.0, "", 0, False)], schema.SUGGESTIONS)
    log = tmp_path / "log"
    os.makedirs(log)
    pushed = []

    def write(name, rows):
        (log / name).write_text("\n".join(json.dumps(dict(zip(("seq", "image_id", "action", "decided_at_unix"), r, strict=True))) for r in rows))

    def run():
        live_summary(read_log(spark, f"file://{log}"), images, s, lambda r: pushed.append((r["total"], r["candidates"], r["decided"])), f"file://{tmp_path / 'ck'}").awaitTermination()

    write("1.json", [(1, 1, "delete", 0), (2, 2, "keep", 0)])
    run()
    write("2.json", [(3, 1, "clear", 0)])
    run()
    assert pushed == [(3, 1, 0), (3, 1, 2), (3, 1, 0), (3, 1, 1)]
