"""Image files: listing, and reading them into rows of the images schema."""

from __future__ import annotations

import hashlib
import os
import urllib.parse
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.functions.exprs import EXTENSIONS, extension
from photolake.functions.features import image_metrics
from photolake.sources.decode import decode, from_jvm
from photolake.sources.sidecar import sidecar_for

LISTING = "path string, size_bytes long, mtime_unix long"
SCANNED = "path string, sha256 string, dhash long, size_bytes long, mtime_unix long, scanned_at_unix long, width int, height int, blur_var double, brightness double, colorfulness double, taken_at_unix long, gphotos_url string, status string"
#: Files a reading task takes.
FILES_PER_TASK = 256


def walk(root: str) -> Iterator[str]:
    for folder, _, names in os.walk(os.path.abspath(root), onerror=lambda _: None):
        for name in names:
            if os.path.splitext(name)[1].lower() in EXTENSIONS:
                yield os.path.join(folder, name)


def list_files(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, size_bytes, mtime_unix) of image files under ``roots``, each once; paths are absolute, hidden files count, unreadable entries don't.

    The roots' top folders are listed by tasks, so a file system that every executor mounts is walked in parallel.
    """
    tops = []
    for root in map(os.path.abspath, roots):
        entries = sorted(os.scandir(root), key=lambda e: e.name) if os.path.isdir(root) else []
        tops += [(e.path, e.is_dir(follow_symlinks=False)) for e in entries]

    def run(batches):
        for pdf in batches:
            rows = []
            for path, folder in zip(pdf["top"], pdf["folder"], strict=True):
                for p in walk(path) if folder else [path] if os.path.splitext(path)[1].lower() in EXTENSIONS else []:
                    try:
                        s = os.stat(p)
                    except OSError:
                        continue
                    rows.append((p, s.st_size, int(s.st_mtime)))
            yield pd.DataFrame(rows, columns=["path", "size_bytes", "mtime_unix"])

    df = spark.createDataFrame(tops, "top string, folder boolean")
    return df.repartition(max(1, min(len(tops), 1000))).mapInPandas(run, LISTING).dropDuplicates(["path"])


def _row(path: str, size: int, mtime: int, now: int, pixels: Callable[[bytes], object]) -> tuple:
    try:
        with open(path, "rb") as f:
            content = f.read()
        m = image_metrics(pixels(content))
    except Exception:
        return (path, None, None, size, mtime, now, None, None, None, None, None, None, None, "failed")
    meta = sidecar_for(path)
    taken = meta["taken_at"] if meta and meta["taken_at"] else mtime
    return (path, hashlib.sha256(content).hexdigest(), m.dhash, size, mtime, now, m.width, m.height, m.blur_var, m.brightness, m.colorfulness, taken, meta["url"] if meta else "", "ok")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows with integers kept exact where some are missing (a float column would lose bits of hashes)."""
    names = [c.split()[0] for c in SCANNED.split(", ")]
    columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(names, ())
    return pd.DataFrame({n: pd.array(v, dtype="Int64") if n in ("dhash", "width", "height", "taken_at_unix") else pd.Series(v, dtype=object if n in ("path", "sha256", "gphotos_url", "status") else None) for n, v in columns.items()})


def read_images(files: DataFrame, now: int, decoder: Callable = decode) -> DataFrame:
    """A row for each file: its hash, features, time and URL, and status ``ok`` or ``failed``. One decode of each.

    JPEG files are decoded by Spark's image source, by folder; all others, and hidden ones, by ``decoder`` in the tasks.
    """
    spark = files.sparkSession

    def run(batches):
        for pdf in batches:
            yield _frame([_row(p, s, m, now, lambda c, p=p: decoder(p, c)) for p, s, m in zip(pdf["path"], pdf["size_bytes"], pdf["mtime_unix"], strict=True)])

    def run_jpeg(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                found = (lambda c, r=r: from_jvm(int(r.height), int(r.width), int(r.nChannels), r.data)) if r.data is not None else (lambda c, r=r: decoder(r.path, c))
                rows.append(_row(r.path, r.size_bytes, r.mtime_unix, now, found))
            yield _frame(rows)

    jpeg = extension(F.col("path")).isin(".jpg", ".jpeg")
    n = files.count()
    parts = max(1, -(-n // FILES_PER_TASK))
    out = files.where(~jpeg).repartition(parts, "path").mapInPandas(run, SCANNED)
    folders = [r[0] for r in files.where(jpeg).select(F.regexp_extract("path", "^(.*)/", 1)).distinct().collect()]  # as many as albums
    if folders:
        images = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(["file://" + urllib.parse.quote(f) for f in folders]).select("image.*")
        path = F.url_decode(F.regexp_replace(F.regexp_replace("origin", "^file:(//)?", ""), r"\+", "%2B"))
        met = files.where(jpeg).join(images.select(path.alias("path"), "height", "width", "nChannels", "data"), "path", "left")
        out = out.union(met.select("path", "size_bytes", "mtime_unix", "height", "width", "nChannels", "data").mapInPandas(run_jpeg, SCANNED))
    return out


def scan_result(rows: DataFrame) -> DataFrame:
    """(scanned, failed) of read rows."""
    return rows.agg(F.count_if(F.col("status") == "ok").alias("scanned"), F.count_if(F.col("status") != "ok").alias("failed"))
