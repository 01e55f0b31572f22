"""JSON sidecars of media files: candidate names, and the first that parses."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPY = re.compile(r"\((\d+)\)$")


def candidate_names(path: str) -> list[str]:
    """Sidecar paths of a media file, the most specific first."""
    folder, base = os.path.split(path)
    dot = base.rfind(".")
    stem, ext = (base[:dot], base[dot:]) if dot >= 0 else (base, "")
    names = [f"{base}.json", f"{base}.supplemental-metadata.json", f"{stem}.json"]
    if m := COPY.search(stem):
        plain = stem[: m.start()] + ext
        names += [f"{plain}{m[0]}.json", f"{plain}.supplemental-metadata{m[0]}.json"]
    return [os.path.join(folder, n) for n in names]


def _time(value) -> str:
    """The timestamp text of a nested field; another type makes the file unreadable."""
    if value is None:
        return ""
    if not isinstance(value, dict):
        raise ValueError("not an object")
    text = _get(value, "timestamp")
    if text is None:
        return ""
    if not isinstance(text, str):
        raise ValueError("not a string")
    return text


def _get(value: dict, name: str):
    """A field by its name, or by its name in another case."""
    return value[name] if name in value else next((v for k, v in value.items() if k.lower() == name.lower()), None)


def parse_sidecar(content: bytes | str) -> dict | None:
    """{title, taken_at, url} of a sidecar, None if it can't be read. A timestamp that isn't a number is 0."""
    try:
        raw = json.loads(content)
        if raw is None:
            raw = {}
        if not isinstance(raw, dict):
            return None
        title, url = (_get(raw, k) for k in ("title", "url"))
        if not all(v is None or isinstance(v, str) for v in (title, url)):
            return None
        taken = _time(_get(raw, "photoTakenTime"))
        created = _time(_get(raw, "creationTime"))
    except (ValueError, UnicodeDecodeError):
        return None
    text = taken or created
    number = int(text) if re.fullmatch(r"[+-]?[0-9]+", text) and -(2**63) <= int(text) < 2**63 else 0
    return {"title": title or "", "taken_at": number, "url": url or ""}


def sidecar_for(path: str) -> dict | None:
    for name in candidate_names(path):
        try:
            with open(name, "rb") as f:
                content = f.read()
        except OSError:
            continue
        if (meta := parse_sidecar(content)) is not None:
            return meta
    return None


def candidates(path: Column) -> Column:
    """``candidate_names`` as a Column: an array of paths."""
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    stem = F.left(base, F.length(base) - F.length(ext))
    marker = F.regexp_extract(stem, r"(\(\d+\))$", 1)
    plain = F.concat(F.left(stem, F.length(stem) - F.length(marker)), ext)
    first = F.array(F.concat(path, F.lit(".json")), F.concat(path, F.lit(".supplemental-metadata.json")), F.concat(folder, stem, F.lit(".json")))
    copies = F.array(F.concat(folder, plain, marker, F.lit(".json")), F.concat(folder, plain, F.lit(".supplemental-metadata"), marker, F.lit(".json")))
    return F.when(marker == "", first).otherwise(F.concat(first, copies))


def sidecar_join(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(path, sidecar, taken_at_unix, url) for media paths; sidecars: (path, ok, taken_at, url) of all JSON files, parsed.

    The readable candidate that comes first wins; media without one get nulls.
    """
    wanted = media.select("path", F.posexplode(candidates(F.col("path"))).alias("at", "name"))
    met = wanted.join(sidecars.where("ok").select(F.col("path").alias("name"), "taken_at", "url"), "name")
    best = met.groupBy("path").agg(F.min_by(F.struct("name", "taken_at", "url"), "at").alias("s"))
    return media.select("path").join(best, "path", "left").select("path", F.col("s.name").alias("sidecar"), F.col("s.taken_at").alias("taken_at_unix"), F.col("s.url").alias("url"))
