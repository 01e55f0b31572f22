"""Secret scans with corpus-wide ownership frequency.

Every text is scanned once for the base secrets and for other strings that look like credentials (long, mixed,
high entropy). Only hashes of candidates leave the scan. They are counted by repository and owner over the corpus, each text
once. What several owners have, or more than ``most_repositories`` repositories of one owner or more than ``most_texts`` different texts,
is a copied example; the rest is specific to its owner and looks live. Base secrets always stay; other candidates become spans of
kind ``token`` if they look live.

Defined results: a null text is empty; null owners or repositories are one owner or repository; rows with the same id and text
have the same spans; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photolake.llm.common import small, stored, text_slices
from photolake.llm.spans import SECRET_KINDS, digest, outside, secret_spans

LONG = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
ENTROPY = 3.5
CANDIDATE = "array<struct<kind:int,start:int,end:int,value:string>>"
SCANNED = f"doc_id long, h long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found {CANDIDATE}"


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_random(value: str) -> bool:
    kinds = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value)
    return kinds >= 2 and any(c.isdigit() for c in value) and entropy(value) >= ENTROPY


def candidates(text: str) -> list[tuple[tuple[int, int, int], str]]:
    """Base secrets, and strings of kind 3 that look like credentials outside of them."""
    base = secret_spans(text)
    more = [(m.start(), m.end(), ((m.start(), 3, m.end()), m[0])) for m in LONG.finditer(text) if looks_random(m[0])]
    return sorted(base + outside(more, [s for s, _ in base]))


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row for each document, with the candidates' hashes."""

    def run(batches):
        for batch in text_slices(batches):
            counts, digests, found = ([], [], []), [], []
            for text in batch.column("text").to_pylist():
                all_spans = candidates(text or "")
                base = [s for s, _ in all_spans if s[1] < 3]
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(digest(base, SECRET_KINDS))
                found.append([{"kind": k, "start": a, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).hexdigest()} for (a, k, b), v in all_spans])
            item = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "h", "owner", "repository")), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(found, item)],
                names=["doc_id", "h", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCANNED)


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories, documents) over the corpus; found has value, owner and repository."""
    by_repository = found.groupBy("value", "owner", "repository").agg(F.count("*").alias("documents"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("documents").alias("documents"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("documents").alias("documents"))


def find_secrets(docs: DataFrame, owner: Column, repository: Column, most_owners: int = 1, most_repositories: int = 3, most_texts: int = 8) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    rows = stored(scan(docs, owner, repository), "secrets")
    found = rows.select("doc_id", "h", "owner", "repository", F.explode("found").alias("f")).select("doc_id", "h", "owner", "repository", "f.*")
    is_live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories) & (F.col("documents") <= most_texts)
    # only what is copied is joined back, from a written table: both sides are plain shuffles, whose large partitions are split
    texts = found.select("value", "owner", "repository", "h").distinct()
    copied = stored(ownership(texts).where(~is_live).select(F.col("value").alias("copied")), "copied")
    n = copied.count()
    live = F.col("copied").isNull()
    told = found.select("doc_id", "h", "kind", "start", "end", "value").distinct().join(small(copied, n, 64), F.col("value") == F.col("copied"), "left")
    span = F.struct("start", "kind", "end")
    told = told.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.when((F.col("kind") < 3) | live, span))).alias("spans"), F.count(F.when(live, 1)).alias("n_live"), F.count(F.when(~live, 1)).alias("n_copied"))
    told = told.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "spans", "n_live", "n_copied")
    kinds = F.array(*map(F.lit, SECRET_KINDS))
    text = F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    out = rows.drop("found").join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(F.array_join(text, ","), F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))
