"""Views over the driver's tables that stand for a library: images, decisions, labels, rules, thumbnails.

The images view and its columns come from ``documents`` by integer arithmetic and hashes, so Spark and DuckDB agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake import schema
from photolake.storage import stored

IMAGES = """
WITH b AS (SELECT doc_id, lang, source, n_chars, sha2(text,256) AS sha FROM documents),
k AS (SELECT *, CASE WHEN substr(sha,1,1) IN ('0','1','2','3') THEN substr(sha,1,2) ELSE substr(sha,1,3) END AS burst,
  CASE WHEN substr(sha,1,1) IN ('8','9','a','b') THEN 5 ELSE 3 END AS nflip FROM b),
h AS (SELECT *, (shiftleft(cast(conv(substr(md5(burst),1,8),16,10) as bigint),32) | cast(conv(substr(md5(burst),9,8),16,10) as bigint)) AS base, cast(conv(substr(sha,17,2),16,10) as int) % 64 AS f1, cast(conv(substr(sha,21,2),16,10) as int) % 64 AS f2, cast(conv(substr(sha,25,2),16,10) as int) % 64 AS f3, cast(conv(substr(sha,29,2),16,10) as int) % 64 AS f4, cast(conv(substr(sha,33,2),16,10) as int) % 64 AS f5 FROM k)
SELECT doc_id AS id, concat('/photos/', source, '/', lang, '/IMG_', CAST(doc_id AS STRING), '.jpg') AS path,
 sha AS sha256,
 (base ^ shiftleft(1L,f1) ^ shiftleft(1L,f2) ^ shiftleft(1L,f3) ^ (case when nflip=5 then shiftleft(1L,f4) ^ shiftleft(1L,f5) else 0L end)) AS dhash,
 n_chars AS size_bytes,
 CAST(640 + 64*(n_chars % 7) AS INT) AS width, CAST(480 + 48*(n_chars % 5) AS INT) AS height,
 CAST((n_chars*37) % 400 AS DOUBLE) AS blur_var, CAST((n_chars*13) % 256 AS DOUBLE) AS brightness, CAST((n_chars*29) % 90 AS DOUBLE) AS colorfulness,
 CAST(1704067200 + (doc_id % 30)*86400 + (n_chars % 86400) AS BIGINT) AS taken_at_unix
FROM h
"""

IMAGES_DUCKDB = """
WITH b AS (SELECT doc_id, lang, source, n_chars, sha256(text) AS sha FROM documents),
k AS (SELECT *, CASE WHEN substr(sha,1,1) IN ('0','1','2','3') THEN substr(sha,1,2) ELSE substr(sha,1,3) END AS burst,
  CASE WHEN substr(sha,1,1) IN ('8','9','a','b') THEN 5 ELSE 3 END AS nflip FROM b),
h AS (SELECT *, (('0x'||substr(md5(burst),1,16))::UBIGINT) AS base, (('0x'||substr(sha,17,2))::UBIGINT % 64) AS f1, (('0x'||substr(sha,21,2))::UBIGINT % 64) AS f2, (('0x'||substr(sha,25,2))::UBIGINT % 64) AS f3, (('0x'||substr(sha,29,2))::UBIGINT % 64) AS f4, (('0x'||substr(sha,33,2))::UBIGINT % 64) AS f5 FROM k)
SELECT doc_id AS id, concat('/photos/', source, '/', lang, '/IMG_', CAST(doc_id AS VARCHAR), '.jpg') AS path,
 sha AS sha256,
 (CASE WHEN xor(xor(xor(xor(xor(base,(1::UBIGINT<<f1)),(1::UBIGINT<<f2)),(1::UBIGINT<<f3)),case when nflip=5 then (1::UBIGINT<<f4) else 0::UBIGINT end),case when nflip=5 then (1::UBIGINT<<f5) else 0::UBIGINT end) >= 9223372036854775808::UBIGINT THEN CAST(xor(xor(xor(xor(xor(base,(1::UBIGINT<<f1)),(1::UBIGINT<<f2)),(1::UBIGINT<<f3)),case when nflip=5 then (1::UBIGINT<<f4) else 0::UBIGINT end),case when nflip=5 then (1::UBIGINT<<f5) else 0::UBIGINT end)::HUGEINT - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST(xor(xor(xor(xor(xor(base,(1::UBIGINT<<f1)),(1::UBIGINT<<f2)),(1::UBIGINT<<f3)),case when nflip=5 then (1::UBIGINT<<f4) else 0::UBIGINT end),case when nflip=5 then (1::UBIGINT<<f5) else 0::UBIGINT end) AS BIGINT) END) AS dhash,
 n_chars AS size_bytes,
 CAST(640 + 64*(n_chars % 7) AS INT) AS width, CAST(480 + 48*(n_chars % 5) AS INT) AS height,
 CAST((n_chars*37) % 400 AS DOUBLE) AS blur_var, CAST((n_chars*13) % 256 AS DOUBLE) AS brightness, CAST((n_chars*29) % 90 AS DOUBLE) AS colorfulness,
 CAST(1704067200 + (doc_id % 30)*86400 + (n_chars % 86400) AS BIGINT) AS taken_at_unix
FROM h
"""

#: (prefix, blur, dark, bright, useless); null fields inherit the global value.
RULES = (("/photos/src1", 80.0, None, None, None), ("/photos/src1/en", 30.0, None, None, 0.3), ("/photos/src2", None, None, None, 0.7))

DECISIONS_DUCKDB = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events)
SELECT user_id AS image_id, CASE event_type WHEN 'error' THEN 'delete' ELSE 'keep' END AS action,
       CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS decided_at_unix
FROM r WHERE rn = 1 AND event_type <> 'view'
"""

LABEL_CASE = """CASE d.doc_id % 7 WHEN 0 THEN 'document' WHEN 1 THEN 'receipt' WHEN 2 THEN 'screenshot'
  WHEN 3 THEN 'product in a store' WHEN 4 THEN 'broken item to replace' WHEN 5 THEN 'whiteboard or notes' ELSE 'photo' END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(IMAGES.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    fill = {"mtime_unix": F.col("taken_at_unix"), "scanned_at_unix": F.lit(0).cast("long"), "gphotos_url": F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("https://photos.example/"), F.col("id").cast("string"))), "content_label": F.lit(""), "content_score": F.lit(0.0)}
    # written, as an image table is: the hashes are computed once however often a query reads it
    return stored(rows.withColumns(fill).select(*schema.IMAGES.fieldNames()), "images")


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a decision log: ``error`` deletes, ``view`` clears, the rest keep; seq in order of time."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    action = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "clear").otherwise("keep")
    return e.select(F.struct(micros, "event_id").alias("seq"), F.col("user_id").alias("image_id"), action.alias("action"), F.floor(micros / 1000000).cast("long").alias("decided_at_unix"))


def labels_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").select("doc_id").alias("d")
    i = images(spark, sf_dir).select("id", "path")
    return d.join(i, F.col("d.doc_id") == F.col("id")).select("path", F.expr(LABEL_CASE).alias("label"), (F.col("doc_id") % 100 / F.lit(100.0)).alias("score"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), schema.OVERRIDES)


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the timeline match: the images with one bit of noise, without every seventh."""
    noisy = F.col("dhash").bitwiseXOR(F.expr("shiftleft(1L, CAST(id % 62 AS INT))"))
    return images(spark, sf_dir).where("id % 7 <> 0").select(F.col("id").alias("cid"), F.floor(F.col("taken_at_unix") / 86400).alias("day"), noisy.alias("h"))
