"""The registered queries of the corpus operators: ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photolake.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photolake.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
s AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM s q JOIN s c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photolake.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("h")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photolake.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from photolake.llm.token_ids import tokenize

    return tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from photolake.llm.secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from photolake.llm.line_dedup import repeated_lines

    return repeated_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photolake.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("h")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item_id, w, least(len(w), 13) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM k)),
z AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, z WHERE len(w) >= n)),
m AS (SELECT DISTINCT p.doc_id, p.n, p.s, g.item_id FROM p JOIN g ON g.n = p.n AND g.x = p.x),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (na + nb - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = s.doc_id
"""


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from photolake.llm.private_data import find_private

    return find_private(_table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from photolake.llm.passages import repeated_passages

    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string"))), ","), F.lit(""))
    found = repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_repeated", "n_dropped", text("spans").alias("spans"), text("dropped").alias("dropped"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_nearest": OP1_SQL, "op7_decontamination": OP7_SQL, "op8_near_duplicates": OP8_SQL}
