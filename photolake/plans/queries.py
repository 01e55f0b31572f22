"""The registered queries of the library's operators, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.functions.exprs import LABEL_KEYWORDS, USELESS_LABELS, label_bucket, short_path, unsigned, utc_day
from photolake.operators import detect, feedback, labels, manifest, match, review, similarity
from photolake.operators.overrides import FIELDS, resolve
from photolake.options import Options
from photolake.plans import views
from photolake.plans.library import scan_diff, upsert_images
from photolake.sources.sidecar import candidates as sidecar_candidates
from photolake.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
DEFAULT = Options()

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL parts

IM = f"""WITH RECURSIVE im0 AS ({views.IMAGES_DUCKDB}),
im AS (SELECT *, taken_at_unix AS mtime_unix, CAST(0 AS BIGINT) AS scanned_at_unix, CASE WHEN id % 3 = 0 THEN '' ELSE 'https://photos.example/' || CAST(id AS VARCHAR) END AS gphotos_url,
  '' AS content_label, CAST(0 AS DOUBLE) AS content_score FROM im0),
dec AS ({views.DECISIONS_DUCKDB})"""

BEST = "CAST(width AS BIGINT) * height DESC, blur_var DESC, taken_at_unix, strlen(path), id"
RULES = "rules AS (SELECT * FROM (VALUES ('/photos/src1', 80.0::DOUBLE, NULL::DOUBLE), ('/photos/src1/en', 30.0, 0.3), ('/photos/src2', NULL, 0.7)) t(prefix, blur, useless)), ov AS (SELECT id, arg_max(prefix, strlen(prefix)) AS prefix FROM im JOIN rules ON starts_with(path, prefix) GROUP BY id)"

EXACT = f"""exact0 AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS n, row_number() OVER (PARTITION BY sha256 ORDER BY {BEST}) AS rn, first_value(path) OVER (PARTITION BY sha256 ORDER BY {BEST}) AS kp FROM im),
exact1 AS (SELECT id AS image_id, 'exact_duplicate' AS category, CAST(1 AS DOUBLE) AS score,
  CASE WHEN rn = 1 THEN 'best of ' || n || ' byte-identical copies' ELSE 'byte-identical to ' || kp END AS reason, CAST(dense_rank() OVER (ORDER BY sha256) AS BIGINT) AS cluster_id, rn = 1 AS is_keeper FROM exact0 WHERE n > 1)"""


def _pairs(r: int) -> str:
    return f"p{r} AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.dhash, b.dhash)) AS INTEGER) AS dist FROM im a JOIN im b ON a.id < b.id AND bit_count(xor(a.dhash, b.dhash)) <= {r})"


def _clusters(r: int) -> str:
    return f"""{_pairs(r)}, u{r} AS (SELECT a, b FROM p{r} UNION SELECT b, a FROM p{r}),
w{r} AS (SELECT a AS x, a AS y FROM u{r} UNION SELECT w.x, u.b FROM w{r} w JOIN u{r} u ON u.a = w.y),
c{r} AS (SELECT x AS id, min(y) AS label, count(*) AS size FROM w{r} GROUP BY x)"""


NEAR = f"""{_clusters(6)}, near0 AS (SELECT im.*, label, size, row_number() OVER (PARTITION BY label ORDER BY {BEST}) AS rn, first_value(path) OVER (PARTITION BY label ORDER BY {BEST}) AS kp FROM im JOIN c6 USING (id)),
near1 AS (SELECT id AS image_id, 'near_duplicate' AS category, CAST(0.9 AS DOUBLE) AS score, CASE WHEN rn = 1 THEN 'sharpest of ' || size || ' near-identical frames' ELSE 'near-identical to ' || kp END AS reason,
  CAST(dense_rank() OVER (ORDER BY label) AS BIGINT) AS cluster_id, rn = 1 AS is_keeper FROM near0)"""

OVER = f"""{_clusters(12)}, over0 AS (SELECT im.*, label, size, row_number() OVER (PARTITION BY label ORDER BY {BEST}) AS rn FROM im JOIN c12 USING (id) WHERE size >= 5),
over1 AS (SELECT id AS image_id, 'overshoot' AS category, CAST(0.6 AS DOUBLE) AS score, CASE WHEN rn <= 3 THEN 'keeper from a set of ' || size || ' similar photos' ELSE '1 of ' || size || ' photos of the same subject' END AS reason,
  CAST(dense_rank() OVER (ORDER BY label) AS BIGINT) AS cluster_id, rn <= 3 AS is_keeper FROM over0)"""


def _low(name: str, source: str, blur: str) -> str:
    return f"""{name} AS (SELECT id AS image_id, 'low_quality' AS category,
  CASE WHEN blur_var > 0 AND blur_var < {blur} THEN greatest(0, least(1, ({blur} - blur_var) / {blur})) ELSE CAST(0.7 AS DOUBLE) END AS score,
  CASE WHEN blur_var > 0 AND blur_var < {blur} THEN 'blurry / soft focus (sharpness ' || printf('%.0f', blur_var) || ')' WHEN brightness > 0 AND brightness < 16 THEN 'very dark (brightness ' || printf('%.0f', brightness) || ')'
       ELSE 'over-exposed (brightness ' || printf('%.0f', brightness) || ')' END AS reason, CAST(0 AS BIGINT) AS cluster_id, false AS is_keeper
  FROM {source} WHERE (blur_var > 0 AND blur_var < {blur}) OR (brightness > 0 AND brightness < 16) OR brightness > 245)"""


def _useless(name: str, source: str, threshold: str = "0.45", own: str = "NULL") -> str:
    bucket = ", ".join(f"'{x}'" for x in USELESS_LABELS)
    return f"""{name}_0 AS (SELECT *, greatest(0, least(1, (20 - colorfulness) / 20)) AS cs, greatest(0, least(1, (brightness - 165) / 90)) AS bs FROM {source}),
{name}_1 AS (SELECT *, CASE WHEN content_label <> '' THEN content_label WHEN cs > 0 AND bs > 0 THEN 'document' ELSE '' END AS lab, CASE WHEN content_label <> '' THEN content_score WHEN cs > 0 AND bs > 0 THEN CAST(0.5 AS DOUBLE) * cs + CAST(0.5 AS DOUBLE) * bs ELSE 0 END AS sc FROM {name}_0),
{name} AS (SELECT id AS image_id, 'useless_content' AS category, CAST(sc AS DOUBLE) AS score, lab AS reason, CAST(0 AS BIGINT) AS cluster_id, false AS is_keeper FROM {name}_1
  WHERE CASE WHEN {own} IS NOT NULL THEN lab IN ({bucket}) AND sc >= {own} WHEN content_label <> '' THEN lab IN ({bucket}) ELSE lab <> '' AND sc >= {threshold} END)"""


LOW = _low("low1", "im", "CAST(120 AS DOUBLE)")
WITH_RULES = f"{RULES}, imr AS (SELECT im.*, coalesce(rules.blur, CAST(120 AS DOUBLE)) AS eff, rules.useless AS own, ov.prefix AS prefix FROM im LEFT JOIN ov USING (id) LEFT JOIN rules USING (prefix))"
LABELS = f"lab AS (SELECT i.path, {views.LABEL_CASE} AS label, CAST(d.doc_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS score FROM labels d JOIN im i ON i.id = d.doc_id)"
TAGGED = f"{LABELS}, tagged AS (SELECT im.* REPLACE (coalesce(lab.label, '') AS content_label, coalesce(lab.score, 0) AS content_score) FROM im LEFT JOIN lab USING (path))"
ALL = f"{EXACT}, {NEAR}, {OVER}, {LOW}, {_useless('use1', 'im')}, sug AS (SELECT * FROM exact1 UNION ALL SELECT * REPLACE (cluster_id + (SELECT max(cluster_id) FROM exact1) AS cluster_id) FROM near1 UNION ALL SELECT * REPLACE (cluster_id + (SELECT max(cluster_id) FROM exact1) + (SELECT max(cluster_id) FROM near1) AS cluster_id) FROM over1 UNION ALL SELECT * FROM low1 UNION ALL SELECT * FROM use1)"
SUG = "image_id, category, score, reason, cluster_id, is_keeper"


# ---------------------------------------------------------------- detection


@query(f"{IM} SELECT id, path, sha256, dhash, size_bytes, width, height, blur_var, brightness, colorfulness, taken_at_unix FROM im")
def images_view(spark, sf_dir):
    return views.images(spark, sf_dir).select("id", "path", "sha256", "dhash", "size_bytes", "width", "height", "blur_var", "brightness", "colorfulness", "taken_at_unix")


@query(f"{IM}, {EXACT} SELECT {SUG} FROM exact1")
def exact_duplicate(spark, sf_dir):
    return detect.exact_duplicates(views.images(spark, sf_dir))


@query(f"{IM} SELECT sha256, count(*) AS copies, string_agg(path, '|' ORDER BY path) AS paths FROM im GROUP BY sha256 HAVING count(*) > 1")
def dupes_report(spark, sf_dir):
    return detect.duplicate_report(views.images(spark, sf_dir)).withColumn("paths", F.array_join("paths", "|"))


@query(f"{IM}, {_pairs(6)} SELECT * FROM p6")
def hamming_pairs_r6(spark, sf_dir):
    return similarity.image_pairs(views.images(spark, sf_dir), 6)


@query(f"{IM}, {_pairs(12)} SELECT * FROM p12")
def hamming_pairs_r12(spark, sf_dir):
    return similarity.image_pairs(views.images(spark, sf_dir), 12)


@query(f"{IM}, {NEAR} SELECT {SUG} FROM near1")
def near_duplicate(spark, sf_dir):
    return detect.near_duplicates(views.images(spark, sf_dir), DEFAULT)


@query(f"{IM}, {OVER} SELECT {SUG} FROM over1")
def overshoot(spark, sf_dir):
    return detect.overshoot(views.images(spark, sf_dir), DEFAULT)


@query(f"{IM}, {LOW} SELECT * FROM low1")
def low_quality(spark, sf_dir):
    return detect.low_quality(views.images(spark, sf_dir), DEFAULT)


@query(f"{IM}, {WITH_RULES}, {_low('low2', 'imr', 'eff')} SELECT * FROM low2")
def low_quality_overrides(spark, sf_dir):
    return detect.low_quality(views.images(spark, sf_dir), DEFAULT, views.rules(spark))


@query(f"{IM}, {_useless('use1', 'im')} SELECT * FROM use1")
def useless_heuristic(spark, sf_dir):
    return detect.useless(views.images(spark, sf_dir), DEFAULT)


def _tagged(spark, sf_dir):
    return labels.apply_labels(views.images(spark, sf_dir), views.labels_in(spark, sf_dir))[0]


@query(f"{IM}, {TAGGED}, {_useless('use2', 'tagged')} SELECT * FROM use2")
def useless_labelled(spark, sf_dir):
    return detect.useless(_tagged(spark, sf_dir), DEFAULT)


@query(f"{IM}, {TAGGED}, {WITH_RULES}, tr AS (SELECT tagged.*, imr.own FROM tagged JOIN imr USING (id)), {_useless('use3', 'tr', own='own')} SELECT * FROM use3")
def useless_overrides(spark, sf_dir):
    return detect.useless(_tagged(spark, sf_dir), DEFAULT, views.rules(spark))


@query(f"{IM}, {ALL} SELECT {SUG} FROM sug")
def suggestions_all(spark, sf_dir):
    return detect.detect_all(views.images(spark, sf_dir), DEFAULT)


def _suggestions(spark, sf_dir):
    return stored(suggestions_all(spark, sf_dir), "suggestions")


def _decisions(spark, sf_dir):
    return review.latest_decisions(views.decision_log(spark, sf_dir))


@query(f"{IM}, {ALL} SELECT category, count(*) AS n FROM sug WHERE NOT is_keeper GROUP BY category")
def summary_by_category(spark, sf_dir):
    return detect.summarise(suggestions_all(spark, sf_dir))


@query(f"""{IM}, {ALL} SELECT (SELECT count(*) FROM im) AS total, (SELECT count(DISTINCT image_id) FROM sug WHERE NOT is_keeper) AS candidates, (SELECT count(*) FROM dec) AS decided,
(SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM sug WHERE NOT is_keeper GROUP BY category)) AS counts""")
def summary_totals(spark, sf_dir):
    out = review.summary(views.images(spark, sf_dir), _suggestions(spark, sf_dir), _decisions(spark, sf_dir))
    return out.withColumn("counts", F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ","))


# ---------------------------------------------------------------- decisions and learning


@query(f"{IM} SELECT image_id, action, decided_at_unix FROM dec")
def decisions_latest(spark, sf_dir):
    return _decisions(spark, sf_dir)


@query(f"{IM}, {LOW} SELECT category, count(*) AS total, CAST(count(*) FILTER (WHERE action = 'keep') AS BIGINT) AS kept FROM low1 JOIN dec USING (image_id) WHERE NOT is_keeper GROUP BY category")
def feedback_counts(spark, sf_dir):
    return feedback.decision_counts(low_quality(spark, sf_dir), _decisions(spark, sf_dir))


LEARNED = f"fb AS (SELECT count(*) AS total, count(*) FILTER (WHERE action = 'keep') AS kept FROM low1 JOIN dec USING (image_id)), thr AS (SELECT CASE WHEN total >= 20 AND kept > 0.5 * total THEN CAST(90 AS DOUBLE) ELSE CAST(120 AS DOUBLE) END AS blur FROM fb)"


def _learned(spark, sf_dir):
    return feedback.learn(low_quality(spark, sf_dir), _decisions(spark, sf_dir), DEFAULT)[0]


@query(f"{IM}, {LOW}, {LEARNED} SELECT blur AS blur_threshold, CAST(0.45 AS DOUBLE) AS useless_threshold FROM thr")
def feedback_thresholds(spark, sf_dir):
    o = _learned(spark, sf_dir)
    return spark.createDataFrame([(o.blur_threshold, o.classifier.threshold)], "blur_threshold double, useless_threshold double")


@query(f"{IM}, {LOW}, {LEARNED}, iml AS (SELECT im.*, blur AS eff FROM im, thr), {_low('low3', 'iml', 'eff')} SELECT * FROM low3")
def analyze_learned(spark, sf_dir):
    return detect.low_quality(views.images(spark, sf_dir), _learned(spark, sf_dir))


# ---------------------------------------------------------------- manifest and review

ENTRY = "id, path, CAST(CASE WHEN dhash < 0 THEN dhash::HUGEINT + 18446744073709551616::HUGEINT ELSE dhash END AS VARCHAR) AS dhash, taken_at_unix AS taken_at, gphotos_url"


def _text_hash(entries):
    return entries.withColumn("dhash", F.col("dhash").cast("string"))


@query(f"{IM}, {ALL} SELECT {ENTRY} FROM im WHERE id IN (SELECT image_id FROM sug WHERE NOT is_keeper)")
def manifest_candidates(spark, sf_dir):
    return _text_hash(manifest.candidates(views.images(spark, sf_dir), suggestions_all(spark, sf_dir)))


@query(f"{IM} SELECT {ENTRY} FROM im WHERE id IN (SELECT image_id FROM dec WHERE action = 'delete')")
def manifest_confirmed(spark, sf_dir):
    images = views.images(spark, sf_dir)
    return _text_hash(manifest.manifest(images, exact_duplicate(spark, sf_dir), _decisions(spark, sf_dir)))


@query(f"{IM} SELECT id, path, CASE WHEN gphotos_url = '' THEN 'manual' ELSE 'automatic' END AS way FROM im WHERE id IN (SELECT image_id FROM dec WHERE action = 'delete')")
def manual_review_split(spark, sf_dir):
    known, manual = manifest.split_by_url(manifest.confirmed(views.images(spark, sf_dir), _decisions(spark, sf_dir)))
    return known.select("id", "path", F.lit("automatic").alias("way")).union(manual.select("id", "path", F.lit("manual")))


GROUPS = f"""grp AS (SELECT CASE WHEN cluster_id = 0 THEN -image_id ELSE cluster_id END AS group_key, cluster_id, image_id AS id, path, width, height, blur_var, taken_at_unix AS taken_at, gphotos_url, is_keeper, reason, score, coalesce(action, '') AS decision
FROM %s s JOIN im ON im.id = s.image_id LEFT JOIN dec USING (image_id))"""


@query(f"{IM}, {EXACT}, {LOW}, both_ AS (SELECT * FROM exact1 UNION ALL SELECT * FROM low1), {GROUPS % 'both_'} SELECT * FROM grp")
def groups_view(spark, sf_dir):
    images, decisions = views.images(spark, sf_dir), _decisions(spark, sf_dir)
    rows = exact_duplicate(spark, sf_dir).unionByName(low_quality(spark, sf_dir))
    return review.group_rows(images, rows, decisions, "exact_duplicate").unionByName(review.group_rows(images, rows, decisions, "low_quality"))


@query(f"{IM}, {EXACT}, {GROUPS % 'exact1'} SELECT cluster_id, CAST(count(*) AS BIGINT) AS images, string_agg(CAST(id AS VARCHAR), ',' ORDER BY is_keeper DESC, taken_at, id) AS ids FROM grp GROUP BY group_key, cluster_id")
def groups_assembled(spark, sf_dir):
    found = review.groups(views.images(spark, sf_dir), exact_duplicate(spark, sf_dir), _decisions(spark, sf_dir), "exact_duplicate")
    return found.select("cluster_id", F.size("images").cast("long").alias("images"), F.array_join(F.col("images.id").cast("array<string>"), ",").alias("ids"))


def _exact_rows(spark, sf_dir):
    return review.group_rows(views.images(spark, sf_dir), exact_duplicate(spark, sf_dir), _decisions(spark, sf_dir), "exact_duplicate")


@query(f"{IM}, {EXACT}, {GROUPS % 'exact1'} SELECT id AS image_id, 'delete' AS action FROM grp WHERE NOT is_keeper AND decision <> 'delete'")
def review_accept_default(spark, sf_dir):
    return review.accept_default(_exact_rows(spark, sf_dir)).select("image_id", "action")


@query(f"{IM}, {EXACT}, {GROUPS % 'exact1'} SELECT id AS image_id, 'clear' AS action FROM grp WHERE decision <> ''")
def review_keep_all(spark, sf_dir):
    return review.keep_all(_exact_rows(spark, sf_dir)).select("image_id", "action")


@query(f"{IM}, {EXACT}, {GROUPS % 'exact1'} SELECT id AS image_id, 'delete' AS action FROM grp WHERE NOT is_keeper")
def review_select_all(spark, sf_dir):
    return review.select_all(_exact_rows(spark, sf_dir)).select("image_id", "action")


# ---------------------------------------------------------------- labels, rules, matching, scan


@query(f"{IM}, {TAGGED} SELECT id, path, content_label, content_score, (SELECT count(*) FROM lab JOIN im USING (path)) AS matched FROM tagged")
def label_import(spark, sf_dir):
    rows, n = labels.apply_labels(views.images(spark, sf_dir), views.labels_in(spark, sf_dir))
    return rows.select("id", "path", "content_label", "content_score", F.lit(n).cast("long").alias("matched"))


@query(f"{IM}, {RULES} SELECT id, ov.prefix AS ov_prefix, rules.blur AS ov_blur_threshold, rules.useless AS ov_useless_threshold FROM im LEFT JOIN ov USING (id) LEFT JOIN rules USING (prefix)")
def override_resolution(spark, sf_dir):
    return resolve(views.images(spark, sf_dir), views.rules(spark)).select("id", "ov_prefix", *(f"ov_{f}" for f in FIELDS if f in ("blur_threshold", "useless_threshold")))


@query(f"{IM}, {_clusters(6)} SELECT id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY {BEST}) AS INTEGER) AS rank FROM im JOIN c6 USING (id)")
def keeper_ranking(spark, sf_dir):
    from pyspark.sql import Window

    images = views.images(spark, sf_dir)
    met = images.join(similarity.clusters(images, 6), "id")
    return met.select("id", "label", F.row_number().over(Window.partitionBy("label").orderBy(*detect.best_first())).alias("rank"))


LISTING = "lst AS (SELECT path, CASE WHEN id % 5 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, mtime_unix FROM im), old AS (SELECT * FROM im WHERE id % 4 <> 0)"


def _listing(images):
    return images.select("path", F.when(F.col("id") % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), "mtime_unix")


@query(f"{IM}, {LISTING} SELECT lst.path, CASE WHEN old.id IS NULL THEN 'new' WHEN old.size_bytes = lst.size_bytes AND old.mtime_unix = lst.mtime_unix THEN 'skipped' ELSE 'changed' END AS status FROM lst LEFT JOIN old USING (path)")
def incremental_scan_diff(spark, sf_dir):
    images = views.images(spark, sf_dir)
    return scan_diff(_listing(images), images.where("id % 4 <> 0")).select("path", "status")


@query(f"""{IM}, {LISTING}, chg AS (SELECT im.* REPLACE (lst.size_bytes AS size_bytes) FROM lst JOIN im USING (path) LEFT JOIN old ON old.path = lst.path WHERE old.id IS NULL OR old.size_bytes <> lst.size_bytes)
SELECT old.id, old.path, coalesce(chg.size_bytes, old.size_bytes) AS size_bytes, 'photo' AS content_label FROM old LEFT JOIN chg USING (path)
UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY path), path, size_bytes, '' FROM chg WHERE path NOT IN (SELECT path FROM old)""")
def image_upsert(spark, sf_dir):
    images = views.images(spark, sf_dir)
    old = images.where("id % 4 <> 0").withColumn("content_label", F.lit("photo"))
    todo = scan_diff(_listing(images), old).where("status <> 'skipped'").select("path", "size_bytes")
    scanned = images.drop("size_bytes").join(todo, "path")
    return upsert_images(old, scanned).select("id", "path", "size_bytes", "content_label")


@query(f"""{IM}, m AS (SELECT id, CASE WHEN id % 2 = 0 THEN path ELSE regexp_replace(path, '\\.jpg$', '(' || (id % 9) || ').jpg') END AS path FROM im), s AS (SELECT *, regexp_replace(path, '\\.jpg$', '') AS stem, regexp_replace(path, '\\([0-9]+\\)\\.jpg$', '.jpg') AS plain, regexp_extract(path, '(\\([0-9]+\\))\\.jpg$', 1) AS mark FROM m)
SELECT id, 0 AS at, path || '.json' AS name FROM s UNION ALL SELECT id, 1, path || '.supplemental-metadata.json' FROM s UNION ALL SELECT id, 2, stem || '.json' FROM s
UNION ALL SELECT id, 3, plain || mark || '.json' FROM s WHERE mark <> '' UNION ALL SELECT id, 4, plain || '.supplemental-metadata' || mark || '.json' FROM s WHERE mark <> ''""")
def sidecar_names(spark, sf_dir):
    images = views.images(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, F.col("path")).otherwise(F.concat(F.regexp_replace("path", r"\.jpg$", ""), F.lit("("), (F.col("id") % 9).cast("string"), F.lit(").jpg"))).alias("path"))
    return images.select("id", F.posexplode(sidecar_candidates(F.col("path"))).alias("at", "name"))


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
x AS (SELECT label, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS y FROM v), c AS (SELECT label, list(m ORDER BY i) AS e FROM (SELECT label, i, avg(y) AS m FROM x GROUP BY label, i) GROUP BY label),
s AS (SELECT v.id, c.label, 100 * list_cosine_similarity(v.e, c.e) AS logit FROM v, c),
t AS (SELECT id, label, logit, max(logit) OVER (PARTITION BY id) AS top FROM s), p AS (SELECT id, label, exp(logit - top) / sum(exp(logit - top)) OVER (PARTITION BY id) AS prob, row_number() OVER (PARTITION BY id ORDER BY logit DESC, label) AS rn FROM t)
SELECT id, CASE label WHEN 0 THEN 'document' WHEN 1 THEN 'receipt' WHEN 2 THEN 'screenshot' WHEN 3 THEN 'product in a store' WHEN 4 THEN 'broken item to replace' WHEN 5 THEN 'whiteboard or notes' ELSE 'photo' END AS label, round(prob, 6) AS score FROM p WHERE rn = 1""")
def zero_shot_labels(spark, sf_dir):
    v = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    mean = v.select("label", F.posexplode("vector")).groupBy("label", "pos").agg(F.avg("col").alias("m")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("s"))
    names = F.array(*map(F.lit, USELESS_LABELS))
    prompts = mean.select(F.format_string("%02d", F.col("label")).alias("prompt"), F.coalesce(F.get(names, F.col("label")), F.lit("photo")).alias("bucket"), F.col("s.m").alias("vector"))
    return labels.zero_shot(v.select("id", "vector"), prompts).select("id", "label", F.round("score", 6).alias("score"))


@query(f"""{IM}, c AS (SELECT id AS cid, xor(dhash, 1::BIGINT << CAST(id % 62 AS INT)) AS h, CAST(floor(taken_at_unix / 86400) AS BIGINT) AS cday FROM im WHERE id % 7 <> 0),
p AS (SELECT q.id AS qid, c.cid, CAST(bit_count(xor(q.dhash, c.h)) AS INT) AS d, row_number() OVER (PARTITION BY q.id ORDER BY bit_count(xor(q.dhash, c.h)), c.cid) AS rn FROM im q JOIN c ON c.cday = CAST(floor(q.taken_at_unix / 86400) AS BIGINT)),
g AS (SELECT qid, max(CASE WHEN rn = 1 THEN cid END) AS cid, max(CASE WHEN rn = 1 THEN d END) AS best, coalesce(max(CASE WHEN rn = 2 THEN d END), 999) AS second_best FROM p WHERE rn <= 2 GROUP BY qid)
SELECT *, CASE WHEN best > 4 THEN 'unmatched' WHEN second_best - best < 6 THEN 'ambiguous' ELSE 'accepted' END AS status FROM g""")
def timeline_match(spark, sf_dir):
    return match.match_by_day(views.images(spark, sf_dir), views.thumbnails(spark, sf_dir))


def _names_sql() -> str:
    case = " ".join(f"WHEN contains(lower(n), '{k}') THEN '{v}'" for k, v in LABEL_KEYWORDS)
    return f"SELECT p_partkey AS id, CASE {case} ELSE '' END AS bucket FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Web Site ' WHEN 1 THEN 'notebook ' WHEN 2 THEN 'SCREEN ' WHEN 3 THEN 'a price tag, ' WHEN 4 THEN 'desktop monitor menu ' ELSE '' END || p_name AS n FROM part)"


@query(_names_sql())
def label_to_bucket(spark, sf_dir):
    start = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'Web Site ' WHEN 1 THEN 'notebook ' WHEN 2 THEN 'SCREEN ' WHEN 3 THEN 'a price tag, ' WHEN 4 THEN 'desktop monitor menu ' ELSE '' END")
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label_bucket(F.concat(start, F.col("p_name"))).alias("bucket"))


@query(f"{IM} SELECT id, CAST(CASE WHEN dhash < 0 THEN dhash::HUGEINT + 18446744073709551616::HUGEINT ELSE dhash END AS VARCHAR) AS dhash, strftime(make_timestamp(taken_at_unix * 1000000), '%Y-%m-%d') AS day FROM im")
def unsigned_dhash(spark, sf_dir):
    return views.images(spark, sf_dir).select("id", unsigned(F.col("dhash")).cast("string").alias("dhash"), utc_day(F.col("taken_at_unix")).alias("day"))


@query("SELECT doc_id AS id, CASE WHEN n <= 48 THEN p ELSE '...' || right(p, 48) END AS short FROM (SELECT doc_id, strlen(p) AS n, p FROM (SELECT doc_id, '/library/albums/' || repeat('x', CAST(doc_id % 40 AS INT)) || '/IMG_' || CAST(doc_id AS VARCHAR) || '.jpg' AS p FROM documents))")
def short_paths(spark, sf_dir):
    path = F.concat(F.lit("/library/albums/"), F.repeat(F.lit("x"), (F.col("doc_id") % 40).cast("int")), F.lit("/IMG_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    return views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), short_path(path).alias("short"))


@query(f"{IM} SELECT decision AS outcome, count(*) AS n FROM (SELECT coalesce(action, 'none') AS decision FROM im LEFT JOIN dec ON dec.image_id = im.id ORDER BY im.id LIMIT 500) GROUP BY decision")
def deletion_tally(spark, sf_dir):
    met = views.images(spark, sf_dir).join(_decisions(spark, sf_dir).withColumnRenamed("image_id", "id"), "id", "left")
    return manifest.tally(met.select("id", F.coalesce("action", F.lit("none")).alias("outcome")), 500)


@query(f"{IM} SELECT image_id, action, decided_at_unix FROM dec")
def decision_stream(spark, sf_dir):
    """The decision log replayed through Structured Streaming; its final state."""
    import uuid

    from photolake.operators.graph import numbered
    from photolake.storage import new_path
    from photolake.streaming.decisions import live_decisions, read_log

    log = views.decision_log(spark, sf_dir)
    path = new_path(spark, "log")
    numbered(log, "seq", column="n").withColumn("seq", F.col("n")).drop("n").write.json(path)
    name = f"decisions_{uuid.uuid4().hex}"
    live_decisions(read_log(spark, path), name, new_path(spark, "stream")).awaitTermination()
    return spark.table(name)


@query()
def scan_features(spark, sf_dir):
    """Features of generated PNG files, read back by the scan."""
    import os
    import tempfile

    from photolake.sources.files import list_files, read_images
    from photolake.sources.png import checkerboard, flat, write_png

    folder = tempfile.mkdtemp(prefix="photolake-png-")
    for name, img in (("a.png", checkerboard(128, 128, 8)), ("b.png", flat(128, 128, 128)), ("c.png", checkerboard(160, 120, 10))):
        write_png(os.path.join(folder, name), img)
    return read_images(list_files(spark, folder), 0).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "sha256", "dhash", "width", "height", "blur_var", "brightness", "colorfulness", "status")
