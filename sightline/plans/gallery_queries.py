"""Queries over captures, probes and the gallery."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import schemas
from sightline.functions import quality as fq
from sightline.functions import text as fx
from sightline.operators import match, registry
from sightline.operators.enrolment import accept_samples, commit_enrichment, committable, enrich_gallery, pose_coverage
from sightline.operators.numbering import dense_ids
from sightline.operators.greedy import deduplicate, fill_buffer
from sightline.operators.similarity import similarity_topk
from sightline.params import POSES_ALL, DuplicateParams, EnrichParams, EnrolParams, MatchParams
from sightline.plans.catalog import query
from sightline.sources import views
from sightline.sources.views import check_sql

# The test vectors are unrelated, so thresholds are set where the data has cases.
MATCH = MatchParams(accept=0.35, floor=0.30, single_shot_min=0.35)
DUP = DuplicateParams(near=0.25, session=0.25, hard=0.40, soft=0.30)

PAIRS = """
, pairs AS (SELECT p.capture_id AS pid, p.entity_id AS pe, g.capture_id AS gid, g.entity_id AS ge,
  list_cosine_similarity(p.embedding, g.embedding) AS sim FROM probes p CROSS JOIN gallery g)
"""
BEST = PAIRS + """
, best AS (SELECT pid, arg_max(ge, sim) AS ge, max(sim) AS sim FROM pairs WHERE sim>=0.30 GROUP BY pid)
"""


@query("vector_topk", check_sql(PAIRS + """
SELECT pid AS capture_id, gid AS match_id, ge AS match_label, round(sim,6) AS similarity, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gid) AS rn FROM pairs WHERE sim>=0.2) WHERE rn<=5""",
    "probes", "gallery"))
def vector_topk(spark, sf):
    hits = similarity_topk(views.probes(spark, sf), views.gallery(spark, sf), "capture_id", "capture_id", 5, 0.2)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("vector_topk_blocks", check_sql(PAIRS + """
SELECT pid AS capture_id, gid AS match_id, ge AS match_label, round(sim,6) AS similarity, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gid) AS rn FROM pairs WHERE sim>=0.1) WHERE rn<=10""",
    "probes", "gallery"))
def vector_topk_blocks(spark, sf):
    hits = similarity_topk(
        views.probes(spark, sf), views.gallery(spark, sf), "capture_id", "capture_id", 10, 0.1, block_rows=150
    )
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("vector_top1_match", check_sql(BEST + """
SELECT p.capture_id, CASE WHEN b.sim>=0.35 THEN b.ge ELSE 'unknown' END AS entity_id, round(coalesce(b.sim,0),4) AS similarity
FROM probes p LEFT JOIN best b ON p.capture_id=b.pid""", "probes", "gallery"))
def vector_top1_match(spark, sf):
    return match.match_entities(views.probes(spark, sf), views.gallery(spark, sf), "capture_id", "capture_id", MATCH)


@query("vector_match_status", check_sql(BEST + """
SELECT p.capture_id, coalesce(b.ge,'unknown') AS entity_id, round(coalesce(b.sim,0),4) AS similarity,
  CASE WHEN b.sim>=0.35 THEN 'RECOGNIZED' WHEN b.sim>=0.30 THEN 'POSSIBLE_MATCH' ELSE 'UNKNOWN' END AS status
FROM probes p LEFT JOIN best b ON p.capture_id=b.pid""", "probes", "gallery"))
def vector_match_status(spark, sf):
    return match.match_with_status(views.probes(spark, sf), views.gallery(spark, sf), "capture_id", "capture_id", MATCH)


@query("single_shot_match", check_sql(BEST + """
SELECT p.capture_id, CASE WHEN p.has_payload AND b.sim>=0.35 THEN b.ge ELSE 'unknown' END AS entity_id,
  CASE WHEN p.has_payload THEN round(coalesce(b.sim,0),4) ELSE 0 END AS similarity,
  CASE WHEN NOT p.has_payload THEN 'no_landmarks' WHEN b.sim>=0.35 THEN 'recognized' WHEN b.sim IS NOT NULL THEN 'low_confidence'
    ELSE 'unknown' END AS status
FROM probes p LEFT JOIN best b ON p.capture_id=b.pid""", "probes", "gallery"))
def single_shot_match(spark, sf):
    faces = views.probes(spark, sf).withColumn(
        "landmarks", F.when(F.col("has_payload"), F.array_repeat(F.lit(0.0), 5)).otherwise(F.array())
    )
    return match.single_shot(faces, views.gallery(spark, sf), "capture_id", "capture_id", "landmarks", MATCH)


@query("entity_similarity", check_sql(PAIRS + """
, m AS (SELECT pid, ge, max(sim) AS sim, arg_max(gid,sim) AS gid FROM pairs GROUP BY 1,2)
SELECT pid AS capture_id, gid AS match_id, ge AS match_label, round(sim,6) AS similarity, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gid) AS rn FROM m WHERE sim>=0.1) WHERE rn<=3""",
    "probes", "gallery"))
def entity_similarity(spark, sf):
    hits = match.entity_similarities(
        views.probes(spark, sf), views.gallery(spark, sf), "capture_id", "capture_id", 3, 0.1, block_rows=100
    )
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("duplicate_assess", check_sql(PAIRS + """
, b AS (SELECT pe, arg_max(ge,sim) AS ge, max(sim) AS sim FROM pairs WHERE ge<>pe AND sim>=0.30 GROUP BY pe)
SELECT e.entity_id, CASE WHEN sim>=0.40 THEN 'hard' WHEN sim>=0.30 THEN 'soft' ELSE 'none' END AS level,
  ge AS matched_entity, round(coalesce(sim,0),4) AS similarity
FROM (SELECT DISTINCT entity_id FROM probes) e LEFT JOIN b ON e.entity_id=b.pe""", "probes", "gallery"))
def duplicate_assess(spark, sf):
    return match.assess_duplicates(views.probes(spark, sf), views.gallery(spark, sf), "capture_id", "capture_id", p=DUP)


@query("duplicate_check", check_sql(PAIRS + """
, t AS (SELECT pid, pe, arg_max(ge,sim) AS ge, max(sim) AS sim FROM pairs WHERE ge<>pe AND sim>=0.40 GROUP BY 1,2)
SELECT pe AS entity_id, min(pid) AS capture_id, arg_min(ge,pid) AS matched_entity, round(arg_min(sim,pid),6) AS similarity
FROM t GROUP BY 1""", "probes", "gallery"))
def duplicate_check(spark, sf):
    found = match.check_duplicates(
        views.probes(spark, sf), views.gallery(spark, sf), "capture_id", "capture_id", threshold=0.40
    )
    return found.withColumn("similarity", F.round("similarity", 6))


@query("gallery_near_dups", check_sql("""
, m AS (SELECT a.capture_id, max(list_cosine_similarity(a.embedding,b.embedding)) AS sim FROM gallery a
  JOIN gallery b ON a.entity_id=b.entity_id AND a.capture_id<>b.capture_id GROUP BY 1)
SELECT g.capture_id, round(coalesce(sim,0),6) AS max_similarity, coalesce(sim,0)>=0.25 AS is_duplicate
FROM gallery g LEFT JOIN m USING (capture_id)""", "gallery"))
def gallery_near_dups(spark, sf):
    g = views.gallery(spark, sf)
    found = match.near_duplicates(g, g, "capture_id", "capture_id", "entity_id", DUP.near, exclude_id=True)
    return found.withColumn("max_similarity", F.round("max_similarity", 6))


CENTROID = """
, dims AS (SELECT entity_id, d AS pos, avg(embedding[d]) AS m FROM gallery, range(1,65) r(d) WHERE is_active GROUP BY 1,2),
cent AS (SELECT entity_id, list(m ORDER BY pos) AS v, sqrt(sum(m*m))+1e-8 AS n FROM dims GROUP BY 1)
"""


@query("entity_centroid", check_sql(CENTROID + """
SELECT entity_id, CAST(pos-1 AS INTEGER) AS pos, round(m/n,6) AS value FROM dims JOIN cent USING (entity_id)""", "gallery"))
def entity_centroid(spark, sf):
    g = views.gallery(spark, sf).where("is_active")
    cent = match.centroids(g, "entity_id", ["capture_id"])
    return cent.select("entity_id", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("centroid_match", check_sql(CENTROID + """
, s AS (SELECT capture_id, c.entity_id, list_cosine_similarity(p.embedding,c.v) AS sim FROM probes p CROSS JOIN cent c),
b AS (SELECT capture_id, arg_max(entity_id,sim) AS entity_id, max(sim) AS sim FROM s WHERE sim>=0.1 GROUP BY 1)
SELECT p.capture_id, CASE WHEN b.sim>=0.20 THEN b.entity_id ELSE 'unknown' END AS entity_id, round(coalesce(b.sim,0),4) AS similarity
FROM probes p LEFT JOIN b USING (capture_id)""", "gallery", "probes"))
def centroid_match(spark, sf):
    g = views.gallery(spark, sf).where("is_active")
    cent = match.centroids(g, "entity_id", ["capture_id"])
    p = MatchParams(accept=0.20, floor=0.1)
    return match.match_entities(
        views.probes(spark, sf), cent, "capture_id", "entity_id", p, gallery_vec="centroid"
    )


# The greedy walk in SQL: one step per rank, the kept vectors carried along.
DEDUP = """
, ranked AS (SELECT entity_id, capture_id, embedding, row_number() OVER (PARTITION BY entity_id ORDER BY {order}) AS rn
  FROM captures {where}),
walk AS (SELECT entity_id, capture_id, rn, true AS keep, [embedding] AS kept FROM ranked WHERE rn=1
  UNION ALL SELECT entity_id, capture_id, rn, keep, CASE WHEN keep THEN list_append(kept, embedding) ELSE kept END FROM (
    SELECT r.entity_id, r.capture_id, r.rn, r.embedding, w.kept,
      len(list_filter(w.kept, lambda x: list_cosine_similarity(x, r.embedding) >= 0.25)) = 0 AS keep
    FROM walk w JOIN ranked r ON r.entity_id=w.entity_id AND r.rn=w.rn+1))
"""


@query("capture_dedup", check_sql(DEDUP.format(order="quality DESC, capture_id", where="") + """
SELECT entity_id, capture_id FROM walk WHERE keep""", "captures", recursive=True))
def capture_dedup(spark, sf):
    kept = deduplicate(views.captures(spark, sf), ["entity_id"], "capture_id", threshold=0.25)
    return kept.select("entity_id", "capture_id")


@query("capture_buffer", check_sql(DEDUP.format(order="capture_id", where="WHERE quality>=0.2") + """
SELECT entity_id, capture_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY rn) AS k FROM walk WHERE keep)
WHERE k<=10""", "captures", recursive=True))
def capture_buffer(spark, sf):
    rows = views.captures(spark, sf).where("quality >= 0.2")
    kept = fill_buffer(rows, ["entity_id"], "second", "capture_id", threshold=0.25, capacity=10)
    return kept.select("entity_id", "capture_id")


POSE = """CASE WHEN yaw < -0.40 THEN 'LEFT_60' WHEN yaw > 0.40 THEN 'RIGHT_60' WHEN yaw < -0.15 THEN 'LEFT_30'
  WHEN yaw > 0.15 THEN 'RIGHT_30' WHEN pitch > 0.18 THEN 'UP' WHEN pitch < -0.18 THEN 'DOWN' ELSE 'FRONTAL' END"""
ENROL_POSE = """CASE WHEN yaw <= -0.35 THEN 'LEFT_PROFILE' WHEN yaw >= 0.35 THEN 'RIGHT_PROFILE'
  WHEN yaw <= -0.12 THEN 'SLIGHT_LEFT' WHEN yaw >= 0.12 THEN 'SLIGHT_RIGHT'
  WHEN pitch > 0.18 THEN 'UP' WHEN pitch < -0.18 THEN 'DOWN' ELSE 'FRONTAL' END"""
SESSION_POSE = """CASE WHEN yaw <= -0.12 THEN 'SLIGHT_LEFT' WHEN yaw >= 0.12 THEN 'SLIGHT_RIGHT' ELSE 'FRONTAL' END"""


def pose():
    return fq.pose_bin(F.col("yaw"), F.col("pitch"))


def enrol_pose():
    return fq.enrol_pose_bin(F.col("yaw"), F.col("pitch"))


@query("pose_bins", check_sql(f"""
SELECT capture_id, {POSE} AS pose_bin, {ENROL_POSE} AS enrol_pose, {SESSION_POSE} AS session_pose FROM captures""", "captures"))
def pose_bins(spark, sf):
    return views.captures(spark, sf).select(
        "capture_id", pose().alias("pose_bin"), enrol_pose().alias("enrol_pose"),
        fq.session_pose(enrol_pose()).alias("session_pose"),
    )


LIGHT = "CASE WHEN brightness<40 THEN (40-brightness)/40.0 WHEN brightness>220 THEN (brightness-220)/35.0 ELSE 0 END"


@query("quality_score_a", check_sql(f"""
SELECT capture_id, round(greatest(0,least(1,(1-0.4*abs(yaw)-0.2*abs(pitch)-0.2*({LIGHT}))*(0.8+0.2*least(blur/100,1)))),8) AS score,
  NOT (brightness<30 OR brightness>240) AS passed FROM captures""", "captures"))
def quality_score_a(spark, sf):
    score = fq.capture_score(F.col("yaw"), F.col("pitch"), F.col("blur"), F.col("brightness"), digits=8)
    return views.captures(spark, sf).select(
        "capture_id", score.alias("score"), fq.capture_passes(F.lit(True), F.col("brightness")).alias("passed")
    )


@query("diverse_captures", check_sql(f"""
, b AS (SELECT entity_id, pose_bin, capture_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, pose_bin
  ORDER BY quality DESC, capture_id) AS rn FROM (SELECT *, {POSE} AS pose_bin FROM captures)) WHERE rn=1)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY quality DESC, capture_id) AS position FROM b)
WHERE position<=6""", "captures"))
def diverse_captures(spark, sf):
    rows = views.captures(spark, sf).withColumn("pose_bin", pose()).select("entity_id", "pose_bin", "capture_id", "quality")
    return registry.diverse_captures(rows, "entity_id", "pose_bin", "quality", "capture_id", 6)


@query("best_capture", check_sql("""
SELECT entity_id, capture_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY entity_id
  ORDER BY quality DESC, capture_id) AS rn FROM captures) WHERE rn=1""", "captures"))
def best_capture(spark, sf):
    rows = views.captures(spark, sf).select("entity_id", "capture_id", "quality")
    return registry.best_capture(rows, "entity_id", "quality", "capture_id")


@query("pose_replacement", check_sql(f"""
, a AS (SELECT *, {POSE} AS pose_bin FROM captures),
b AS (SELECT capture_id, entity_id, quality, row_number() OVER (PARTITION BY entity_id, pose_bin ORDER BY quality DESC, capture_id) AS rn FROM a),
c AS (SELECT capture_id, row_number() OVER (PARTITION BY entity_id ORDER BY quality DESC, capture_id) AS k FROM b WHERE rn=1)
SELECT a.capture_id, a.pose_bin, coalesce(c.k<=8,false) AS is_active FROM a LEFT JOIN c USING (capture_id)""", "captures"))
def pose_replacement(spark, sf):
    rows = views.captures(spark, sf).withColumn("pose_bin", pose()).select(
        "entity_id", "pose_bin", "capture_id", "quality", "is_active", "is_probe"
    )
    merged = registry.replace_in_bin(
        rows.where("NOT is_probe"), rows.where("is_probe"), "entity_id", "pose_bin", "quality", "capture_id", 8
    )
    return merged.select("capture_id", "pose_bin", "is_active")


# ---------------------------------------------------------------------- enrolment

ENROL = EnrolParams(duplicate_similarity=0.35, capture_interval=3.0)


def session_captures(spark, sf):
    return views.captures(spark, sf).withColumn("ts", F.timestamp_micros((F.col("second") * 1_000_000).cast("long")))


def sampled(spark, sf):
    return accept_samples(
        session_captures(spark, sf), ["entity_id"], "ts", "capture_id",
        F.col("quality") >= 0.2, fq.session_pose(enrol_pose()), p=ENROL,
    )


# Acceptance in SQL: one capture per step, the accepted vectors and poses carried along.
ACCEPT = f"""
, ranked AS (SELECT entity_id, capture_id, second, embedding, {SESSION_POSE} AS pose,
  row_number() OVER (PARTITION BY entity_id ORDER BY second, capture_id) AS rn FROM captures WHERE quality>=0.2),
walk AS (SELECT entity_id, capture_id, pose, rn, true AS keep, [embedding] AS kept, [pose] AS poses, second AS last
  FROM ranked WHERE rn=1
  UNION ALL SELECT entity_id, capture_id, pose, rn, keep, CASE WHEN keep THEN list_append(kept, embedding) ELSE kept END,
    CASE WHEN keep THEN list_append(poses, pose) ELSE poses END, CASE WHEN keep THEN second ELSE last END FROM (
    SELECT r.entity_id, r.capture_id, r.rn, r.embedding, r.pose, r.second, w.kept, w.poses, w.last,
      len(w.kept)<8 AND r.second-w.last>=2.9999 AND (len(w.kept)<6 OR NOT list_contains(w.poses, r.pose))
      AND len(list_filter(w.kept, lambda x: list_cosine_similarity(x, r.embedding) >= 0.35)) = 0 AS keep
    FROM walk w JOIN ranked r ON r.entity_id=w.entity_id AND r.rn=w.rn+1)),
accepted AS (SELECT entity_id, capture_id, pose, row_number() OVER (PARTITION BY entity_id ORDER BY rn) AS sample_no
  FROM walk WHERE keep)
"""


@query("sample_acceptance", check_sql(ACCEPT + "SELECT * FROM accepted", "captures", recursive=True))
def sample_acceptance(spark, sf):
    return sampled(spark, sf).select("entity_id", "capture_id", "pose", "sample_no")


@query("pose_coverage", check_sql(ACCEPT + """
, c AS (SELECT entity_id, count(*) AS samples, bool_or(pose='FRONTAL') AS has_frontal,
  bool_or(pose='SLIGHT_LEFT') AS has_slight_left, bool_or(pose='SLIGHT_RIGHT') AS has_slight_right FROM accepted GROUP BY 1)
SELECT *, (samples>=5 AND has_frontal AND (has_slight_left OR has_slight_right)) OR samples>=6 AS ready,
  CAST(floor(least(1.0,samples/6.0)*100) AS INTEGER) AS progress_percent,
  CASE WHEN NOT has_frontal THEN 'FRONTAL' WHEN NOT has_slight_left THEN 'SLIGHT_LEFT'
    WHEN NOT has_slight_right THEN 'SLIGHT_RIGHT' END AS next_pose FROM c""", "captures", recursive=True))
def session_pose_coverage(spark, sf):
    return pose_coverage(sampled(spark, sf), ["entity_id"], "pose", ENROL)


@query("next_pose", check_sql(f"""
, seen AS (SELECT entity_id, list(DISTINCT {ENROL_POSE}) AS s FROM captures GROUP BY 1),
n AS (SELECT entity_id, list_filter(['FRONTAL','SLIGHT_LEFT','SLIGHT_RIGHT','LEFT_PROFILE','RIGHT_PROFILE','UP','DOWN'],
  lambda p: NOT list_contains(s, p))[1] AS next_pose FROM seen)
SELECT entity_id, next_pose, CASE next_pose WHEN 'FRONTAL' THEN 'Look straight toward the camera'
  WHEN 'SLIGHT_LEFT' THEN 'Turn slightly left' WHEN 'SLIGHT_RIGHT' THEN 'Turn slightly right'
  WHEN 'LEFT_PROFILE' THEN 'Turn head further to the left' WHEN 'RIGHT_PROFILE' THEN 'Turn head further to the right'
  WHEN 'UP' THEN 'Tilt head slightly upward' WHEN 'DOWN' THEN 'Tilt head slightly downward'
  ELSE 'Great. All key poses captured.' END AS guidance FROM n""", "captures"))
def next_pose(spark, sf):
    rows = views.captures(spark, sf).select("entity_id", enrol_pose().alias("pose"))
    seen = rows.groupBy("entity_id").agg(F.collect_set("pose").alias("poses"))
    asked = seen.withColumn("next_pose", fx.next_missing(POSES_ALL, F.col("poses")))
    return asked.select("entity_id", "next_pose", fx.guidance(F.col("next_pose")).alias("guidance"))


@query("session_commit", check_sql("""
, pairs AS (SELECT p.entity_id AS pe, list_cosine_similarity(p.embedding, g.embedding) AS sim
  FROM probes p JOIN gallery g ON p.entity_id<>g.entity_id),
bad AS (SELECT DISTINCT pe FROM pairs WHERE sim>=0.42),
enough AS (SELECT entity_id FROM probes GROUP BY 1 HAVING count(*)>=5)
SELECT entity_id, capture_id FROM probes WHERE entity_id IN (SELECT entity_id FROM enough)
  AND entity_id NOT IN (SELECT pe FROM bad)""", "probes", "gallery"))
def session_commit(spark, sf):
    rows = committable(views.probes(spark, sf), views.gallery(spark, sf), "entity_id", "capture_id", "capture_id", 0.42)
    return rows.select("entity_id", "capture_id")


ENRICH = EnrichParams(match=0.3, quality=0.3, duplicate=0.33, max_active=38)


ENRICHED = BEST + """
, m AS (SELECT p.capture_id, b.ge AS entity_id, round(b.sim,4) AS similarity, p.second, p.embedding
  FROM best b JOIN probes p ON p.capture_id=b.pid WHERE b.sim>=0.30 AND p.quality>=0.3),
fresh AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY second, capture_id) AS rn FROM m WHERE NOT EXISTS (
  SELECT 1 FROM gallery g WHERE g.entity_id=m.entity_id AND list_cosine_similarity(m.embedding,g.embedding)>=0.33)),
walk AS (SELECT entity_id, capture_id, similarity, rn, true AS keep, [embedding] AS kept FROM fresh WHERE rn=1
  UNION ALL SELECT entity_id, capture_id, similarity, rn, keep, CASE WHEN keep THEN list_append(kept, embedding) ELSE kept END FROM (
    SELECT r.*, w.kept, len(list_filter(w.kept, lambda x: list_cosine_similarity(x, r.embedding) >= 0.33)) = 0 AS keep
    FROM walk w JOIN fresh r ON r.entity_id=w.entity_id AND r.rn=w.rn+1)),
added AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY rn) AS version_step FROM walk WHERE keep),
act AS (SELECT entity_id, count(*) FILTER (is_active) AS n FROM gallery GROUP BY 1),
taken AS (SELECT entity_id, capture_id, similarity, version_step FROM added LEFT JOIN act USING (entity_id)
  WHERE version_step <= 38 - coalesce(n,0))
"""


def enriched(spark, sf):
    g = views.gallery(spark, sf)
    hits = match.match_with_status(views.probes(spark, sf), g, "capture_id", "capture_id", MATCH)
    probes = views.probes(spark, sf).withColumn("pose_bin", pose()).select("capture_id", "quality", "second", "pose_bin", "embedding")
    rows = hits.where("status <> 'UNKNOWN'").join(probes, "capture_id")
    return enrich_gallery(rows, g, "entity_id", "capture_id", "capture_id", "second", F.col("is_active"), ENRICH)


@query("enrich_gallery", check_sql(ENRICHED + "SELECT * FROM taken", "probes", "gallery", recursive=True))
def enrich(spark, sf):
    return enriched(spark, sf).select("entity_id", "capture_id", "similarity", "version_step")


def enrich_tables(spark, sf):
    people = views.entities(spark, sf).select("entity_id", "name", F.lit(1).alias("gallery_version"))
    g = dense_ids(views.gallery(spark, sf), "capture_id", "gallery_id").select("entity_id", "capture_id", "embedding", "gallery_id", "is_active")
    return commit_enrichment(enriched(spark, sf), people, g, "capture_id", "gallery_id")


@query("enrich_commit", check_sql(ENRICHED + f"""
SELECT capture_id, entity_id, (SELECT count(*) FROM gallery)-1+row_number() OVER (ORDER BY capture_id) AS gallery_id,
  CAST(1+version_step AS INTEGER) AS gallery_version, true AS is_active FROM taken""", "probes", "gallery", recursive=True))
def enrich_commit(spark, sf):
    new = enrich_tables(spark, sf)["gallery"].where("gallery_version IS NOT NULL")
    return new.select("capture_id", "entity_id", "gallery_id", "gallery_version", "is_active")


@query("enrich_audit", check_sql(ENRICHED + f"""
, p AS (SELECT capture_id, {POSE} AS pose_bin FROM probes)
SELECT 'PROGRESSIVE_LEARNING_ADD' AS action, t.entity_id, concat('Added new ',p.pose_bin,' capture to ',e.name,
  chr(39),'s profile (version ',1+t.version_step,').') AS details FROM taken t JOIN p USING (capture_id) JOIN entities e ON e.entity_id=t.entity_id
UNION ALL SELECT 'VERSION', e.entity_id, CAST(1+coalesce(max(t.version_step),0) AS VARCHAR) FROM entities e LEFT JOIN taken t
  ON t.entity_id=e.entity_id GROUP BY e.entity_id""", "probes", "gallery", "entities", recursive=True))
def enrich_audit(spark, sf):
    """Audit rows, and the version that each entity has afterwards."""
    made = enrich_tables(spark, sf)
    versions = made["entities"].select(F.lit("VERSION").alias("action"), "entity_id", F.col("gallery_version").cast("string").alias("details"))
    return made["audit"].unionByName(versions)


@query("bounded_centroid", check_sql("""
, r AS (SELECT entity_id, embedding, row_number() OVER (PARTITION BY entity_id ORDER BY capture_id) AS rn FROM captures WHERE quality>=0.60),
d AS (SELECT entity_id, d AS pos, avg(embedding[d]) AS m FROM r, range(1,65) x(d) WHERE rn<=5 GROUP BY 1,2),
c AS (SELECT entity_id, sqrt(sum(m*m))+1e-8 AS n FROM d GROUP BY 1)
SELECT entity_id, CAST(pos-1 AS INTEGER) AS pos, round(m/n,6) AS value FROM d JOIN c USING (entity_id)""", "captures"))
def bounded_centroid(spark, sf):
    """Of each entity's references that pass the gate (here by quality), the first five."""
    cent = match.centroids(views.captures(spark, sf), "entity_id", ["capture_id"], limit=5, similarity="quality", least=0.60)
    return cent.select("entity_id", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 6))


# ----------------------------------------------------------------------- registry


@query("gallery_counts", check_sql("""
SELECT e.entity_id, e.name, count(g.capture_id) AS vectors FROM entities e LEFT JOIN gallery g ON e.entity_id=g.entity_id
GROUP BY 1,2""", "entities", "gallery"))
def gallery_counts(spark, sf):
    return registry.gallery_counts(views.entities(spark, sf), views.gallery(spark, sf)).select("entity_id", "name", "vectors")


@query("entity_images", check_sql("""
SELECT e.entity_id, g.capture_id, concat('/faces/',e.entity_id,'/v',g.capture_id,'.jpg') AS image_url
FROM entities e JOIN gallery g ON e.entity_id=g.entity_id
UNION ALL SELECT entity_id, -1, NULL FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM gallery)""",
    "entities", "gallery"))
def entity_images(spark, sf):
    rows = registry.entity_images(views.entities(spark, sf), views.gallery(spark, sf), "capture_id")
    return rows.select("entity_id", F.coalesce("capture_id", F.lit(-1)).alias("capture_id"), "image_url")


@query("capture_detail", check_sql(f"""
SELECT capture_id, CASE WHEN quality=0 THEN 0.85 ELSE quality END AS quality_score, {POSE} AS pose_bin, is_active,
  CASE WHEN is_active THEN 'active' ELSE 'archived' END AS part FROM captures""", "captures"))
def capture_detail(spark, sf):
    rows = views.captures(spark, sf).select(
        "capture_id", F.col("quality").alias("quality_score"), pose().alias("pose_bin"),
        F.lit(None).cast("int").alias("gallery_version"), "is_active",
    )
    active, archived = registry.split_active(rows)
    both = active.withColumn("part", F.lit("active")).unionByName(archived.withColumn("part", F.lit("archived")))
    return registry.detail_view(both).select("capture_id", "quality_score", "pose_bin", "is_active", "part")


@query("gallery_inventory", check_sql("""
SELECT (SELECT count(*) FROM entities) AS total_entities, count(*) AS total_vectors, CAST(max(len(embedding)) AS INTEGER) AS dimension,
  count(DISTINCT entity_id) AS entities_with_vectors FROM gallery""", "entities", "gallery"))
def gallery_inventory(spark, sf):
    return registry.inventory(views.entities(spark, sf), views.gallery(spark, sf))


def payloads(spark, sf):
    return views.captures(spark, sf).where("has_payload").select("image_path")


@query("gallery_inventory_sample", check_sql("""
SELECT capture_id, entity_id, image_path, has_payload AS exists_on_disk FROM gallery ORDER BY capture_id LIMIT 10""", "gallery"))
def gallery_inventory_sample(spark, sf):
    return registry.inventory_sample(views.gallery(spark, sf), payloads(spark, sf), "capture_id")


@query("orphan_vectors", check_sql("SELECT capture_id, entity_id FROM gallery WHERE NOT has_payload", "gallery"))
def orphan_vectors(spark, sf):
    return registry.orphan_vectors(views.gallery(spark, sf), payloads(spark, sf)).select("capture_id", "entity_id")


@query("entities_without_vectors", check_sql("""
SELECT entity_id, name FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM gallery)""", "entities", "gallery"))
def entities_without_vectors(spark, sf):
    return registry.entities_without_vectors(views.entities(spark, sf), views.gallery(spark, sf)).select("entity_id", "name")


@query("gallery_rebuild", check_sql("""
SELECT row_number() OVER (ORDER BY capture_id)-1 AS gallery_id, capture_id, coalesce(e.name,'Unknown') AS name,
  round(embedding[1]/sqrt(list_inner_product(embedding,embedding)),6) AS first_value
FROM gallery g LEFT JOIN entities e ON g.entity_id=e.entity_id WHERE has_payload""", "gallery", "entities"))
def gallery_rebuild(spark, sf):
    rows = registry.rebuild_gallery(views.gallery(spark, sf), views.entities(spark, sf), payloads(spark, sf), "capture_id")
    return rows.select("gallery_id", "capture_id", "name", F.round(F.col("embedding")[0], 6).alias("first_value"))


@query("gallery_append", check_sql("""
, g AS (SELECT capture_id, row_number() OVER (ORDER BY capture_id)-1 AS gallery_id FROM gallery)
SELECT * FROM g UNION ALL SELECT capture_id, (SELECT max(gallery_id) FROM g)+row_number() OVER (ORDER BY capture_id) FROM probes""",
    "gallery", "probes"))
def gallery_append(spark, sf):
    g = registry.dense_ids(views.gallery(spark, sf), "capture_id", "gallery_id")
    return registry.append_gallery(g, views.probes(spark, sf), "capture_id").select("capture_id", "gallery_id")


@query("gallery_remove_entity", check_sql("""
SELECT capture_id, entity_id, row_number() OVER (ORDER BY capture_id)-1 AS gallery_id FROM gallery
WHERE entity_id NOT IN (SELECT entity_id FROM entities WHERE role='Visitor')""", "gallery", "entities"))
def gallery_remove_entity(spark, sf):
    gone = views.entities(spark, sf).where("role = 'Visitor'")
    rows = registry.remove_entities_from_gallery(views.gallery(spark, sf), gone, "capture_id")
    return rows.select("capture_id", "entity_id", "gallery_id")


@query("gallery_rename", check_sql("""
SELECT capture_id, coalesce(e.name,'Unknown') AS name FROM gallery g LEFT JOIN entities e ON g.entity_id=e.entity_id""",
    "gallery", "entities"))
def gallery_rename(spark, sf):
    named = views.gallery(spark, sf).select("capture_id", "entity_id").withColumn("name", F.lit("Unknown"))
    return registry.rename_in_gallery(named, views.entities(spark, sf)).select("capture_id", "name")


@query("cascade_delete", check_sql("""
, gone AS (SELECT entity_id FROM entities WHERE role='Blacklist')
SELECT 'sightings' AS part, count(*) AS rows, CAST(sum(id) AS BIGINT) AS checksum FROM sightings
  WHERE entity_id IS NULL OR entity_id NOT IN (SELECT entity_id FROM gone)
UNION ALL SELECT 'entities', count(*), CAST(sum(id) AS BIGINT) FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM gone)
UNION ALL SELECT 'gallery', count(*), CAST(sum(capture_id) AS BIGINT) FROM gallery WHERE entity_id NOT IN (SELECT entity_id FROM gone)
UNION ALL SELECT 'audit', count(*), CAST(count(DISTINCT entity_id) AS BIGINT) FROM gone""", "sightings", "entities", "gallery"))
def cascade_delete(spark, sf):
    people = views.entities(spark, sf)
    out = registry.cascade_delete(
        people.where("role = 'Blacklist'"), sightings=views.sightings(spark, sf), entities=people,
        gallery=views.gallery(spark, sf),
    )
    sums = {
        "sightings": F.sum("id"), "entities": F.sum("id"), "gallery": F.sum("capture_id"),
        "audit": F.count_distinct("entity_id"),
    }
    parts = [
        out[name].agg(F.count(F.lit(1)).alias("rows"), total.alias("checksum")).select(F.lit(name).alias("part"), "rows", "checksum")
        for name, total in sums.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


VERSIONED = "CASE WHEN id%10=0 THEN NULL ELSE CAST(id%4+1 AS INT) END"


@query("entity_upsert", check_sql(f"""
, old AS (SELECT entity_id, name, department, {VERSIONED} AS gallery_version, id, role,
  role IN ('Employee','Contractor') AS hit FROM entities)
SELECT entity_id, CASE WHEN hit THEN upper(name) ELSE name END AS name,
  CASE WHEN hit THEN 'UPDATED' ELSE department END AS department,
  CAST(CASE WHEN hit THEN coalesce(gallery_version,1)+1 ELSE coalesce(gallery_version,0) END AS INTEGER) AS gallery_version FROM old
UNION ALL SELECT concat('N_',id), upper(name), 'UPDATED', 1 FROM old WHERE role='VIP'""", "entities"))
def entity_upsert(spark, sf):
    people = views.entities(spark, sf)
    old = people.selectExpr("entity_id", "name", "department", f"{VERSIONED} AS gallery_version")
    known = people.where("role IN ('Employee', 'Contractor')").selectExpr("entity_id", "upper(name) AS name", "'UPDATED' AS department")
    new = people.where("role = 'VIP'").selectExpr("concat('N_', id) AS entity_id", "upper(name) AS name", "'UPDATED' AS department")
    rows = registry.upsert_entities(old, known.unionByName(new))
    return rows.withColumn("gallery_version", F.coalesce("gallery_version", F.lit(0)))


# Which kind of patch a department's people get.
PATCH_KIND = """CASE department WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
  WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END"""


@query("entity_patch", check_sql(f"""
, r AS (SELECT *, {PATCH_KIND} AS m FROM entities)
SELECT entity_id,
  CASE m WHEN 0 THEN concat('Ann ',id) WHEN 1 THEN concat('Only',id) WHEN 2 THEN 'Mia Lou Ray' ELSE name END AS name,
  CASE m WHEN 0 THEN 'Ann' WHEN 1 THEN concat('Only',id) WHEN 2 THEN 'Mia' WHEN 3 THEN split_part(name,' ',1) END AS first_name,
  CASE m WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN 'old' WHEN 2 THEN 'Lou Ray' WHEN 3 THEN '' ELSE 'old' END AS last_name,
  CASE m WHEN 0 THEN 'NEW' WHEN 1 THEN NULL ELSE department END AS department, role
FROM r""", "entities"))
def entity_patch(spark, sf):
    people = views.entities(spark, sf)
    old = people.select(
        "entity_id", "name", F.lit(None).cast("string").alias("first_name"), F.lit("old").alias("last_name"),
        "department", "role",
    )
    patches = people.selectExpr("*", f"{PATCH_KIND} AS m").where("m < 4").selectExpr(
        "entity_id",
        "CASE m WHEN 0 THEN ' Ann ' END AS first_name",
        "CASE m WHEN 0 THEN CAST(id AS STRING) WHEN 3 THEN '' END AS last_name",
        "CASE m WHEN 1 THEN concat('Only', id) WHEN 2 THEN 'Mia Lou Ray' END AS name",
        "CASE m WHEN 0 THEN 'NEW' WHEN 1 THEN '' END AS department",
        "CAST(NULL AS STRING) AS role",
    )
    return registry.patch_entities(old, patches)


@query("schema_conform", check_sql("""
SELECT entity_id, id, name, department, role, CAST(NULL AS VARCHAR) AS phone, CAST(1 AS INTEGER) AS gallery_version FROM entities""",
    "entities"))
def schema_conform(spark, sf):
    names = ("id", "entity_id", "name", "department", "role", "phone", "gallery_version")
    wanted = T.StructType([f for f in schemas.struct("entities") if f.name in names])
    return registry.conform_schema(views.entities(spark, sf), wanted, {"gallery_version": 1})


@query("replace_entity", check_sql("""
, gone AS (SELECT DISTINCT entity_id FROM probes WHERE quality>=0.95)
SELECT capture_id, entity_id, 'old' AS origin FROM gallery WHERE entity_id NOT IN (SELECT entity_id FROM gone)
UNION ALL SELECT capture_id, entity_id, 'new' FROM probes WHERE quality>=0.95""", "gallery", "probes"))
def replace_entity(spark, sf):
    old = views.gallery(spark, sf).select("capture_id", "entity_id").withColumn("origin", F.lit("old"))
    new = views.probes(spark, sf).where("quality >= 0.95").select("capture_id", "entity_id").withColumn("origin", F.lit("new"))
    out = registry.replace_entities(
        {"gallery": old}, {"entities": new.select("entity_id").distinct(), "gallery": new}
    )
    return out["gallery"]


@query("archive_previous", check_sql("""
, again AS (SELECT DISTINCT entity_id FROM probes WHERE quality>=0.95)
SELECT capture_id, is_active AND entity_id NOT IN (SELECT entity_id FROM again) AS is_active FROM gallery""", "gallery", "probes"))
def archive_previous(spark, sf):
    g = views.gallery(spark, sf).withColumn("archived_at", F.lit(None).cast("timestamp"))
    again = views.probes(spark, sf).where("quality >= 0.95")
    return registry.archive_previous(g, again, F.to_timestamp(F.lit(views.AS_OF))).select("capture_id", "is_active")


@query("source_snapshot", check_sql("""
SELECT source_id, CASE WHEN status='OFFLINE' THEN 'moved' ELSE location END AS location FROM sources WHERE enabled""", "sources"))
def source_snapshot(spark, sf):
    rows = views.sources(spark, sf)
    changes = rows.where("status = 'OFFLINE'").withColumn("location", F.lit("moved"))
    updated = registry.upsert_source(rows, changes)
    return registry.delete_source(updated, rows.where("NOT enabled")).select("source_id", "location")
