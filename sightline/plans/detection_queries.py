"""Queries over detections: geometry, quality, linking, tracks, consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import geometry as geo
from sightline.functions import quality as fq
from sightline.functions import text as fx
from sightline.operators import overlap, tracks
from sightline.operators.enrolment import solo_frames
from sightline.operators.greedy import suppress_boxes
from sightline.operators.match import consensus
from sightline.params import NMS_IOU, EnrolParams, QualityParams, TrackParams
from sightline.plans.catalog import query
from sightline.sources import views
from sightline.sources.views import check_sql

FRAME_W, FRAME_H = 320.0, 240.0


def iou_sql(a: str, b: str) -> str:
    """IoU of two boxes given as prefixes of x1..y2."""
    inter = (
        f"greatest(0,least({a}x2,{b}x2)-greatest({a}x1,{b}x1))*greatest(0,least({a}y2,{b}y2)-greatest({a}y1,{b}y1))"
    )
    size = "({0}x2-{0}x1)*({0}y2-{0}y1)"
    return f"(({inter})/({size.format(a)}+{size.format(b)}-({inter})))"


@query("box_iou_pairs", check_sql(f"""
, p AS (SELECT a.source_id, a.frame_id, {iou_sql('a.', 'b.')} AS iou, a.det_key AS left_det_key, b.det_key AS right_det_key
  FROM detections a JOIN detections b ON a.source_id=b.source_id AND a.frame_id=b.frame_id AND a.det_key<b.det_key)
SELECT source_id, frame_id, round(iou,6) AS iou, left_det_key, right_det_key FROM p WHERE iou>=0.4""", "detections"))
def box_iou_pairs(spark, sf):
    pairs = overlap.iou_pairs(views.detections(spark, sf), ["source_id", "frame_id"], "det_key", NMS_IOU)
    return pairs.withColumn("iou", F.round("iou", 6))


def nms_sql(rank: str) -> str:
    return check_sql(f"""
, ranked AS (SELECT source_id, frame_id, det_key, x1, y1, x2, y2,
  row_number() OVER (PARTITION BY source_id, frame_id ORDER BY {rank} DESC, det_key) AS rn FROM detections),
walk AS (SELECT source_id, frame_id, det_key, rn, true AS keep, [{{'x1':x1,'y1':y1,'x2':x2,'y2':y2}}] AS kept FROM ranked WHERE rn=1
  UNION ALL SELECT source_id, frame_id, det_key, rn, keep,
    CASE WHEN keep THEN list_append(kept, {{'x1':x1,'y1':y1,'x2':x2,'y2':y2}}) ELSE kept END FROM (
    SELECT r.*, w.kept, len(list_filter(w.kept, lambda k: {iou_sql('k.', 'r.')} >= 0.4)) = 0 AS keep
    FROM walk w JOIN ranked r ON r.source_id=w.source_id AND r.frame_id=w.frame_id AND r.rn=w.rn+1))
SELECT source_id, frame_id, det_key FROM walk WHERE keep""", "detections", recursive=True)


@query("box_nms", nms_sql("score*2+least(sharpness/80.0,1.0)+(x2-x1)*(y2-y1)/10000.0"))
def box_nms(spark, sf):
    rank = F.col("score") * 2 + F.least(F.col("sharpness") / 80.0, F.lit(1.0)) + geo.area(geo.box()) / 10000.0
    rows = views.detections(spark, sf).select("source_id", "frame_id", "det_key", "x1", "y1", "x2", "y2", "score", "sharpness")
    return suppress_boxes(rows, ["source_id", "frame_id"], rank, "det_key", NMS_IOU).select("source_id", "frame_id", "det_key")


@query("box_nms_overlay", nms_sql("score+least(sharpness/80.0,1.0)"))
def box_nms_overlay(spark, sf):
    rank = F.col("score") + F.least(F.col("sharpness") / 80.0, F.lit(1.0))
    rows = views.detections(spark, sf).select("source_id", "frame_id", "det_key", "x1", "y1", "x2", "y2", "score", "sharpness")
    return suppress_boxes(rows, ["source_id", "frame_id"], rank, "det_key", NMS_IOU).select("source_id", "frame_id", "det_key")


# One candidate pair of a source after the other, best first within each frame, carrying which
# rows are linked: a walk, where the operator works per frame and bucket.
LINKS = f"""
, usable AS (SELECT * FROM detections WHERE score>=0.10),
pairs AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame_id, high DESC, iou DESC, p, n) AS k FROM (
  SELECT b.source_id, b.frame_id, a.det_key AS p, b.det_key AS n, a.score>=0.40 AS starts, b.score>=0.35 AS high,
    {iou_sql('a.', 'b.')} AS iou FROM usable a JOIN usable b ON a.source_id=b.source_id AND b.frame_id=a.frame_id+1)
  WHERE iou>=CASE WHEN high THEN 0.2 ELSE 0.5 END),
steps AS (SELECT DISTINCT source_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS got, CAST([] AS BIGINT[]) AS used,
    CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS n, CAST(0 AS DOUBLE) AS iou, false AS high, false AS ok FROM usable
  UNION ALL
  SELECT source_id, k, CASE WHEN ok THEN list_append(got, n) ELSE got END, CASE WHEN ok THEN list_append(used, p) ELSE used END,
    p, n, iou, high, ok FROM (
    SELECT s.source_id, c.k, list_filter(s.got, lambda x: x//64>=c.frame_id-1) AS got, list_filter(s.used, lambda x: x//64>=c.frame_id-1) AS used,
      c.p, c.n, c.iou, c.high, (c.starts OR list_contains(s.got, c.p)) AND NOT list_contains(s.used, c.p) AND NOT list_contains(s.got, c.n) AS ok
    FROM steps s JOIN pairs c ON c.source_id=s.source_id AND c.k=s.k+1)),
links AS (SELECT p, n, iou, CASE WHEN high THEN 'high' ELSE 'low' END AS band FROM steps WHERE ok)
"""


@query("frame_association", check_sql(LINKS + """
SELECT p AS prev_det_key, n AS next_det_key, round(iou,6) AS iou, band FROM links""", "detections", recursive=True))
def frame_association(spark, sf):
    return overlap.frame_links(views.detections(spark, sf)).withColumn("iou", F.round("iou", 6))


@query("track_stitch", check_sql(LINKS + """
, walk AS (SELECT det_key AS root, det_key, source_id FROM usable WHERE score>=0.40 AND det_key NOT IN (SELECT n FROM links)
  UNION ALL SELECT w.root, l.n, w.source_id FROM walk w JOIN links l ON l.p=w.det_key)
SELECT det_key, concat(source_id,':',root) AS track_id FROM walk""",
    "detections", recursive=True))
def track_stitch(spark, sf):
    return overlap.track_ids(views.detections(spark, sf))


@query("largest_box", check_sql("""
SELECT source_id, frame_id, det_key FROM (SELECT *, row_number() OVER (PARTITION BY source_id, frame_id
  ORDER BY (x2-x1)*(y2-y1) DESC, det_key) AS rn FROM detections) WHERE rn=1""", "detections"))
def largest_box(spark, sf):
    rows = views.detections(spark, sf).select("source_id", "frame_id", "det_key", "x1", "y1", "x2", "y2")
    return overlap.largest_box(rows, ["source_id", "frame_id"], "det_key").select("source_id", "frame_id", "det_key")


# Targets: the largest box of every frame, looked for in the next frame; weak ones count as lost.
@query("target_association", check_sql(f"""
, t AS (SELECT source_id, frame_id+1 AS frame_id, det_key AS target_id, score<0.6 AS lost, x1, y1, x2, y2 FROM (SELECT *,
  row_number() OVER (PARTITION BY source_id, frame_id ORDER BY (x2-x1)*(y2-y1) DESC, det_key) AS rn FROM detections) WHERE rn=1),
s AS (SELECT t.target_id, t.lost, d.det_key, (d.det_key%100)/100.0 AS identity,
  0.7*(d.det_key%100)/100.0 + 0.2*(0.6*{iou_sql('d.', 't.')} + 0.4*greatest(0, 1-4*sqrt(power((d.x1+d.x2)/2-(t.x1+t.x2)/2,2)
    +power((d.y1+d.y2)/2-(t.y1+t.y2)/2,2))/sqrt(640.0*640+480*480))) + 0.1*least(1,d.score) AS association
  FROM t JOIN detections d ON d.source_id=t.source_id AND d.frame_id=t.frame_id
  WHERE d.score>=0.45 AND d.x2-d.x1>=45 AND d.y2-d.y1>=45),
b AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY association DESC, det_key) AS rn FROM s)
SELECT target_id, lost, det_key, identity, round(association,6) AS association FROM b
WHERE rn=1 AND identity >= CASE WHEN lost THEN 0.60 ELSE 0.55 END""", "detections"))
def target_association(spark, sf):
    rows = views.detections(spark, sf)
    targets = overlap.largest_box(rows, ["source_id", "frame_id"], "det_key").selectExpr(
        "source_id", "frame_id + 1 AS frame_id", "det_key AS target_id", "score < 0.6 AS lost", "x1", "y1", "x2", "y2"
    )
    seen = rows.withColumn("identity", (F.col("det_key") % 100) / F.lit(100.0))
    out = overlap.associate_target(targets, seen, ["source_id", "frame_id"], "target_id", "det_key")
    return out.withColumn("association", F.round("association", 6))


@query("annotation_link", check_sql(f"""
, a AS (SELECT source_id, frame_id, det_key AS note_id, CASE WHEN score>=0.7 THEN det_key END AS detection_id,
  x1+9 AS x1, y1+7 AS y1, x2+9 AS x2, y2+7 AS y2 FROM detections),
s AS (SELECT a.source_id, a.frame_id, a.note_id, d.det_key, {iou_sql('a.', 'd.')} AS iou FROM a JOIN detections d
  ON a.source_id=d.source_id AND a.frame_id=d.frame_id WHERE a.detection_id IS NULL)
SELECT source_id, frame_id, note_id, note_id AS det_key, 1.0 AS iou, 'id' AS method FROM a WHERE detection_id IS NOT NULL
UNION ALL SELECT source_id, frame_id, note_id, det_key, round(iou,6), 'iou' FROM (
  SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY iou DESC, det_key) AS rn FROM s WHERE iou>=0.15) WHERE rn=1""",
    "detections"))
def annotation_link(spark, sf):
    rows = views.detections(spark, sf)
    notes = rows.selectExpr(
        "source_id", "frame_id", "det_key AS note_id", "CASE WHEN score >= 0.7 THEN det_key END AS detection_id",
        "x1 + 9 AS x1", "y1 + 7 AS y1", "x2 + 9 AS x2", "y2 + 7 AS y2",
    )
    found = overlap.link_annotations(notes, rows, ["source_id", "frame_id"], "note_id", "det_key", EnrolParams().select_iou)
    return found.withColumn("iou", F.round("iou", 6))


@query("detection_bands", check_sql("""
SELECT det_key, CASE WHEN score>=0.35 THEN 'high' WHEN score>=0.10 THEN 'low' ELSE 'none' END AS band, score>=0.40 AS may_start,
  round(least(greatest(0,x2-x1),greatest(0,y2-y1))*sharpness,6) AS estimate, CASE WHEN source_id IS NULL THEN NULL
  ELSE concat(source_id,'_face_',det_id) END AS detection_id,
  round(greatest(0,(x1-8)/0.5),6) AS out_x1, round(least(320,(x2-8)/0.5),6) AS out_x2 FROM detections""", "detections"))
def detection_bands(spark, sf):
    p = TrackParams()
    score = F.col("score")
    image = geo.unpad_box(geo.box(), F.lit(8.0), F.lit(8.0), F.lit(0.5), F.lit(FRAME_W), F.lit(FRAME_H))
    return views.detections(spark, sf).select(
        "det_key",
        F.when(score >= p.high_score, "high").when(score >= p.low_score, "low").otherwise("none").alias("band"),
        (score >= p.new_score).alias("may_start"),
        F.round(geo.min_side(geo.box()) * F.col("sharpness"), 6).alias("estimate"),
        fx.detection_id(F.col("source_id"), F.col("det_id")).alias("detection_id"),
        F.round(image[0], 6).alias("out_x1"),
        F.round(image[2], 6).alias("out_x2"),
    )


DIST = "sqrt(power({0}x-({1}x),2)+power({0}y-({1}y),2))"
LEFT, RIGHT = "sqrt(power(nx-lex,2)+power(ny-ley,2))", "sqrt(power(nx-rex,2)+power(ny-rey,2))"
EYES = "sqrt(power(rex-lex,2)+power(rey-ley,2))"
DROP = "sqrt(power(nx-(lex+rex)/2,2)+power(ny-(ley+rey)/2,2))"
MOUTH = "sqrt(power((lmx+rmx)/2-(lex+rex)/2,2)+power((lmy+rmy)/2-(ley+rey)/2,2))"
SMILE = "sqrt(power(rmx-lmx,2)+power(rmy-lmy,2))"
ANGLES = f"""
, angles AS (SELECT *, ({LEFT}-{RIGHT})/({LEFT}+{RIGHT}+1e-6) AS yaw, {DROP}/({MOUTH}+1e-6)-0.45 AS pitch,
  {EYES} AS eyes, {SMILE}/({EYES}+1e-6) AS smile FROM landmark_points)
"""


def faces(spark, sf):
    return fq.with_face(views.landmark_rows(spark, sf), F.col("landmarks")).drop("landmarks")


@query("pose_angles", check_sql(ANGLES + """
SELECT det_key, round(yaw,6)+0.0 AS yaw, round(pitch,6) AS pitch, round(0.0-yaw,6)+0.0 AS enrol_yaw, round(pitch+0.01,6) AS enrol_pitch,
  CASE WHEN smile>0.62 THEN 'SMILE' WHEN yaw < -0.40 THEN 'LEFT_60' WHEN yaw > 0.40 THEN 'RIGHT_60' WHEN yaw < -0.15 THEN 'LEFT_30'
  WHEN yaw > 0.15 THEN 'RIGHT_30' WHEN pitch > 0.18 THEN 'UP' WHEN pitch < -0.18 THEN 'DOWN' ELSE 'FRONTAL' END AS with_smile
FROM angles""", "landmark_points"))
def pose_angles(spark, sf):
    rows = faces(spark, sf).select(
        "det_key", fq.pose_yaw().alias("yaw"), fq.pose_pitch().alias("pitch"), fq.enrol_yaw().alias("enrol_yaw"),
        fq.enrol_pitch().alias("enrol_pitch"), *fq.FACE,
    )
    return rows.select(
        "det_key", *[(F.round(c, 6) + 0.0).alias(c) for c in ("yaw", "pitch", "enrol_yaw", "enrol_pitch")],
        fq.pose_bin(F.col("yaw"), F.col("pitch"), smile=True).alias("with_smile"),
    )


BRIGHT = "CAST((det_key*17)%256 AS DOUBLE)"


@query("quality_score_b", check_sql(ANGLES + f"""
SELECT det_key, round(greatest(0,least(1,0.4*least(sharpness/100,1)+0.3*(1-abs({BRIGHT}-128)/128)+0.3*least(eyes/60,1))),8) AS score,
  round(0.30*least(1,greatest(0,sharpness/500))+0.20*least(1,greatest(0,((x2-x1)*(y2-y1)-1000)/49000))+0.15*(1-abs(yaw))
    +0.15*least(1,greatest(0,({BRIGHT}-40)/180))+0.10*(1-0.25)+0.10*least(1,greatest(0,sharpness/1000)),6) AS six_factor,
  sharpness<30 OR (x2-x1)*(y2-y1)<900 OR abs(yaw)>0.6 OR {BRIGHT}<30 OR {BRIGHT}>240 AS rejected
FROM angles""", "landmark_points"))
def quality_score_b(spark, sf):
    sharp, bright = F.col("sharpness"), F.expr(BRIGHT)
    six = fq.six_factor_score(sharp, geo.area(geo.box()), fq.pose_yaw(), bright, F.lit(0.25), sharp)
    return faces(spark, sf).select(
        "det_key", fq.sample_score(sharp, bright, F.col("face_eyes"), digits=8).alias("score"),
        F.round(six, 6).alias("six_factor"),
        fq.six_factor_rejects(sharp, geo.area(geo.box()), fq.pose_yaw(), bright, F.lit(0.25)).alias("rejected"),
    )


REASONS = f"""array_to_string(list_filter([CASE WHEN x2-x1<45 OR y2-y1<45 THEN 'Face too small — move closer or choose a clearer face' END,
  CASE WHEN {{frame}} THEN 'Keep the face fully inside the frame' END,
  CASE WHEN eyes<10 THEN 'Ensure eyes are visible' END, CASE WHEN sharpness<18 THEN 'Image blurry — hold still' END,
  CASE WHEN {BRIGHT}<25 OR {BRIGHT}>235 THEN 'Adjust lighting' END], lambda r: r IS NOT NULL), '; ')"""
OUT_CCTV = "x1<0 OR y1<0 OR x2>240 OR y2>160"
OUT_WEBCAM = "(x1+x2)/2<12 OR (x1+x2)/2>228 OR (y1+y2)/2<8 OR (y1+y2)/2>152"


@query("quality_reasons", check_sql(ANGLES + f"""
, r AS (SELECT det_key, {REASONS.format(frame=OUT_CCTV)} AS cctv, {REASONS.format(frame=OUT_WEBCAM)} AS webcam FROM angles)
SELECT det_key, cctv, webcam, cctv='' AS passed FROM r""", "landmark_points"))
def quality_reasons(spark, sf):
    def reasons(method):
        return fq.failing_checks(
            geo.box(), F.col("face_eyes"), F.col("sharpness"), F.expr(BRIGHT), 240.0, 160.0, method
        )

    return faces(spark, sf).select(
        "det_key", F.array_join(reasons("CCTV"), "; ").alias("cctv"), F.array_join(reasons("WEBCAM"), "; ").alias("webcam"),
        (F.size(reasons("CCTV")) == 0).alias("passed"),
    )


@query("first_fail_reason", check_sql(ANGLES + """
SELECT det_key, CASE WHEN x2-x1<45 OR y2-y1<45 THEN concat('Face size too small (',CAST(floor(x2-x1) AS INTEGER),'x',
    CAST(floor(y2-y1) AS INTEGER),'px < 45px)')
  WHEN eyes<22 THEN printf('Low eye resolution (%.1fpx)', eyes)
  WHEN abs(yaw)>0.05 THEN printf('Extreme head yaw/turn (symmetry diff %.2f)', abs(yaw))
  WHEN sharpness<40 THEN printf('Blurry image (score: %.1f < threshold: 40.0)', sharpness)
  ELSE 'Good Quality Face' END AS reason FROM angles""", "landmark_points"))
def first_fail_reason(spark, sf):
    p = QualityParams(min_size=45.0, min_eye_distance=22.0, max_symmetry=0.05)
    return faces(spark, sf).select(
        "det_key", fq.first_failure(geo.box(), F.col("sharpness"), p).alias("reason")
    )


@query("solo_frames", check_sql("""
, one AS (SELECT source_id, frame_id FROM detections GROUP BY 1,2 HAVING count(*)=1),
g AS (SELECT d.source_id, d.frame_id, d.det_key, row_number() OVER (PARTITION BY d.source_id ORDER BY d.frame_id) AS sample_no
  FROM detections d JOIN one USING (source_id, frame_id) WHERE d.sharpness>=18)
SELECT * FROM g WHERE sample_no<=6""", "detections"))
def solo(spark, sf):
    rows = views.detections(spark, sf).select("source_id", "frame_id", "det_key", "sharpness")
    out = solo_frames(rows, ["source_id", "frame_id"], ["source_id"], ["frame_id"], F.col("sharpness") >= 18, 6)
    return out.select("source_id", "frame_id", "det_key", F.col("sample_no").cast("long").alias("sample_no"))


def opening_sql(rows: int, seconds: float) -> str:
    return f"""
, o AS (SELECT *, row_number() OVER w AS rn, first_value(second) OVER w AS began FROM track_rows
  WINDOW w AS (PARTITION BY track_id ORDER BY second, det_key)),
e AS (SELECT *, least(x2-x1,y2-y1)*sharpness AS estimate FROM o WHERE rn<={rows} AND second-began<{seconds}),
b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY estimate DESC, second, det_key) AS k FROM e)
"""


@query("track_best_row", check_sql(opening_sql(12, 1.2) + """
SELECT track_id, det_key, second, round(estimate,6) AS estimate FROM b WHERE k=1""", "track_rows"))
def track_best_row(spark, sf):
    best = tracks.best_track_row(views.track_rows(spark, sf), ["track_id"], "second", ["det_key"])
    return best.select("track_id", "det_key", "second", F.round("estimate", 6).alias("estimate"))


@query("track_decision_gate", check_sql(opening_sql(10, 1.0) + """
SELECT track_id, det_key, least(estimate/8000.0,1.0)*100>=55 AS passes FROM b WHERE k=1""", "track_rows"))
def track_decision_gate(spark, sf):
    p = TrackParams()
    best = tracks.best_track_row(
        views.track_rows(spark, sf), ["track_id"], "second", ["det_key"],
        max_rows=p.live_window_rows, max_seconds=p.live_window_seconds,
    )
    quality = F.least(F.col("estimate") / 8000.0, F.lit(1.0))
    return best.select("track_id", "det_key", (quality * 100 >= p.live_quality_gate).alias("passes"))


@query("track_recognition", check_sql(opening_sql(12, 1.2) + """
, best AS (SELECT track_id, det_key, sharpness, CAST(hash_id*5 AS BIGINT) AS capture_id FROM (
    SELECT *, det_key%(SELECT count(*) FROM probes) AS hash_id FROM b WHERE k=1)),
m AS (SELECT p.capture_id, arg_max(g.entity_id, list_cosine_similarity(p.embedding,g.embedding)) AS entity_id,
  max(list_cosine_similarity(p.embedding,g.embedding)) AS sim FROM probes p CROSS JOIN gallery g GROUP BY 1)
SELECT track_id, det_key, CASE WHEN sharpness>=60 AND sim>=0.35 THEN m.entity_id ELSE 'unknown' END AS entity_id,
  CASE WHEN sharpness>=60 AND sim>=0.30 THEN round(sim,4) ELSE 0 END AS similarity
FROM best JOIN m USING (capture_id)""", "track_rows", "probes", "gallery"))
def track_recognition(spark, sf):
    from sightline.plans.gallery_queries import MATCH

    probes = views.probes(spark, sf).select("capture_id", "embedding")
    best = tracks.best_track_row(views.track_rows(spark, sf), ["track_id"], "second", ["det_key"])
    # Each best row borrows a probe's vector.
    n = probes.agg(F.count(F.lit(1))).scalar()
    rows = best.withColumn("capture_id", (F.col("det_key") % n) * 5).join(probes, "capture_id")
    found = tracks.recognise_tracks(
        rows, views.gallery(spark, sf), "det_key", "capture_id", F.col("sharpness") / 100.0, p=MATCH
    )
    return found.select("track_id", "det_key", "entity_id", "similarity")


def vote_rows(spark, sf):
    return views.sightings(spark, sf).select(
        "track_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "id", "entity_id", "similarity",
        (F.unix_micros("ts") / 1e6).alias("second"),
    )


VOTES = TrackParams(vote_window_seconds=21600.0, vote_limit=3)
VOTE_SQL = """
, v AS (SELECT track_id, strftime(ts,'%Y-%m-%d') AS day, id, entity_id, similarity, epoch_us(ts)/1e6 AS second,
  coalesce(entity_id<>'' AND entity_id<>'unknown', false) AS known FROM sightings),
s AS (SELECT *, min(second) OVER (PARTITION BY track_id, day) AS began,
  sum(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, day ORDER BY second, id ROWS UNBOUNDED PRECEDING) AS votes_so_far FROM v),
d AS (SELECT track_id, day, min(second) AS decided_at FROM s WHERE second>=began+21600 OR votes_so_far>=3 GROUP BY 1,2),
e AS (SELECT s.track_id, s.day, entity_id, {score} AS sim, min(second) AS first, count(*) AS votes
  FROM s JOIN d ON d.track_id=s.track_id AND d.day=s.day WHERE known AND second<=decided_at GROUP BY 1,2,3),
w AS (SELECT *, row_number() OVER (PARTITION BY track_id, day ORDER BY sim DESC, first) AS rn FROM e)
SELECT d.track_id, d.day, coalesce(w.entity_id,'unknown') AS entity_id, round(coalesce(w.sim,0),6) AS similarity,
  coalesce(w.votes,0) AS votes, d.decided_at FROM d LEFT JOIN w ON w.track_id=d.track_id AND w.day=d.day AND w.rn=1"""


@query("track_consensus", check_sql(VOTE_SQL.format(score="max(similarity)"), "sightings"))
def track_consensus(spark, sf):
    out = tracks.consensus_window(vote_rows(spark, sf), ["track_id", "day"], "second", "id", p=VOTES)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("track_consensus_average", check_sql(VOTE_SQL.format(score="avg(similarity)"), "sightings"))
def track_consensus_average(spark, sf):
    out = tracks.consensus_window(vote_rows(spark, sf), ["track_id", "day"], "second", "id", vote="avg", p=VOTES)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("track_votes", check_sql("""
, e AS (SELECT track_id, entity_id, max(similarity) AS sim, min(id) AS first, count(*) AS votes FROM sightings
  WHERE coalesce(entity_id<>'unknown', false) GROUP BY 1,2)
SELECT track_id, entity_id, sim AS similarity, votes FROM (SELECT *, row_number() OVER (PARTITION BY track_id
  ORDER BY sim DESC, first) AS rn FROM e) WHERE rn=1""", "sightings"))
def track_votes(spark, sf):
    votes = views.sightings(spark, sf).where(fx.is_known(F.col("entity_id"))).select("track_id", "entity_id", "similarity", "id")
    return consensus(votes, ["track_id"], "entity_id", "similarity", ["id"])


STATE_SQL = """
, k AS (SELECT track_id, entity_id, row_number() OVER (PARTITION BY track_id ORDER BY id) AS rn FROM sightings
  WHERE similarity>=0.95 AND coalesce(entity_id<>'unknown', false)),
t AS (SELECT track_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS rows FROM sightings GROUP BY 1)
SELECT t.track_id, rows, CASE WHEN epoch_us(TIMESTAMP '2024-01-30 12:00:00')-epoch_us(last_seen)>43200000000 THEN 'LOST'
  WHEN k.entity_id IS NOT NULL THEN 'RECOGNIZED' ELSE 'TRACKING' END AS state
FROM t LEFT JOIN k ON k.track_id=t.track_id AND rn=1"""


@query("track_states", check_sql(STATE_SQL, "sightings"))
def track_states(spark, sf):
    log = views.sightings(spark, sf)
    strong = log.where(fx.is_known(F.col("entity_id")) & (F.col("similarity") >= 0.95))
    first = strong.groupBy("track_id").agg(F.min_by("entity_id", "id").alias("entity_id"))
    as_of = F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    states = tracks.track_states(log, ["track_id"], "ts", as_of, matches=first, idle_seconds=43200.0)
    return states.select("track_id", "rows", "state")


@query("track_overlay", check_sql("""
, k AS (SELECT track_id, arg_max(entity_id,(similarity,-id)) AS entity_id, arg_max(name,(similarity,-id)) AS name,
  max(similarity) AS similarity FROM sightings WHERE coalesce(entity_id<>'unknown', false) AND similarity<1 GROUP BY 1)
SELECT det_key, concat(t.source_id,'_face_',det_key) AS detection_id, CASE WHEN k.entity_id IS NULL THEN 'Analyzing...' ELSE k.name END AS name,
  round(coalesce(k.similarity,0),3) AS similarity, k.entity_id IS NOT NULL AS is_recognized
FROM track_rows t LEFT JOIN k ON k.track_id=t.track_id""", "track_rows", "sightings"))
def track_overlay(spark, sf):
    log = views.sightings(spark, sf).where(fx.is_known(F.col("entity_id")) & (F.col("similarity") < 1))
    best = log.groupBy("track_id").agg(
        F.max_by(F.struct("entity_id", "name", "similarity"), F.struct(F.col("similarity"), -F.col("id"))).alias("_b")
    ).select("track_id", "_b.*")
    rows = tracks.with_matches(views.track_rows(spark, sf), best, ["track_id"])
    return tracks.overlay(rows.withColumn("track_no", F.col("det_key"))).select(
        F.col("track_no").alias("det_key"), "detection_id", "name", "similarity", "is_recognized"
    )
