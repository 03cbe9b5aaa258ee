"""Queries through the readers and writers, candidates and the target lock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sightline.functions import text as fx
from sightline.functions import quality as fq
from sightline.operators import candidates as cand
from sightline.operators import registry, reports, rollups
from sightline.operators.enrolment import commit_sessions, target_lock
from sightline.operators.inverted import build_index, search_index
from sightline.operators.numbering import dense_ids
from sightline.operators.paging import PagedLog
from sightline.operators.refresh import refresh_topk
from sightline.operators.similarity import lsh_topk, similarity_topk
from sightline.params import EnrolParams
from sightline.plans.catalog import CHECKS, query
from sightline.plans.gallery_queries import PAIRS, enrol_pose
from sightline.plans.report_queries import EVENT_COLUMNS, KNOWN, ranged
from sightline.session import scratch_path
from sightline.sources import sinks, tables, views
from sightline.sources.versioned import KeyedTable
from sightline.sources.views import AS_OF, check_sql


@query("csv_export", CHECKS["csv_projection"])
def csv_export(spark, sf):
    path = sinks.write_report_csv(
        ranged(spark, sf), scratch_path(spark, "csv"), datetime(2024, 1, 1), datetime(2024, 1, 31)
    )
    schema = "ID long, `Entity ID` string, Name string, Similarity string, Source string, `Track ID` string, Timestamp string"
    return spark.read.schema(schema).option("header", True).csv(path)


@query("sighting_append", check_sql(f"""
SELECT strftime(ts,'%Y-%m-%d') AS day, count(*) AS events, CAST(sum(id) AS BIGINT) AS checksum FROM sightings WHERE {KNOWN}
GROUP BY 1""", "sightings"))
def sighting_append(spark, sf):
    log, path = views.sightings(spark, sf), scratch_path(spark, "log")
    sinks.append_sightings(log.where("ts < '2024-01-15'"), path)
    sinks.append_sightings(log.where("ts >= '2024-01-15'"), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("id").alias("checksum")
    )


@query("gallery_persist", check_sql("""
SELECT capture_id, entity_id, round(embedding[1],6) AS first_value FROM gallery WHERE is_active""", "gallery"))
def gallery_persist(spark, sf):
    path = scratch_path(spark, "gallery")
    sinks.save_gallery(views.gallery(spark, sf), path)
    rows = sinks.load_gallery(spark, path)
    return rows.select("capture_id", "entity_id", F.round(F.col("embedding")[0], 6).alias("first_value"))


@query("embedding_blob", check_sql("""
SELECT capture_id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(embedding),6) AS total FROM captures""", "captures"))
def embedding_blob(spark, sf):
    blobs = views.captures(spark, sf).select("capture_id", tables.encode_embedding(F.col("embedding")).alias("blob"))
    back = blobs.withColumn("v", tables.decode_embedding(F.col("blob")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return back.select("capture_id", F.size("v").alias("dims"), F.round(total, 6).alias("total"))


@query("source_list_json", check_sql("""
, s AS (SELECT DISTINCT entity_id, coalesce(source_id,'default') AS source_id FROM sightings WHERE entity_id IS NOT NULL)
SELECT entity_id, concat('["',array_to_string(list_sort(list(source_id)),'","'),'"]') AS seen_sources, count(*) AS sources
FROM s GROUP BY 1""", "sightings"))
def source_list_json(spark, sf):
    seen = (
        views.sightings(spark, sf).where("entity_id IS NOT NULL")
        .groupBy("entity_id")
        .agg(F.array_sort(F.collect_set(fx.or_default(F.col("source_id"), "default"))).alias("s"))
    )
    text = seen.select("entity_id", tables.json_list(F.col("s")).alias("seen_sources"))
    return text.withColumn("sources", F.size(tables.parse_json_list(F.col("seen_sources"))).cast("long"))


def unknown_tracks(spark, sf):
    return views.captures(spark, sf).select(
        F.concat(F.lit("t"), "capture_id").alias("track_id"), "capture_id", "entity_id", "quality", "embedding",
        "image_path", "second", F.concat(F.lit("cam_"), F.col("capture_id") % 3).alias("source_id"),
    )


@query("candidate_list", check_sql("""
SELECT concat('CAND_',upper(substr(sha1(concat('t',capture_id)),1,12))) AS candidate_id, CASE WHEN quality>=0.5 THEN 'READY' ELSE 'REVIEWED' END AS status,
  concat('["cam_',capture_id%3,'"]') AS seen_sources, CAST(1 AS BIGINT) AS image_count FROM captures""", "captures"))
def candidate_list(spark, sf):
    tracks = unknown_tracks(spark, sf)
    made, images = cand.create_candidates(tracks, F.to_timestamp(F.lit(AS_OF)))
    weak = cand.create_candidates(tracks.where("quality < 0.5"), F.to_timestamp(F.lit(AS_OF)))[0].select("candidate_id").withColumn("_weak", F.lit(True))
    reviewed = made.join(weak, "candidate_id", "left").withColumn("status", F.when(F.col("_weak"), "REVIEWED").otherwise(F.col("status"))).drop("_weak")
    return cand.list_candidates(reviewed, images).select("candidate_id", "status", "seen_sources", "image_count")


@query("candidate_images", check_sql("""
SELECT concat('CAND_',upper(substr(sha1(concat('t',capture_id)),1,12))) AS candidate_id, 'READY' AS status,
  concat('/faces/candidates/CAND_',upper(substr(sha1(concat('t',capture_id)),1,12)),'/v',capture_id,'.jpg') AS image_url
FROM captures""", "captures"))
def candidate_images(spark, sf):
    made, images = cand.create_candidates(unknown_tracks(spark, sf), F.to_timestamp(F.lit(AS_OF)))
    return cand.candidate_images(made, images).select("candidate_id", "status", "image_url")


@query("candidate_queue", check_sql("""
SELECT entity_id, count(*) AS captures, count(*) FILTER (quality>=0.8) AS best, round(avg(quality),6) AS avg_quality,
  count(DISTINCT capture_id%3) AS sources FROM captures GROUP BY 1
HAVING count(*)>=10 AND count(*) FILTER (quality>=0.8)>=4 AND round(avg(quality),6)>=0.48""", "captures"))
def candidate_queue(spark, sf):
    images = unknown_tracks(spark, sf).withColumnRenamed("quality", "quality_score")
    return cand.review_queue(images, "entity_id", min_quality=0.48)


@query("candidate_merge", check_sql("""
, ranked AS (SELECT capture_id, embedding, row_number() OVER (ORDER BY capture_id//4, capture_id) AS rn FROM captures),
walk AS (SELECT capture_id, rn, capture_id AS candidate, CAST(1 AS DOUBLE) AS similarity,
    [{'id':capture_id,'v':embedding}] AS kept FROM ranked WHERE rn=1
  UNION ALL SELECT capture_id, rn, CASE WHEN best.s > 0.3 THEN best.id ELSE capture_id END,
    CASE WHEN best.s > 0.3 THEN best.s ELSE 1 END,
    CASE WHEN best.s > 0.3 THEN kept ELSE list_append(kept, {'id':capture_id,'v':embedding}) END FROM (
    SELECT r.capture_id, r.rn, r.embedding, w.kept, list_sort(list_transform(w.kept,
      lambda k: {'s':list_cosine_similarity(k.v, r.embedding),'id':k.id}),'DESC')[1] AS best
    FROM walk w JOIN ranked r ON r.rn=w.rn+1))
SELECT capture_id, candidate, round(similarity,6) AS similarity FROM walk""", "captures", recursive=True))
def candidate_merge(spark, sf):
    # Four tracks share each time, so their ids decide among them.
    rows = views.captures(spark, sf).select("capture_id", F.floor(F.col("capture_id") / 4).alias("second"), "embedding")
    merged = cand.merge_candidates(rows, "capture_id", "second", threshold=0.3)
    return merged.withColumn("similarity", F.round("similarity", 6))


@query("vector_topk_approx")
def vector_topk_approx(spark, sf):
    hits = lsh_topk(views.probes(spark, sf), views.gallery(spark, sf), "capture_id", "capture_id", 5, 0.2)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("vector_topk_index")
def vector_topk_index(spark, sf):
    index = build_index(views.gallery(spark, sf), "capture_id")
    hits = search_index(index, views.probes(spark, sf), "capture_id", "capture_id", 5, 0.2)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("vector_index_recall", check_sql(PAIRS + """
SELECT count(*) AS hits, true AS exact, true AS enough FROM (
  SELECT row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gid) AS rn FROM pairs WHERE sim>=0.2) WHERE rn<=5""",
    "probes", "gallery"))
def vector_index_recall(spark, sf):
    """The index against the full search: the number of true hits, whether each found pair has its
    true similarity, and whether nine of ten true hits are found."""
    full = similarity_topk(views.probes(spark, sf), views.gallery(spark, sf), "capture_id", "capture_id", 5, 0.2)
    found = vector_topk_index(spark, sf).select("capture_id", "match_id", F.col("similarity").alias("near"))
    joined = full.join(found, ["capture_id", "match_id"], "left")
    hits, met = F.count(F.lit(1)), F.count("near")
    wrong = F.count_if(F.abs(F.col("near") - F.col("similarity")) > 1e-5)
    return joined.agg(hits.alias("hits"), (wrong == 0).alias("exact"), (met * 10 >= hits * 9).alias("enough"))


def commit_tables(spark, sf):
    people = views.entities(spark, sf)
    registry = people.select("entity_id", "name", "department", F.lit(1).alias("gallery_version"))
    g = dense_ids(views.gallery(spark, sf), "capture_id", "gallery_id").select(
        "entity_id", "capture_id", "embedding", "gallery_id", "image_path", "is_active"
    )
    samples = views.probes(spark, sf).withColumn("pose", fq.session_pose(enrol_pose())).select(
        "entity_id", "capture_id", "pose", "embedding"
    )
    # The search runs on the gallery's own ids; new rows continue them.
    return commit_sessions(samples, people.select("entity_id", "name"), registry, g, "capture_id", "gallery_id", 0.42)


COMMIT = """
, bad AS (SELECT DISTINCT p.entity_id FROM probes p JOIN gallery g ON p.entity_id<>g.entity_id
  WHERE list_cosine_similarity(p.embedding, g.embedding)>=0.42),
good AS (SELECT * FROM probes WHERE entity_id NOT IN (SELECT entity_id FROM bad)
  AND entity_id IN (SELECT entity_id FROM probes GROUP BY 1 HAVING count(*)>=5))
"""


@query("registration_commit", check_sql(COMMIT + """
SELECT capture_id, entity_id, (SELECT count(*) FROM gallery)-1+row_number() OVER (ORDER BY capture_id) AS gallery_id,
  concat(entity_id,'/sample_',row_number() OVER (PARTITION BY entity_id ORDER BY capture_id),'_',CASE WHEN yaw <= -0.12
    THEN 'slight_left' WHEN yaw >= 0.12 THEN 'slight_right' ELSE 'frontal' END,'.jpg') AS image_path FROM good
UNION ALL SELECT capture_id, entity_id, row_number() OVER (ORDER BY capture_id)-1, image_path FROM gallery""",
    "probes", "gallery"))
def registration_commit(spark, sf):
    return commit_tables(spark, sf)["gallery"].select("capture_id", "entity_id", "gallery_id", "image_path")


@query("registration_commit_audit", check_sql(COMMIT + """
SELECT 'REGISTER_PERSON' AS action, e.entity_id, concat('Registered ',e.name,' with ',count(*),' gallery face samples.') AS details
FROM good JOIN entities e ON e.entity_id=good.entity_id GROUP BY e.entity_id, e.name""", "probes", "gallery", "entities"))
def registration_commit_audit(spark, sf):
    return commit_tables(spark, sf)["audit"]


@query("track_reopen", check_sql("""
SELECT track_id, max(ts) AS last_seen FROM sightings GROUP BY 1
HAVING epoch_us(TIMESTAMP '2024-01-30 12:00:00')-epoch_us(max(ts)) <= 43200000000""", "sightings"))
def track_reopen(spark, sf):
    from sightline.operators.tracks import reopen_tracks

    seen = views.sightings(spark, sf).groupBy("track_id").agg(F.max("ts").alias("last_seen"))
    decided = seen.withColumn("entity_id", F.lit("P_1"))
    return reopen_tracks(decided, F.to_timestamp(F.lit("2024-01-30 12:00:00")), idle_seconds=43200.0)


@query("target_lock_states")
def target_lock_states(spark, sf):
    """One session per label: start, a selected first face, then frames; every 16th step unlocks."""
    c = views.captures(spark, sf)
    side = 50.0 + F.col("capture_id") % 40
    first = c.groupBy("entity_id").agg(F.min("capture_id").alias("first"))
    rows = (
        c.join(first, "entity_id")
        .withColumn("_n", F.col("capture_id") - F.col("first"))
        .select(
            F.col("entity_id").alias("session"), F.col("capture_id").alias("seq"),
            F.timestamp_micros((F.col("second") * 1_000_000).cast("long")).alias("ts"),
            F.when(F.col("_n") == 0, "select").when(F.col("capture_id") % 16 == 15, "unlock")
            .when(F.col("capture_id") % 16 == 0, "select").otherwise("frame").alias("command"),
            F.col("capture_id").alias("track"), (F.col("capture_id") % 200).cast("double").alias("x1"),
            (F.col("capture_id") % 100).cast("double").alias("y1"),
            (F.col("capture_id") % 200 + side).alias("x2"), (F.col("capture_id") % 100 + side).alias("y2"),
            F.col("quality").alias("score"), (F.col("quality") >= 0.5).alias("passed"),
            fq.session_pose(enrol_pose()).alias("pose"), "embedding",
        )
    )
    p = EnrolParams(lock_similarity=0.0, reacquire_similarity=0.05, duplicate_similarity=0.25, min_confidence=0.2)
    out = target_lock(rows, ["session"], "ts", p)
    return out.withColumn("similarity", F.round("similarity", 6)).withColumn("track", F.coalesce("track", F.lit(-1)))


# The gallery before the change has the captures with a payload; then the blurred ones of it go and those without come in.
AFTER = "NOT has_payload OR blur >= 30"


@query("gallery_change", check_sql(f"""
, pairs AS (SELECT p.capture_id AS pid, g.capture_id AS gid, g.entity_id AS ge,
  list_cosine_similarity(p.embedding, g.embedding) AS sim FROM probes p CROSS JOIN gallery g WHERE {AFTER.replace("has_payload", "g.has_payload").replace("blur", "g.blur")})
SELECT pid AS capture_id, gid AS match_id, ge AS match_label, round(sim,6) AS similarity, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY sim DESC, gid) AS rn FROM pairs WHERE sim>=0.2) WHERE rn<=5""",
    "probes", "gallery"))
def gallery_change(spark, sf):
    probes, rows = views.probes(spark, sf), views.gallery(spark, sf)
    old = rows.where("has_payload")
    path = scratch_path(spark, "hits")
    similarity_topk(probes, old, "capture_id", "capture_id", 5, 0.2).write.parquet(path)
    hits = refresh_topk(
        spark.read.parquet(path), probes, rows.where(AFTER), rows.where("NOT has_payload"), old.where("blur < 30"),
        "capture_id", "capture_id", 5, 0.2,
    )
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("registry_rewrite", check_sql("""
, changed AS (SELECT entity_id, id, name, role IN ('Blacklist') AS gone, department='BUILDING' AS hit FROM entities)
SELECT entity_id, CASE WHEN hit THEN upper(name) ELSE name END AS name,
  CAST(CASE WHEN hit THEN 2 ELSE 1 END AS INTEGER) AS gallery_version FROM changed WHERE NOT gone""", "entities"))
def registry_rewrite(spark, sf):
    people = views.entities(spark, sf)
    table = KeyedTable(scratch_path(spark, "registry"), "entity_id")
    table.create(people.selectExpr("entity_id", "name", "1 AS gallery_version"), 16)
    changes = people.where("department = 'BUILDING'").selectExpr("entity_id", "upper(name) AS name")
    table.rewrite(changes, lambda old: registry.upsert_entities(old, changes))
    removed = people.where("role = 'Blacklist'")
    table.rewrite(removed, lambda old: registry.cascade_delete(removed, entities=old)["entities"])
    return table.read(spark)


def rolled_up(spark, sf, start=datetime(2024, 1, 1), stop=datetime(2024, 1, 31), source=None):
    """Roll-ups of the log's first half, brought up to date from the whole log, for a range."""
    log = views.sightings(spark, sf)
    stored = rollups.Rollups(scratch_path(spark, "rollups"))
    stored.create(log.where("ts < '2024-01-15 06:00:00'"), 16)
    stored.refresh(log, log.where("ts >= '2024-01-15'").select(fx.day_key(F.col("ts")).alias("day")))
    return stored.between(log, start, stop, source)


@query("rollup_totals", CHECKS["report_totals"])
def rollup_totals(spark, sf):
    return rollups.totals(rolled_up(spark, sf)[0])


@query("rollup_totals_part_days", CHECKS["report_totals_default_range"])
def rollup_totals_part_days(spark, sf):
    return rollups.totals(rolled_up(spark, sf, datetime(2024, 1, 23, 12), datetime(2024, 1, 30, 12), "cam_3")[0])


@query("rollup_approx_entities", check_sql(f"""
SELECT count(*) AS total_events, count(DISTINCT entity_id) FILTER ({KNOWN}) AS unique_entities, true AS within_five_percent
FROM sightings WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'""", "sightings"))
def rollup_approx_entities(spark, sf):
    entities, sources = rolled_up(spark, sf)
    both = rollups.quick_totals(sources).join(rollups.totals(entities), "total_events")
    near = F.abs(F.col("approx_entities") - F.col("unique_entities")) <= 0.05 * F.col("unique_entities")
    return both.select("total_events", "unique_entities", near.alias("within_five_percent"))


@query("rollup_by_source", CHECKS["report_by_source"])
def rollup_by_source(spark, sf):
    return rollups.by_source(rolled_up(spark, sf)[1])


@query("rollup_by_day", CHECKS["report_by_day"])
def rollup_by_day(spark, sf):
    return rollups.by_day(rolled_up(spark, sf)[1])


@query("rollup_top_entities", CHECKS["report_top_entities"])
def rollup_top_entities(spark, sf):
    return rollups.top_entities(rolled_up(spark, sf)[0])


@query("rollup_grouping_sets", CHECKS["report_grouping_sets"])
def rollup_grouping_sets(spark, sf):
    return rollups.breakdown(rolled_up(spark, sf)[0])


@query("history_deep_page", check_sql(f"""
SELECT {EVENT_COLUMNS} FROM sightings WHERE source_id='cam_2' ORDER BY ts DESC, id DESC LIMIT 50
OFFSET (SELECT count(*)*9//10 FROM sightings WHERE source_id='cam_2')""", "sightings"))
def history_deep_page(spark, sf):
    log = views.sightings(spark, sf)
    paged = PagedLog(scratch_path(spark, "pages"), "ts")
    paged.write(log, 24)
    offset = log.where("source_id = 'cam_2'").count() * 9 // 10
    return paged.page(spark, 50, offset, "cam_2")


@query("event_snapshots", check_sql(f"""
SELECT {EVENT_COLUMNS}, CASE WHEN id%3<>0 THEN concat('/faces/snapshots/',track_id,'_',CAST(id AS VARCHAR(20)),'.jpg') END AS snapshot_url
FROM sightings ORDER BY id DESC LIMIT 200""", "sightings"))
def event_snapshots(spark, sf):
    """Latest events with links to their snapshots; every third event has none."""
    path = F.expr("CASE WHEN id % 3 <> 0 THEN concat('data/snapshots/', source_id, '/', track_id, '_', id, '.jpg') WHEN id % 2 = 0 THEN '' END")
    named = views.sightings(spark, sf).withColumn("source_id", fx.or_default(F.col("source_id"), "default"))
    return reports.history_page(named.withColumn("snapshot_path", path), 200)
