"""Queries through readers, hooks and small functions that no other query uses."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from sightline.functions import text as fx
from sightline.operators import registry, reports, tracks
from sightline.plans.catalog import query
from sightline.plans.report_queries import KNOWN
from sightline.session import scratch_path
from sightline.sources import sinks, tables, views
from sightline.sources.views import check_sql


def written_json(spark, rows, part, name):
    """One JSON text per value of ``part``, each in a file of its own."""
    path = scratch_path(spark, name)
    rows.repartition(part).write.partitionBy(part).text(path)
    return f"{path}/{part}=*"


@query("source_settings", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier)
SELECT CAST(place AS BIGINT) AS id, CASE WHEN s_suppkey%3<>0 THEN concat('s',s_suppkey) WHEN s_suppkey%2=0 THEN concat('c',s_suppkey)
  ELSE printf('cam_%02d', place) END AS source_id, s_name AS name, 'Default Location' AS location, s_suppkey%4<>0 AS enabled,
  CASE WHEN s_suppkey%5=0 THEN 15 ELSE CAST(s_suppkey%5 AS INTEGER) END AS fps_limit, CASE WHEN s_suppkey%4<>0 THEN 'ONLINE' ELSE 'OFFLINE' END AS status
FROM s""")
def source_settings(spark, sf):
    """Settings files, one per nation, as JSON arrays with missing and empty fields."""
    s = views.table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    item = F.struct(
        key.alias("_order"), F.when(key % 3 != 0, F.concat(F.lit("s"), key)).otherwise(F.lit("")).alias("id"),
        F.when(key % 2 == 0, F.concat(F.lit("c"), key)).alias("camera_id"), F.col("s_name").alias("name"), (key % 4 != 0).alias("enabled"),
        (key % 5).cast("int").alias("fps_limit"),
    )
    files = s.groupBy("s_nationkey").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("value"))
    rows = tables.read_sources(spark, written_json(spark, files, "s_nationkey", "settings"))
    return rows.select("id", "source_id", "name", "location", "enabled", "fps_limit", "status")


@query("gallery_id_map", check_sql("""
SELECT capture_id AS gallery_id, entity_id, concat('n',capture_id) AS name, round(list_sum(embedding),6) AS total FROM captures""", "captures"))
def gallery_id_map(spark, sf):
    """Map files of 64 gallery ids each, as JSON objects keyed by id."""
    entry = F.struct(
        F.col("capture_id").cast("string").alias("k"),
        F.struct(F.col("entity_id").alias("person_id"), F.concat(F.lit("n"), "capture_id").alias("name"), F.col("embedding")).alias("v"),
    )
    rows = views.captures(spark, sf).withColumn("part", F.floor(F.col("capture_id") / 64))
    files = rows.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    back = tables.read_gallery_map(spark, written_json(spark, files, "part", "gallery-map"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return back.select("gallery_id", "entity_id", "name", F.round(total, 6).alias("total"))


@query("entity_csv", check_sql("SELECT entity_id, name, department, role FROM entities WHERE role<>'Visitor'", "entities"))
def entity_csv(spark, sf):
    path = scratch_path(spark, "entities")
    sinks.write_csv(views.entities(spark, sf).select("entity_id", "name", "department", "role").where("role <> 'Visitor'"), path)
    return spark.read.schema("entity_id string, name string, department string, role string").option("header", True).csv(path)


@query("sample_removal", check_sql("""
SELECT entity_id, count(*) AS samples, greatest(0, 60-count(*)) AS remaining, CAST(ceil(greatest(0, 60-count(*))*1.2) AS BIGINT) AS seconds_left
FROM captures WHERE capture_id%7<>0 GROUP BY 1""", "captures"))
def sample_removal(spark, sf):
    """Samples taken out of their sessions, and what each session then still needs."""
    rows = views.captures(spark, sf).select("entity_id", "capture_id")
    left = registry.remove_rows(rows, rows.where("capture_id % 7 = 0"), ["capture_id"])
    counts = left.groupBy("entity_id").agg(F.count(F.lit(1)).alias("samples"))
    return counts.withColumn("remaining", fx.remaining_samples(F.col("samples"), 60)).withColumn("seconds_left", fx.remaining_seconds(F.col("samples"), 60))


@query("decided_tracks", check_sql(f"""
, m AS (SELECT track_id, arg_min(entity_id, id) AS entity_id FROM sightings WHERE {KNOWN} GROUP BY 1),
b AS (SELECT track_id, max(id) AS best_row FROM sightings WHERE similarity>=0.5 GROUP BY 1)
SELECT t.track_id, m.entity_id, b.best_row FROM (SELECT DISTINCT track_id FROM sightings) t JOIN m USING (track_id) JOIN b USING (track_id)""", "sightings"))
def decided_tracks(spark, sf):
    log = views.sightings(spark, sf)
    match = log.where(fx.is_known(F.col("entity_id"))).groupBy("track_id").agg(F.min_by("entity_id", "id").alias("entity_id"))
    best = log.where("similarity >= 0.5").groupBy("track_id").agg(F.max("id").alias("best_row"))
    rows = log.select("track_id").distinct().join(match, "track_id", "left").join(best, "track_id", "left")
    return tracks.decided_tracks(rows).select("track_id", "entity_id", "best_row")


PRESETS = (1, 7, 30)


@query("preset_totals", check_sql(" UNION ALL ".join(
    f"SELECT {d} AS days, count(*) AS events FROM sightings WHERE ts >= DATE '2024-01-29' - INTERVAL {d - 1} DAY AND ts < DATE '2024-01-30'"
    for d in PRESETS), "sightings"))
def preset_totals(spark, sf):
    out = None
    for days in PRESETS:
        begin, stop = reports.report_range(*reports.preset_range(days, date(2024, 1, 29)), datetime(2024, 1, 30))
        rows = reports.in_range(views.sightings(spark, sf), begin, stop)
        part = rows.agg(F.count(F.lit(1)).alias("events")).select(F.lit(days).alias("days"), "events")
        out = part if out is None else out.unionByName(part)
    return out


@query("source_union", check_sql("""
SELECT source_id, count(*) AS detections, round(sum(score),4) AS score FROM detections GROUP BY 1""", "detections"))
def source_union(spark, sf):
    """Detections of each source as a table of its own, put together again."""
    d = views.detections(spark, sf).select("source_id", "det_key", "score")
    odd = F.pmod(F.xxhash64("source_id"), F.lit(2)) == 1
    rows = tables.union_sources(d.where(odd), d.where(~odd).withColumn("legacy", F.lit(True)))
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("detections"), F.round(F.sum("score"), 4).alias("score"))


@query("detection_fallback", check_sql("""
SELECT 'empty' AS primary_set, count(*) AS rows, CAST(sum(det_key) AS BIGINT) AS checksum FROM detections
UNION ALL SELECT 'filled', count(*), CAST(sum(det_key) AS BIGINT) FROM detections WHERE score>=0.8""", "detections"))
def detection_fallback(spark, sf):
    d = views.detections(spark, sf).select("det_key", "score")
    cases = {"empty": d.where("score > 2"), "filled": d.where("score >= 0.8")}
    parts = [
        tables.with_fallback(primary, d).agg(F.count(F.lit(1)).alias("rows"), F.sum("det_key").alias("checksum"))
        .select(F.lit(name).alias("primary_set"), "rows", "checksum")
        for name, primary in cases.items()
    ]
    return parts[0].unionByName(parts[1])


@query("utc_text", check_sql("""
SELECT id, CASE WHEN id%4=3 THEN -1 ELSE epoch_us(ts)//1000000 END AS second,
  CASE WHEN id%4=3 THEN '' ELSE strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') END AS local_time FROM sightings""", "sightings"))
def utc_text(spark, sf):
    """Times as text with Z, with an offset, without a zone, and unreadable."""
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ahead = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(F.col("id") % 4 == 0, F.concat(plain, F.lit("Z"))).when(F.col("id") % 4 == 1, F.concat(ahead, F.lit("+02:00")))
        .when(F.col("id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("soon"))
    )
    rows = views.sightings(spark, sf).select("id", fx.parse_utc(text).alias("t"))
    local = F.date_format(fx.to_zone(F.col("t"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm")
    second = F.floor(F.unix_micros("t") / 1_000_000)
    return rows.select("id", F.coalesce(second, F.lit(-1)).alias("second"), F.coalesce(local, F.lit("")).alias("local_time"))


@query("overlay_quality", check_sql("SELECT det_key, round(least(sharpness/80.0, 1.0), 2) AS quality FROM detections", "detections"))
def overlay_quality(spark, sf):
    return views.detections(spark, sf).select("det_key", fx.overlay_quality(F.col("sharpness")).alias("quality"))


@query("embedding_hook", check_sql("""
SELECT det_key, round(x1/sqrt(x1*x1+y1*y1+1),6) AS a, round(y1/sqrt(x1*x1+y1*y1+1),6) AS b FROM detections""", "detections"))
def embedding_hook(spark, sf):
    """The hook for a model, with a stand-in that makes a vector from each box corner."""

    def extract(frames):
        for rows in frames:
            size = (rows["x1"] ** 2 + rows["y1"] ** 2 + 1) ** 0.5
            yield rows[["det_key"]].assign(embedding=list(map(list, zip(rows["x1"] / size, rows["y1"] / size))))

    rows = tables.extract_embeddings(views.detections(spark, sf).select("det_key", "x1", "y1"), extract, "det_key long, embedding array<double>")
    return rows.select("det_key", F.round(F.col("embedding")[0], 6).alias("a"), F.round(F.col("embedding")[1], 6).alias("b"))


@query("track_lifecycle", check_sql("""
, k AS (SELECT track_id, arg_min(entity_id, id) AS entity_id FROM sightings WHERE id%50=0 AND coalesce(entity_id<>'unknown', false) GROUP BY 1),
c AS (SELECT DISTINCT track_id FROM sightings WHERE id%30=7),
t AS (SELECT track_id, max(ts) AS last_seen, count(*) AS rows FROM sightings GROUP BY 1)
SELECT t.track_id, rows, CASE WHEN epoch_us(TIMESTAMP '2024-01-30 12:00:00')-epoch_us(last_seen)>86400000000 THEN 'LOST'
  WHEN k.entity_id IS NOT NULL THEN 'RECOGNIZED' WHEN c.track_id IS NOT NULL THEN 'CANDIDATE' ELSE 'TRACKING' END AS state
FROM t LEFT JOIN k USING (track_id) LEFT JOIN c ON c.track_id=t.track_id""", "sightings"))
def track_lifecycle(spark, sf):
    """All four states: few tracks have a match, some a candidate."""
    log = views.sightings(spark, sf)
    match = log.where(fx.is_known(F.col("entity_id")) & (F.col("id") % 50 == 0)).groupBy("track_id").agg(F.min_by("entity_id", "id").alias("entity_id"))
    candidates = log.where("id % 30 = 7").select("track_id").distinct().withColumn("candidate_id", F.concat(F.lit("CAND_"), "track_id"))
    as_of = F.to_timestamp(F.lit("2024-01-30 12:00:00"))
    return tracks.track_states(log, ["track_id"], "ts", as_of, match, candidates, 86400.0).select("track_id", "rows", "state")
