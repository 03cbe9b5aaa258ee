"""Streaming forms, run over all available data; equal to their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions.geometry import box, min_side
from sightline.functions.text import is_known
from sightline.operators import rules
from sightline.operators.reports import event_view
from sightline.params import TrackParams
from sightline.plans.catalog import CHECKS, query
from sightline.plans.detection_queries import opening_sql
from sightline.plans.gallery_queries import MATCH
from sightline.plans import report_queries as rq
from sightline.session import scratch_path
from sightline.sources import views
from sightline.sources.views import check_sql
from sightline.streaming import flows, state

HOUR = 3600.0
BATCH_ROWS = 4_000_000  # of a staged stream's micro-batch
START = 1_704_067_200_000_000  # frame clocks start here; time 0 would count as late


def sighting_stream(spark, sf):
    events = flows.table_stream(spark, f"{sf}/events.parquet", views.TABLES["events"])
    return views._view(spark, views.SIGHTINGS, events=events)


def capture_stream(spark, sf):
    rows = flows.table_stream(spark, f"{sf}/embeddings.parquet", views.TABLES["embeddings"])
    return views._view(spark, views.CAPTURES.replace("{embedding}", views.SPARK_EMBEDDING), embeddings=rows)


def staged_stream(spark, df, name, ts="ts"):
    """A derived table written to the shared folder and read back as a stream: at once, or in
    micro-batches in time order where it has more than ``BATCH_ROWS`` rows."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    batches = -(-rows.count() // BATCH_ROWS)
    if batches < 2:
        return flows.table_stream(spark, path, df.schema)
    shares = F.array(*[F.lit(k / batches) for k in range(1, batches)])
    edges = rows.agg(F.percentile_approx(F.unix_micros(ts), shares)).first()[0]
    return timed_batches(spark, rows, ts, [F.timestamp_micros(F.lit(t)) for t in sorted(set(edges))], f"{name}-batches")


@query("stream_cooldown", CHECKS["cooldown_source_entity"])
def stream_cooldown(spark, sf):
    rows = sighting_stream(spark, sf).where(is_known(F.col("entity_id")) & F.col("source_id").isNotNull())
    slim = rows.select("id", "source_id", "entity_id", "ts")
    kept = state.cooldown(slim, ["source_id", "entity_id"], "ts", 12 * HOUR, "id")
    return flows.drain(kept, "cooldown").select("id", "source_id", "entity_id")


@query("stream_attendance", rq.cooldown_check("entity_id", 86400, "id, entity_id, similarity AS confidence", strict=True))
def stream_attendance(spark, sf):
    rows = sighting_stream(spark, sf).where(is_known(F.col("entity_id"))).select("id", "entity_id", "similarity", "ts")
    kept = state.cooldown(rows, ["entity_id"], "ts", 24 * HOUR, "id", strict=True)
    return flows.drain(kept, "attendance").select("id", "entity_id", F.col("similarity").alias("confidence"))


@query("stream_sessions", check_sql("""
, f AS (SELECT entity_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts-lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS o
  FROM sightings WHERE entity_id IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY ts)),
n AS (SELECT entity_id, ts, sum(o) OVER (PARTITION BY entity_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f),
s AS (SELECT entity_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS rows FROM n GROUP BY entity_id, k)
SELECT * FROM s WHERE session_end + INTERVAL 6 HOUR <= (SELECT max(ts) FROM sightings WHERE entity_id IS NOT NULL) - INTERVAL 1 HOUR""",
    "sightings"))
def stream_sessions(spark, sf):
    rows = sighting_stream(spark, sf).where("entity_id IS NOT NULL").select("entity_id", "ts")
    return flows.drain(flows.session_counts(rows, ["entity_id"], "ts", 6 * HOUR), "sessions")


@query("stream_daily_counts", check_sql("""
SELECT strftime(ts,'%Y-%m-%d') AS day, coalesce(source_id,'default') AS source_id, count(*) AS events FROM sightings
WHERE date_trunc('day',ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM sightings) - INTERVAL 1 HOUR GROUP BY 1,2""", "sightings"))
def stream_daily_counts(spark, sf):
    return flows.drain(flows.daily_counts(sighting_stream(spark, sf).select("source_id", "ts")), "daily")


@query("stream_feed", check_sql(f"SELECT {rq.EVENT_COLUMNS} FROM sightings", "sightings"))
def stream_feed(spark, sf):
    return flows.drain(event_view(sighting_stream(spark, sf)), "feed")


@query("stream_rate_slots", check_sql("""
SELECT DISTINCT source_id, epoch_us(ts)//3600000000 AS slot FROM sightings WHERE source_id IS NOT NULL""", "sightings"))
def stream_rate_slots(spark, sf):
    rows = sighting_stream(spark, sf).where("source_id IS NOT NULL").select("source_id", "id", "ts")
    return flows.drain(flows.rate_slots(rows, ["source_id"], "ts", 1 / HOUR), "slots").select("source_id", "slot")


@query("stream_match", CHECKS["vector_match_status"])
def stream_match(spark, sf):
    probes = capture_stream(spark, sf).where("is_probe")
    return flows.match_stream(probes, lambda: views.gallery(spark, sf), "capture_id", "capture_id", "match", MATCH)


@query("stream_best_row", check_sql(opening_sql(12, 1.2) + """
, t AS (SELECT track_id, max(second) AS last, min(second) AS start, count(*) AS n FROM track_rows GROUP BY 1),
mx AS (SELECT max(second) AS m FROM track_rows)
SELECT b.track_id, b.det_key, round(b.estimate,6) AS estimate FROM b JOIN t USING (track_id), mx
WHERE k=1 AND (n>=12 OR last-start>=1.2 OR start+1.2<=m-1.0)""", "track_rows"))
def stream_best_row(spark, sf):
    rows = views.track_rows(spark, sf).withColumn("ts", F.timestamp_micros((F.col("second") * 1_000_000).cast("long") + START))
    stream = staged_stream(spark, rows.drop("second"), "track-rows")
    best = state.best_row(stream, ["track_id"], "ts", "det_key", min_side(box()) * F.col("sharpness"))
    return flows.drain(best, "best").withColumn("estimate", F.round("estimate", 6))


@query("stream_consensus", check_sql("""
, v AS (SELECT track_id, id, entity_id, similarity, epoch_us(ts)/1e6 AS second,
  coalesce(entity_id<>'' AND entity_id<>'unknown', false) AS known FROM sightings),
s AS (SELECT *, min(second) OVER (PARTITION BY track_id) AS began,
  sum(CASE WHEN known THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY second, id ROWS UNBOUNDED PRECEDING) AS votes_so_far FROM v),
d AS (SELECT track_id, min(second) AS decided_at FROM s WHERE second>=began+864000 OR votes_so_far>=5 GROUP BY 1),
e AS (SELECT s.track_id, entity_id, max(similarity) AS sim, min(second) AS first, count(*) AS votes
  FROM s JOIN d USING (track_id) WHERE known AND second<=decided_at GROUP BY 1,2),
w AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY sim DESC, first) AS rn FROM e)
SELECT d.track_id, coalesce(w.entity_id,'unknown') AS entity_id, coalesce(w.sim,0) AS similarity, coalesce(w.votes,0) AS votes
FROM d LEFT JOIN w ON w.track_id=d.track_id AND w.rn=1""", "sightings"))
def stream_consensus(spark, sf):
    p = TrackParams(vote_window_seconds=864000.0, vote_limit=5, idle_seconds=30 * 86400.0)
    rows = sighting_stream(spark, sf).select("track_id", "id", "entity_id", "similarity", "ts")
    return flows.drain(state.consensus(rows, ["track_id"], "ts", "id", p=p), "consensus")


@query("stream_tracks", CHECKS["track_stitch"])
def stream_tracks(spark, sf):
    rows = views.detections(spark, sf).withColumn("ts", F.timestamp_micros(F.col("frame_id") * 125_000 + START))
    stream = staged_stream(spark, rows, "detections")
    return flows.drain(state.track_frames(stream, "source_id", "frame_id", "det_key", "ts"), "tracks")


def timed_batches(spark, df, ts, edges, name, files=8):
    """A table as a stream of micro-batches in time order: ``edges`` cut it."""
    path = scratch_path(spark, name)
    for low, high in zip([None, *edges], [*edges, None]):
        rows = df.where((F.lit(True) if low is None else F.col(ts) >= low) & (F.lit(True) if high is None else F.col(ts) < high))
        rows.repartition(files).write.mode("append").parquet(path)
    return flows.file_stream(spark, path, df.schema, files_per_batch=files)


FEED_CHECK = rq.cooldown_check("entity_id", 86400, "id", strict=True).rpartition("SELECT")[0] + """
SELECT 'attendance' AS feed, id, entity_id, CAST(0 AS BIGINT) AS record_no, similarity AS value FROM walk JOIN k USING (id)
UNION ALL SELECT 'alerts', id, entity_id, row_number() OVER (ORDER BY id), similarity FROM k
UNION ALL SELECT 'visits', id, entity_id, 0, 0 FROM k"""


@query("stream_rules", FEED_CHECK)
def stream_rules(spark, sf):
    """All three feeds over four micro-batches, in time order."""
    feeds = rules.default_rules(24 * HOUR).enabled({n: {"enabled": True} for n in ("attendance", "alerts", "visits")}, active="")
    log = views.sightings(spark, sf).select("id", "entity_id", "name", "similarity", "ts")
    edges = [F.to_timestamp(F.lit(f"2024-01-{d:02d} 00:00:00")) for d in (8, 16, 24)]
    path, failed = flows.rule_stream(timed_batches(spark, log, "ts", edges, "rule-events"), feeds, "rules")
    if failed:
        raise RuntimeError(f"feeds failed: {failed}")
    none = F.lit(0)
    shape = {
        "attendance": (none.cast("long"), F.col("confidence")), "alerts": (F.col("alert_id"), F.col("match_similarity")),
        "visits": (none.cast("long"), none.cast("double")),
    }
    parts = [
        spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("feed"), "id", "entity_id", number.alias("record_no"), value.alias("value"))
        for name, (number, value) in shape.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
