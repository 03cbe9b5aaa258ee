"""Queries over the sighting log: reports, histories, timelines, rules, health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sightline.functions import text as fx
from sightline.operators import liveness, reports, rules
from sightline.operators.ordered import cooldown, previous_row, sessions, smoothed_rate
from sightline.params import LivenessParams
from sightline.plans.catalog import query
from sightline.sources import views
from sightline.sources.views import AS_OF, check_sql

HOUR = 3600.0
KNOWN = "coalesce(entity_id<>'' AND entity_id<>'unknown', false)"
SOURCE = "coalesce(source_id,'default')"
STAMP = "'%Y-%m-%d %H:%M:%S'"
RANGE = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def ranged(spark, sf, source=None):
    start, stop = reports.report_range("2024-01-01", "2024-01-30", datetime(2024, 1, 31))
    return reports.in_range(views.sightings(spark, sf), start, stop, source)


@query("report_totals", check_sql(f"""
SELECT count(*) AS total_events, count(*) FILTER ({KNOWN}) AS known_events,
  count(*) FILTER (NOT {KNOWN}) AS unknown_events, count(DISTINCT entity_id) FILTER ({KNOWN}) AS unique_entities
FROM sightings WHERE {RANGE}""", "sightings"))
def report_totals(spark, sf):
    return reports.totals(ranged(spark, sf))


@query("report_totals_default_range", check_sql(f"""
SELECT count(*) AS total_events, count(*) FILTER ({KNOWN}) AS known_events,
  count(*) FILTER (NOT {KNOWN}) AS unknown_events, count(DISTINCT entity_id) FILTER ({KNOWN}) AS unique_entities
FROM sightings WHERE ts >= TIMESTAMP '2024-01-23 12:00:00' AND ts < TIMESTAMP '2024-01-30 12:00:00'
  AND source_id='cam_3'""", "sightings"))
def report_totals_default_range(spark, sf):
    start, stop = reports.report_range(None, None, datetime(2024, 1, 29, 12))
    return reports.totals(reports.in_range(views.sightings(spark, sf), start, stop, "cam_3"))


@query("report_by_source", check_sql(f"""
SELECT {SOURCE} AS source_id, count(*) AS events FROM sightings WHERE {RANGE} GROUP BY 1""", "sightings"))
def report_by_source(spark, sf):
    return reports.by_source(ranged(spark, sf))


@query("report_by_day", check_sql(f"""
SELECT strftime(ts,'%Y-%m-%d') AS day, count(*) AS events FROM sightings WHERE {RANGE} GROUP BY 1""", "sightings"))
def report_by_day(spark, sf):
    return reports.by_day(ranged(spark, sf))


@query("report_top_entities", check_sql(f"""
SELECT entity_id, name, count(*) AS events FROM sightings WHERE {RANGE} AND {KNOWN}
GROUP BY 1,2 ORDER BY events DESC, entity_id, name LIMIT 10""", "sightings"))
def report_top_entities(spark, sf):
    return reports.top_entities(ranged(spark, sf))


@query("report_grouping_sets", check_sql(f"""
SELECT 'source' AS level, {SOURCE} AS key, count(*) AS events FROM sightings WHERE {RANGE} GROUP BY 2
UNION ALL SELECT 'day', strftime(ts,'%Y-%m-%d'), count(*) FROM sightings WHERE {RANGE} GROUP BY 2
UNION ALL SELECT 'entity', entity_id, count(*) FROM sightings WHERE {RANGE} AND {KNOWN} GROUP BY 2
UNION ALL SELECT 'total', 'all', count(*) FROM sightings WHERE {RANGE}""", "sightings"))
def report_grouping_sets(spark, sf):
    return reports.breakdown(ranged(spark, sf))


@query("report_latest_rows", check_sql(f"""
SELECT id, strftime(ts,{STAMP}) AS timestamp, name, {SOURCE} AS source_id,
  printf('%.1f%%', similarity*100) AS similarity
FROM sightings WHERE {RANGE} ORDER BY ts DESC, id DESC LIMIT 50""", "sightings"))
def report_latest_rows(spark, sf):
    return reports.latest_report_rows(ranged(spark, sf))


@query("registered_entities", check_sql("SELECT count(*) AS registered FROM entities", "entities"))
def registered_entities(spark, sf):
    return views.entities(spark, sf).agg(F.count(F.lit(1)).alias("registered"))


SUMMARY = f"""
, agg AS (SELECT entity_id, count(*) AS total_count, round(avg(similarity),6) AS avg_confidence,
  arg_max(name,id) AS last_name, arg_max(ts,id) AS last_ts, arg_max({SOURCE},id) AS last_source,
  arg_min(ts,id) AS first_ts, arg_min({SOURCE},id) AS first_source FROM sightings GROUP BY entity_id),
summary AS (SELECT a.entity_id, CASE WHEN a.entity_id='unknown' THEN 'Unknown Person'
  ELSE coalesce(e.name, a.last_name) END AS name, total_count, avg_confidence,
  strftime(last_ts,{STAMP}) AS last_seen_time, last_source AS last_seen_source,
  strftime(first_ts,{STAMP}) AS first_seen_time, first_source AS first_seen_source
  FROM agg a LEFT JOIN entities e ON a.entity_id=e.entity_id)
SELECT * FROM summary"""


@query("entity_summary", check_sql(SUMMARY, "sightings", "entities"))
def entity_summary(spark, sf):
    return reports.entity_summary(views.sightings(spark, sf), views.entities(spark, sf))


@query("entity_summary_search", check_sql(SUMMARY + """
WHERE contains(lower(concat_ws(' ',name,coalesce(entity_id,''),last_seen_source,first_seen_source)),'cam_3')""",
    "sightings", "entities"))
def entity_summary_search(spark, sf):
    return reports.entity_summary(views.sightings(spark, sf), views.entities(spark, sf), " CAM_3 ")


@query("event_search", check_sql("""
SELECT id, entity_id, name, source_id FROM sightings
WHERE contains(lower(name),'ty 7') OR coalesce(contains(lower(entity_id),'ty 7'),false)
  OR coalesce(contains(lower(source_id),'ty 7'),false)""", "sightings"))
def event_search(spark, sf):
    return reports.search_events(views.sightings(spark, sf), "TY 7").select("id", "entity_id", "name", "source_id")


@query("entity_search", check_sql("""
SELECT entity_id, name, department, role FROM entities WHERE contains(lower(name),'vi')
  OR contains(lower(entity_id),'vi') OR contains(lower(department),'vi') OR contains(lower(role),'vi')""", "entities"))
def entity_search(spark, sf):
    return reports.search_entities(views.entities(spark, sf), "vi").select("entity_id", "name", "department", "role")


@query("hourly_histogram", check_sql(f"""
SELECT CAST(h.hour AS INTEGER) AS hour, count(s.id) AS events, count(s.id) FILTER (NOT {KNOWN}) AS unknown
FROM range(24) h(hour) LEFT JOIN sightings s ON hour(s.ts)=h.hour GROUP BY 1""", "sightings"))
def hourly_histogram(spark, sf):
    return reports.hourly_histogram(views.sightings(spark, sf))


@query("known_ratio", check_sql(f"""
SELECT count(*) FILTER ({KNOWN}) AS known, count(*) FILTER (NOT {KNOWN}) AS unknown,
  round(count(*) FILTER ({KNOWN})*1.0/count(*),6) AS known_share FROM sightings""", "sightings"))
def known_ratio(spark, sf):
    return reports.known_ratio(views.sightings(spark, sf))


EVENT_COLUMNS = f"id, entity_id, name, similarity, track_id, {SOURCE} AS source_id, strftime(ts,{STAMP}) AS recognized_at"


@query("history_page", check_sql(f"""
SELECT {EVENT_COLUMNS} FROM sightings ORDER BY id DESC LIMIT 50 OFFSET 20""", "sightings"))
def history_page(spark, sf):
    return reports.history_page(views.sightings(spark, sf), 50, 20)


@query("history_page_by_time", check_sql(f"""
SELECT {EVENT_COLUMNS} FROM sightings WHERE source_id='cam_2' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 10""", "sightings"))
def history_page_by_time(spark, sf):
    return reports.history_page(views.sightings(spark, sf), 50, 10, source="cam_2", by="ts")


@query("latest_events", check_sql(f"""
SELECT {EVENT_COLUMNS} FROM sightings ORDER BY id DESC LIMIT 200""", "sightings"))
def latest_events(spark, sf):
    return reports.history_page(views.sightings(spark, sf), 200)


@query("audit_page", check_sql("SELECT id, action, details FROM audit ORDER BY id DESC LIMIT 50", "audit"))
def audit_page(spark, sf):
    return reports.audit_page(views.audit(spark, sf), 50, order="id")


@query("csv_projection", check_sql(f"""
SELECT id AS "ID", coalesce(entity_id,'unknown') AS "Entity ID", name AS "Name", printf('%.4f',similarity) AS "Similarity",
  {SOURCE} AS "Source", track_id AS "Track ID", strftime(ts,{STAMP}) AS "Timestamp"
FROM sightings WHERE {RANGE}""", "sightings"))
def csv_projection(spark, sf):
    return reports.csv_rows(ranged(spark, sf))


@query("latest_per_entity", check_sql("""
SELECT entity_id, id, name, similarity, ts FROM (SELECT coalesce(entity_id,'unknown') AS entity_id, id, name, similarity, ts,
  row_number() OVER (PARTITION BY coalesce(entity_id,'unknown') ORDER BY ts DESC, id) AS rn FROM sightings) WHERE rn=1""",
    "sightings"))
def latest_per_entity(spark, sf):
    return reports.latest_per_entity(views.sightings(spark, sf)).select("entity_id", "id", "name", "similarity", "ts")


@query("latest_entities_panel", check_sql("""
SELECT entity_id, id FROM (SELECT coalesce(entity_id,'unknown') AS entity_id, id, ts,
  row_number() OVER (PARTITION BY coalesce(entity_id,'unknown') ORDER BY ts DESC, id) AS rn FROM sightings)
WHERE rn=1 ORDER BY ts DESC, id LIMIT 15""", "sightings"))
def latest_entities_panel(spark, sf):
    return reports.latest_per_entity(views.sightings(spark, sf), 15).select("entity_id", "id")


@query("first_last_per_entity", check_sql("""
SELECT entity_id, min(id) AS first_id, max(id) AS last_id FROM sightings GROUP BY 1""", "sightings"))
def first_last_per_entity(spark, sf):
    return reports.first_last_per_entity(views.sightings(spark, sf))


@query("boundary_events", check_sql("""
, ends AS (SELECT min(id) AS a, max(id) AS b FROM sightings GROUP BY entity_id)
SELECT id, name, similarity FROM sightings WHERE id IN (SELECT a FROM ends UNION SELECT b FROM ends)""", "sightings"))
def boundary_events(spark, sf):
    log = views.sightings(spark, sf)
    return reports.members(log, reports.boundary_ids(log), "id").select("id", "name", "similarity")


@query("entity_lookup", check_sql("SELECT entity_id, name, role FROM entities WHERE entity_id='P_42'", "entities"))
def entity_lookup(spark, sf):
    return reports.lookup(views.entities(spark, sf), "entity_id", "P_42").select("entity_id", "name", "role")


@query("entity_timeline", check_sql(f"""
SELECT entity_id, rn AS position, id, {SOURCE} AS source_id, similarity, track_id, strftime(ts,{STAMP}) AS timestamp
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY id DESC) AS rn FROM sightings WHERE entity_id IS NOT NULL)
WHERE rn<=50""", "sightings"))
def entity_timeline(spark, sf):
    return reports.timeline(views.sightings(spark, sf), 50)


@query("timeline_header", check_sql(f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, id DESC) AS rn FROM sightings
  WHERE entity_id IS NOT NULL)
SELECT entity_id, max(name) FILTER (rn=1) AS name, strftime(max(ts),{STAMP}) AS last_seen,
  count(*) FILTER (rn<=50) AS shown, count(*) AS total,
  array_to_string(list_sort(list(DISTINCT {SOURCE}) FILTER (rn<=50)),',') AS sources
FROM ranked GROUP BY entity_id""", "sightings"))
def timeline_header(spark, sf):
    return reports.timeline_header(views.sightings(spark, sf), 50)


@query("recent_per_source", check_sql("""
SELECT id, source_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, id DESC) AS rn
  FROM sightings) WHERE rn<=20""", "sightings"))
def recent_per_source(spark, sf):
    log = views.sightings(spark, sf).select("id", "source_id", "ts")
    return reports.recent(log, 20, [F.desc("ts"), F.desc("id")], ["source_id"])


@query("event_labels", check_sql(f"""
SELECT id, CASE WHEN similarity>=0.85 THEN 'high' WHEN similarity>=0.70 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN similarity>=0.70 THEN 'RECOGNIZED' WHEN similarity>=0.35 THEN 'POSSIBLE_MATCH' ELSE 'UNKNOWN' END AS status,
  CASE WHEN similarity>0.70 THEN 'MATCH' WHEN similarity>0.55 AND similarity<0.70 THEN 'UNCERTAIN' ELSE 'UNKNOWN' END AS verdict,
  CASE WHEN {KNOWN} THEN 'RECOGNIZED' ELSE 'UNKNOWN' END AS default_status,
  CASE WHEN d<60 THEN concat(d,'s ago') WHEN d<3600 THEN concat(d//60,'m ago') WHEN d<86400 THEN concat(d//3600,'h ago')
    ELSE concat(d//86400,'d ago') END AS age
FROM (SELECT *, greatest(0,CAST(floor((epoch_us(TIMESTAMP '{AS_OF}')-epoch_us(ts))/1000000) AS BIGINT)) AS d FROM sightings)""",
    "sightings"))
def event_labels(spark, sf):
    s = F.col("similarity")
    return views.sightings(spark, sf).select(
        "id", fx.confidence_band(s).alias("band"), fx.match_status(s).alias("status"),
        fx.uncertain_status(s).alias("verdict"), fx.default_status(F.col("entity_id")).alias("default_status"),
        fx.age_text(F.col("ts"), as_of()).alias("age"),
    )


@query("name_parts", check_sql("""
SELECT entity_id, split_part(concat(name,' ',department,' x'),' ',1) AS first_name,
  array_to_string(string_split(concat(name,' ',department,' x'),' ')[2:],' ') AS last_name FROM entities""", "entities"))
def name_parts(spark, sf):
    name = F.concat("name", F.lit(" "), "department", F.lit(" x"))
    return views.entities(spark, sf).select(
        "entity_id", fx.first_word(name).alias("first_name"), fx.after_first_word(name).alias("last_name")
    )


# ------------------------------------------------------------------- rule feeds


def cooldown_check(keys: str, seconds: int, columns: str, strict: bool = False, where: str = KNOWN) -> str:
    """Follow each kept row to the key's next row at or past the gap."""
    gap = seconds * 1_000_000 + (1 if strict else 0)
    present = " AND ".join(f"{x} IS NOT NULL" for x in keys.split(","))
    return check_sql(f"""
, k AS (SELECT *, epoch_us(ts) AS us FROM sightings WHERE {where} AND {present}),
nxt AS (SELECT id, first_value(id) OVER (PARTITION BY {keys} ORDER BY us
  RANGE BETWEEN {gap} FOLLOWING AND UNBOUNDED FOLLOWING) AS nid FROM k),
walk AS (SELECT arg_min(id,ts) AS id FROM k GROUP BY {keys}
  UNION ALL SELECT nid FROM walk JOIN nxt USING (id) WHERE nid IS NOT NULL)
SELECT {columns} FROM walk JOIN k USING (id)""", "sightings", recursive=True)


@query("cooldown_source_entity", cooldown_check("source_id,entity_id", 43200, "id, source_id, entity_id"))
def cooldown_source_entity(spark, sf):
    rows = rules.known_only(views.sightings(spark, sf)).where("source_id IS NOT NULL").select("id", "source_id", "entity_id", "ts")
    return cooldown(rows, ["source_id", "entity_id"], "ts", 12 * HOUR, ["id"]).select("id", "source_id", "entity_id")


@query("cooldown_track_entity", cooldown_check("track_id,entity_id", 864000, "id, track_id, entity_id"))
def cooldown_track_entity(spark, sf):
    rows = rules.known_only(views.sightings(spark, sf)).select("id", "track_id", "entity_id", "ts")
    return cooldown(rows, ["track_id", "entity_id"], "ts", 240 * HOUR, ["id"]).select("id", "track_id", "entity_id")


@query("cooldown_source", cooldown_check("source_id", 3600, "id, source_id", where="true"))
def cooldown_source(spark, sf):
    rows = views.sightings(spark, sf).where("source_id IS NOT NULL").select("id", "source_id", "ts")
    return cooldown(rows, ["source_id"], "ts", HOUR, ["id"], bucket_seconds=9 * HOUR).select("id", "source_id")


@query("attendance", cooldown_check("entity_id", 86400, f"""id, entity_id, name, 'ENTRY_LOG' AS type,
strftime(ts,{STAMP}) AS timestamp, similarity AS confidence""", strict=True))
def attendance(spark, sf):
    return rules.attendance(views.sightings(spark, sf), 24 * HOUR)


ALERTS = f"""
SELECT row_number() OVER (ORDER BY id) AS alert_id, id, entity_id, name, 'WATCHLIST_MATCH' AS alert_type,
  strftime(ts,{STAMP}) AS timestamp, similarity AS match_similarity, 'ACTIVE_ALERT' AS status
FROM sightings WHERE {KNOWN}"""


@query("alerts", check_sql(ALERTS, "sightings"))
def alerts(spark, sf):
    return rules.alerts(views.sightings(spark, sf))


@query("alerts_watchlist", check_sql(ALERTS + """
AND entity_id IN (SELECT entity_id FROM entities WHERE role IN ('Watchlist','Blacklist','Missing Person'))""",
    "sightings", "entities"))
def alerts_watchlist(spark, sf):
    roles = ["Watchlist", "Blacklist", "Missing Person"]
    return rules.alerts(views.sightings(spark, sf), views.entities(spark, sf), roles)


@query("visits", check_sql(f"""
SELECT id, entity_id, name, 'VIP_CUSTOMER' AS category, strftime(ts,{STAMP}) AS timestamp
FROM sightings WHERE {KNOWN}""", "sightings"))
def visits(spark, sf):
    return rules.visits(views.sightings(spark, sf))


@query("rule_counts", cooldown_check("entity_id", 86400, "id", strict=True).rpartition("SELECT")[0] + f"""
SELECT 'alerts' AS feed, count(*) AS records FROM sightings WHERE {KNOWN}
UNION ALL SELECT 'visits', count(*) FROM sightings WHERE {KNOWN}
UNION ALL SELECT 'attendance', count(*) FROM walk""")
def rule_counts(spark, sf):
    log = views.sightings(spark, sf)
    return reports.rule_counts(alerts=rules.alerts(log), visits=rules.visits(log), attendance=rules.attendance(log, 24 * HOUR))


# ---------------------------------------------------------------- source health

LIVE = LivenessParams(active_seconds=1800.0, healthy_seconds=7200.0)
LIVE_CHECK = f"""
, live AS (SELECT source_id, (epoch_us(TIMESTAMP '{AS_OF}')-epoch_us(max(ts)))/1e6 AS age FROM sightings
  WHERE source_id IS NOT NULL GROUP BY 1)
"""


@query("source_liveness", check_sql(LIVE_CHECK + """
SELECT source_id, round(age,2) AS age_seconds, age<1800 AS is_active, age<7200 AS is_healthy,
  CASE WHEN age<7200 THEN 'ONLINE' ELSE 'RECONNECTING' END AS status FROM live""", "sightings"))
def source_liveness(spark, sf):
    return liveness.liveness(views.sightings(spark, sf), as_of(), p=LIVE)


@query("source_live_status", check_sql(LIVE_CHECK + """
SELECT s.id, s.source_id, s.name, coalesce(l.age<1800,false) AS is_active
FROM sources s LEFT JOIN live l ON s.source_id=l.source_id""", "sightings", "sources"))
def source_live_status(spark, sf):
    live = liveness.liveness(views.sightings(spark, sf), as_of(), p=LIVE)
    return liveness.with_live_status(views.sources(spark, sf), live).select("id", "source_id", "name", "is_active")


@query("source_outages", check_sql("""
SELECT source_id, gap_start, gap_end, gap_seconds, floor(gap_seconds/300)>18 AS is_long FROM (
  SELECT source_id, lag(ts) OVER w AS gap_start, ts AS gap_end,
    (epoch_us(ts)-epoch_us(lag(ts) OVER w))/1e6 AS gap_seconds
  FROM sightings WHERE source_id IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY ts)) WHERE gap_seconds>3600""",
    "sightings"))
def source_outages(spark, sf):
    return liveness.outages(views.sightings(spark, sf), HOUR, check_seconds=300.0)


@query("source_latest", check_sql("""
SELECT source_id, id, name, ts FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, id DESC) AS rn
  FROM sightings WHERE source_id IS NOT NULL) WHERE rn=1""", "sightings"))
def source_latest(spark, sf):
    return liveness.latest_per_source(views.sightings(spark, sf).select("source_id", "id", "name", "ts"))


@query("source_rate_ema", check_sql("""
, n AS (SELECT id, source_id, row_number() OVER w AS rn,
  0.1*1e6/(epoch_us(ts)-epoch_us(lag(ts) OVER w)) AS gain
  FROM sightings WHERE source_id IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY ts, id)),
walk AS (SELECT id, source_id, rn, CAST(0 AS DOUBLE) AS rate FROM n WHERE rn=1
  UNION ALL SELECT n.id, n.source_id, n.rn, 0.9*w.rate+n.gain FROM walk w JOIN n ON n.source_id=w.source_id AND n.rn=w.rn+1)
SELECT id, source_id, round(rate,9) AS rate FROM walk""", "sightings", recursive=True))
def source_rate_ema(spark, sf):
    rows = views.sightings(spark, sf).where("source_id IS NOT NULL").select("id", "source_id", "ts")
    return smoothed_rate(rows, ["source_id"], "ts", ["id"]).select("id", "source_id", F.round("rate", 9).alias("rate"))


@query("rate_sample", check_sql("""
SELECT source_id, arg_min(id, ts) AS id, min(ts) AS ts FROM sightings WHERE source_id IS NOT NULL
GROUP BY source_id, epoch_us(ts)//3600000000""", "sightings"))
def rate_sample(spark, sf):
    rows = views.sightings(spark, sf).where("source_id IS NOT NULL").select("source_id", "id", "ts")
    return liveness.rate_sample(rows, ["source_id"], "ts", 1 / HOUR, "id")


@query("previous_similarity", check_sql("""
SELECT id, source_id, lag(similarity) OVER (PARTITION BY source_id ORDER BY ts, id) AS previous_similarity
FROM sightings WHERE source_id IS NOT NULL""", "sightings"))
def previous_similarity(spark, sf):
    rows = views.sightings(spark, sf).where("source_id IS NOT NULL").select("id", "source_id", "ts", "similarity")
    return previous_row(rows, ["source_id"], "ts", "similarity", ["id"]).select("id", "source_id", "previous_similarity")


@query("entity_sessions", check_sql("""
, f AS (SELECT entity_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts-lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS o
  FROM sightings WHERE entity_id IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY ts)),
n AS (SELECT entity_id, ts, sum(o) OVER (PARTITION BY entity_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT entity_id, CAST(k AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS rows
FROM n GROUP BY entity_id, k""", "sightings"))
def entity_sessions(spark, sf):
    rows = views.sightings(spark, sf).where("entity_id IS NOT NULL")
    return sessions(rows, ["entity_id"], "ts", 6 * HOUR)


@query("track_sessions", check_sql("""
, f AS (SELECT track_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts-lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS o
  FROM sightings WINDOW w AS (PARTITION BY track_id ORDER BY ts)),
n AS (SELECT track_id, ts, sum(o) OVER (PARTITION BY track_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT track_id, CAST(k AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS rows
FROM n GROUP BY track_id, k""", "sightings"))
def track_sessions(spark, sf):
    return sessions(views.sightings(spark, sf), ["track_id"], "ts", 12 * HOUR)


@query("source_search", check_sql("""
SELECT id, source_id, name, location FROM sources WHERE (contains(lower(name),'0001') OR contains(lower(source_id),'0001')
  OR contains(lower(location),'0001')) AND enabled AND status<>'OFFLINE'""", "sources"))
def source_search(spark, sf):
    found = liveness.search_sources(views.sources(spark, sf), "0001", "online")
    return found.select("id", "source_id", "name", "location")


@query("source_online_counts", check_sql("""
SELECT count(*) FILTER (enabled AND status<>'OFFLINE') AS online, count(*) AS total FROM sources""", "sources"))
def source_online_counts(spark, sf):
    return liveness.online_counts(views.sources(spark, sf))


@query("source_online_first", check_sql("""
SELECT id, source_id, enabled AND status<>'OFFLINE' AS is_online FROM sources ORDER BY is_online DESC, id LIMIT 4""", "sources"))
def source_online_first(spark, sf):
    return liveness.online_first(views.sources(spark, sf)).select("id", "source_id", "is_online")


@query("source_duplicate_names", check_sql("""
, s AS (SELECT source_id, upper(location) AS name FROM sources)
SELECT source_id, name FROM s WHERE EXISTS
  (SELECT 1 FROM s b WHERE lower(b.name)=lower(s.name) AND b.source_id<>s.source_id)""", "sources"))
def source_duplicate_names(spark, sf):
    named = views.sources(spark, sf).select("source_id", F.upper("location").alias("name"))
    return liveness.duplicate_names(named)
