"""Domain views over the star-schema test tables.

The SQL text of each view runs unchanged in Spark and in the check engine, so a
query and its check SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Explicit read schemas: timestamps without zone are read as UTC instants.
TABLES = {
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp"
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "conversations": "conv_id long, turn long, role string, text string",
}

AS_OF = "2024-01-31 00:00:00"

SIGHTINGS = """
SELECT event_id AS id,
  CASE WHEN event_type='error' THEN 'unknown' WHEN event_id%97=0 THEN NULL
       ELSE concat('P_',CAST(user_id AS VARCHAR(20))) END AS entity_id,
  CASE WHEN event_type='error' THEN 'Unknown' ELSE concat('Entity ',CAST(user_id AS VARCHAR(20))) END AS name,
  round(least(value/100, CAST(1 AS DOUBLE)),4) AS similarity,
  concat('cam_',CAST(event_id%7 AS VARCHAR(20)),':',CAST(event_id%20 AS VARCHAR(20))) AS track_id,
  CASE WHEN event_id%7=0 THEN NULL ELSE concat('cam_',CAST(event_id%7 AS VARCHAR(20))) END AS source_id,
  ts
FROM events"""

ENTITIES = """
SELECT concat('P_',CAST(c_custkey AS VARCHAR(20))) AS entity_id, c_custkey AS id, c_name AS name,
  c_mktsegment AS department,
  CASE c_custkey%8 WHEN 0 THEN 'Employee' WHEN 1 THEN 'Visitor' WHEN 2 THEN 'Security' WHEN 3 THEN 'Contractor'
    WHEN 4 THEN 'VIP' WHEN 5 THEN 'Watchlist' WHEN 6 THEN 'Blacklist' ELSE 'Missing Person' END AS role
FROM customer"""

CAPTURES = """
SELECT vec_id AS capture_id, concat('P_',CAST(label AS VARCHAR(20))) AS entity_id,
  vec_id%5=0 AS is_probe, vec_id%11<>0 AS is_active,
  CAST((vec_id*37)%100 AS DOUBLE)/100 AS quality,
  CAST((vec_id*13)%100-50 AS DOUBLE)/100 AS yaw, CAST((vec_id*29)%60-30 AS DOUBLE)/100 AS pitch,
  CAST((vec_id*7)%120 AS DOUBLE) AS blur, CAST((vec_id*17)%256 AS DOUBLE) AS brightness,
  CAST(vec_id AS DOUBLE)*0.4 AS second, vec_id%13<>0 AS has_payload,
  concat('/store/P_',CAST(label AS VARCHAR(20)),'/v',CAST(vec_id AS VARCHAR(20)),'.jpg') AS image_path,
  {embedding} AS embedding
FROM embeddings"""
SPARK_EMBEDDING = "CAST(embedding AS ARRAY<DOUBLE>)"
CHECK_EMBEDDING = "CAST(embedding AS DOUBLE[])"

DETECTIONS = """
SELECT concat('cam_',CAST(l_orderkey%8 AS VARCHAR(20))) AS source_id,
  CAST(floor(l_orderkey/8) AS BIGINT) AS frame_id, CAST(l_linenumber AS BIGINT) AS det_id,
  l_orderkey*8+l_linenumber AS det_key,
  CAST(min(l_partkey)%200 AS DOUBLE) AS x1, CAST(min(l_suppkey)%100 AS DOUBLE) AS y1,
  min(l_partkey)%200+30+min(l_quantity) AS x2, min(l_suppkey)%100+30+min(l_quantity) AS y2,
  round(0.3+min(l_discount)*CAST(6 AS DOUBLE),4) AS score, min(l_extendedprice)/1000 AS sharpness
FROM lineitem GROUP BY l_orderkey, l_linenumber"""

# Detections as rows of tracks: eight frames a second, 25 frames to a track.
TRACK_ROWS = """
SELECT source_id, concat(source_id,':',CAST(CAST(floor(frame_id/25) AS BIGINT)*10+det_id AS VARCHAR(20))) AS track_id,
  CAST(frame_id AS DOUBLE)/8 AS second, det_key, x1, y1, x2, y2, score, sharpness
FROM detections"""

# Five points of the box; the nose is shifted sideways by detection.
LANDMARK_POINTS = """
SELECT source_id, frame_id, det_id, det_key, x1, y1, x2, y2, score, sharpness,
  x1+0.3*(x2-x1) AS lex, y1+0.35*(y2-y1) AS ley, x1+0.7*(x2-x1) AS rex, y1+0.35*(y2-y1) AS rey,
  x1+0.5*(x2-x1)+CAST((det_id*3)%7-3 AS DOUBLE) AS nx, y1+0.55*(y2-y1) AS ny,
  x1+0.35*(x2-x1) AS lmx, y1+0.75*(y2-y1) AS lmy, x1+0.65*(x2-x1) AS rmx, y1+0.75*(y2-y1) AS rmy
FROM detections"""

AUDIT = "SELECT conv_id*1000+turn AS id, role AS action, text AS details FROM conversations"

SOURCES = """
SELECT s_suppkey AS id, concat('cam_',CAST(s_suppkey AS VARCHAR(20))) AS source_id, s_name AS name, n_name AS location,
  s_suppkey%9<>0 AS enabled, CASE WHEN s_suppkey%4=0 THEN 'OFFLINE' ELSE 'ONLINE' END AS status
FROM supplier JOIN nation ON s_nationkey=n_nationkey"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sql: str, **inputs: DataFrame) -> DataFrame:
    """Run view SQL over DataFrames bound by name, without touching the catalog."""
    text = sql
    for name in inputs:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **inputs)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, SIGHTINGS, events=table(spark, sf_dir, "events"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, ENTITIES, customer=table(spark, sf_dir, "customer"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = CAPTURES.replace("{embedding}", SPARK_EMBEDDING)
    return _view(spark, sql, embeddings=table(spark, sf_dir, "embeddings"))


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).where("NOT is_probe")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).where("is_probe")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, DETECTIONS, lineitem=table(spark, sf_dir, "lineitem"))


def track_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, TRACK_ROWS, detections=detections(spark, sf_dir))


def landmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _view(spark, LANDMARK_POINTS, detections=detections(spark, sf_dir))
    return points.selectExpr(
        "source_id", "frame_id", "det_id", "det_key", "x1", "y1", "x2", "y2", "score", "sharpness",
        "array(array(lex,ley),array(rex,rey),array(nx,ny),array(lmx,lmy),array(rmx,rmy)) AS landmarks",
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, AUDIT, conversations=table(spark, sf_dir, "conversations"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(
        spark, SOURCES, supplier=table(spark, sf_dir, "supplier"), nation=table(spark, sf_dir, "nation")
    )


CHECK_VIEWS = {
    "sightings": SIGHTINGS,
    "entities": ENTITIES,
    "captures": CAPTURES.replace("{embedding}", CHECK_EMBEDDING),
    "gallery": "SELECT * FROM captures WHERE NOT is_probe",
    "probes": "SELECT * FROM captures WHERE is_probe",
    "detections": DETECTIONS,
    "track_rows": TRACK_ROWS,
    "landmark_points": LANDMARK_POINTS,
    "audit": AUDIT,
    "sources": SOURCES,
}
CHECK_NEEDS = {
    "gallery": ["captures"], "probes": ["captures"], "track_rows": ["detections"], "landmark_points": ["detections"],
}


def check_sql(body: str, *views: str, recursive: bool = False) -> str:
    """Check SQL: the named views as common table expressions, then ``body``.

    ``body`` may continue the list of expressions when it starts with a comma.
    """
    names: list[str] = []
    for view in views:
        for name in [*CHECK_NEEDS.get(view, []), view]:
            if name not in names:
                names.append(name)
    head = "WITH " + ("RECURSIVE " if recursive else "")
    return head + ",\n".join(f"{n} AS ({CHECK_VIEWS[n].strip()})" for n in names) + "\n" + body.strip()
