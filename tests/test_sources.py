"""Readers, writers, numbering and text expressions."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import schemas
from sightline.functions import text as fx
from sightline.functions.geometry import box, center_distance, iou
from sightline.functions.vector import cosine, dot, l2_normalize, norm
from sightline.operators import registry, reports
from sightline.operators.numbering import dense_ids
from sightline.session import scratch_path
from sightline.sources import sinks, tables


def put(spark, name, text):
    path = scratch_path(spark, name)
    import os

    os.makedirs(path)
    with open(f"{path}/f.json", "w") as f:
        f.write(text)
    return f"{path}/f.json"


def test_source_file(spark):
    items = [
        {"id": "gate", "name": "Gate", "source": "rtsp://x", "username": "u", "password": "p", "fps_limit": 0},
        {"camera_id": "hall", "enabled": False, "rotation": 90},
        {"name": "Third"},
    ]
    df = tables.read_sources(spark, put(spark, "src", json.dumps(items)))
    assert not {"username", "password", "source"} & set(df.columns)
    rows = {r.source_id: r for r in df.collect()}
    assert set(rows) == {"gate", "hall", "cam_03"}
    assert rows["gate"].fps_limit == 15 and rows["gate"].status == "ONLINE"
    assert rows["hall"].status == "OFFLINE" and rows["hall"].name == "Camera hall" and rows["hall"].rotation == 90
    assert rows["cam_03"].location == "Default Location" and rows["cam_03"].id == 3
    empty = tables.read_sources(spark, put(spark, "src", "[]")).collect()
    assert [r.source_id for r in empty] == ["default_cam"]


def test_gallery_map(spark):
    data = {"0": {"person_id": "a", "name": "A", "embedding": [1.0, 2.0]}, "7": {"person_id": "b", "name": "B", "embedding": [0.5]}}
    rows = tables.read_gallery_map(spark, put(spark, "map", json.dumps(data))).orderBy("gallery_id").collect()
    assert [(r.gallery_id, r.entity_id, r.embedding) for r in rows] == [(0, "a", [1.0, 2.0]), (7, "b", [0.5])]


def test_blob_round_trip(spark):
    df = spark.createDataFrame([(1, [0.5, -2.0]), (2, None)], "id long, v array<double>")
    back = df.withColumn("b", tables.encode_embedding(F.col("v"))).withColumn("w", tables.decode_embedding(F.col("b")))
    rows = {r.id: r for r in back.collect()}
    assert rows[1].w == [0.5, -2.0] and bytes(rows[1].b) == np.array([0.5, -2.0], "<f4").tobytes()
    assert rows[2].w is None


def test_extractor_hook(spark):
    images = spark.range(5).withColumn("content", F.lit("x"))

    def model(batches):
        for b in batches:
            yield b[["id"]].assign(embedding=[[float(i)] * 3 for i in b["id"]])

    out = tables.extract_embeddings(images, model, "id long, embedding array<double>")
    assert {r.id: r.embedding for r in out.collect()}[4] == [4.0] * 3


def test_json_lists(spark):
    df = spark.createDataFrame([('["a","b"]',), (None,)], "t string").select(tables.parse_json_list(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [["a", "b"], []]


@pytest.mark.parametrize("span", [3, 1000])
def test_dense_ids(spark, span):
    ids = sorted({(i * 37) % 500 - 100 for i in range(200)})
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = {r.id: r.n for r in dense_ids(df, "id", "n", start=5, span=span).collect()}
    assert got == {i: n + 5 for n, i in enumerate(ids)}


def test_dense_ids_over_sparse_keys(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h")).repartition(5)
    got = dense_ids(df, "h", "n", sparse=True).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.h)] == list(range(5000))


def test_payload_listing(spark):
    path = put(spark, "payload", "x")
    listed = registry.list_payloads(spark, path.rsplit("/", 1)[0]).collect()
    assert len(listed) == 1 and listed[0].image_path.endswith("f.json")


def test_report_range_and_preset():
    now = dt.datetime(2024, 1, 31, 15)
    assert reports.report_range(None, None, now) == (dt.datetime(2024, 1, 25, 15), dt.datetime(2024, 2, 1, 15))
    assert reports.report_range(None, "2024-01-10", now) == (dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 11))
    assert reports.preset_range(7, dt.date(2024, 1, 31)) == ("2024-01-25", "2024-01-31")
    assert reports.csv_name(*reports.report_range("2024-01-01", "2024-01-10", now)) == "recognition_report_20240101_20240110.csv"


def test_day_partitions_prune(spark):
    rows = [(i, f"P_{i}", "n", 0.5, "t", None, dt.datetime(2024, 1, 1 + i % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, entity_id string, name string, similarity double, track_id string, source_id string, ts timestamp")
    path = scratch_path(spark, "log")
    sinks.append_sightings(df, path)
    plan = spark.read.parquet(path).where("day = date'2024-01-03'")
    assert plan.count() == 4
    assert "PartitionFilters: [isnotnull(day" in plan._jdf.queryExecution().toString()


def test_conform_adds_defaults(spark):
    df = spark.createDataFrame([("a", "x")], "entity_id string, extra string")
    out = registry.conform_schema(df, schemas.struct("entities"), {"gallery_version": 1})
    row = out.first()
    assert row.gallery_version == 1 and row.phone is None and out.columns[-1] == "extra"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text(spark):
    lit = F.lit
    r = one(
        spark,
        a=fx.or_default(lit(""), "d"), b=fx.is_known(lit(None).cast("string")), c=fx.basename(lit("/x/y.jpg")),
        d=fx.parse_utc(lit("2024-01-02 03:04:05")), e=fx.parse_utc(lit("2024-01-02T03:04:05+02:00")),
        f=fx.parse_utc(lit("nope")), g=fx.percent_text(lit(0.4525)), h=fx.fixed(lit(0.15), 1),
        i=fx.track_key(lit("cam"), lit(7)), j=fx.remaining_seconds(lit(2), 6), k=fx.progress_percent(lit(5), 6),
        l=fx.full_name(lit("A"), lit(None).cast("string")), m=fx.snapshot_url(lit("/p/q.jpg")),
        n=fx.next_missing(["FRONTAL", "UP"], F.array(lit("FRONTAL"))), o=fx.next_missing(["UP"], F.array(lit("UP"))),
        p=fx.overlay_quality(lit(100.0)), q=fx.to_zone(F.to_timestamp(lit("2024-01-01 00:00:00")), "+02:00"),
    )
    assert (r.a, r.b, r.c, r.g, r.h, r.i, r.j, r.k) == ("d", False, "y.jpg", "45.2%", "0.1", "cam:7", 5, 83)
    assert r.d == dt.datetime(2024, 1, 2, 3, 4, 5) and r.e == dt.datetime(2024, 1, 2, 1, 4, 5) and r.f is None
    assert (r.l, r.m, r.n, r.o, r.p) == ("A", "/faces/snapshots/q.jpg", "UP", None, 1.0)
    assert r.q == dt.datetime(2024, 1, 1, 2)


def test_vectors_and_boxes(spark):
    v, w = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    df = spark.range(1).selectExpr("0D AS x1", "0D AS y1", "2D AS x2", "2D AS y2", "1D AS ox1", "0D AS oy1", "3D AS ox2", "2D AS oy2")
    r = df.select(
        dot(v, w).alias("d"), norm(v).alias("n"), cosine(v, w).alias("c"), l2_normalize(F.array(F.lit(0.0))).alias("z"),
        iou(box(), box("o")).alias("i"), center_distance(box(), box("o"), 3, 4).alias("far"),
    ).first()
    assert (r.d, r.n, r.z) == (24.0, 5.0, [0.0])
    assert abs(r.c - 0.96) < 1e-12 and abs(r.i - 1 / 3) < 1e-12 and abs(r.far - 0.2) < 1e-12


def test_wrong_fallback_is_not_used(spark):
    a = spark.range(2)
    b = spark.range(10, 13)
    assert tables.with_fallback(a, b).count() == 2
    assert tables.with_fallback(a.where("id > 5"), b).count() == 3


def test_repeated_changes_of_a_key_give_one_row(spark):
    old = spark.createDataFrame([("a", "A", 3), ("b", "B", 1)], "entity_id string, name string, gallery_version int")
    changes = spark.createDataFrame([("a", "first", 1), ("a", "last", 2), ("c", "new", 1), ("c", "newer", 2)], "entity_id string, name string, seq int")
    got = registry.upsert_entities(old, changes, order=["seq"]).collect()
    assert sorted((r["entity_id"], r["name"], r["gallery_version"]) for r in got) == [("a", "last", 4), ("b", "B", 1), ("c", "newer", 1)]
    sources = registry.upsert_source(old.withColumnRenamed("entity_id", "source_id"), changes.withColumnRenamed("entity_id", "source_id"), order=["seq"])
    assert sorted((r["source_id"], r["name"]) for r in sources.collect()) == [("a", "last"), ("b", "B"), ("c", "newer")]
    gone = registry.cascade_delete(changes, entities=old)
    assert gone["entities"].count() == 1 and gone["audit"].count() == 2


def test_report_csv_is_in_time_order(spark):
    rows = [(i, "P_1", "n", 0.5, "cam_1", "t", f"2024-01-{1 + (i * 7) % 20:02d} 00:00:00") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, entity_id string, name string, similarity double, source_id string, track_id string, t string")
    df = df.withColumn("ts", F.to_timestamp("t")).drop("t")
    path = sinks.write_report_csv(df.repartition(5), scratch_path(spark, "csv-order"), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31))
    files = sorted(spark.read.text(path).inputFiles())
    times = [r["Timestamp"] for f in files for r in spark.read.option("header", True).csv(f).collect()]
    assert len(times) == 40 and times == sorted(times)
