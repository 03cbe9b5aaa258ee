"""Streams in several micro-batches equal the batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import rules
from sightline.operators.ordered import cooldown
from sightline.operators.overlap import stitch_tracks
from sightline.operators.tracks import best_track_row, consensus_window
from sightline.params import TrackParams
from sightline.session import scratch_path
from sightline.sources import views
from sightline.streaming import flows, state

SF = "/root/testdata/sf0.001"


def in_files(spark, df, order, parts):
    """Write ``df`` as files in time order, one per micro-batch, and stream them."""
    path = scratch_path(spark, "in")
    bounds = [r[0] for r in df.selectExpr(f"percentile(unix_micros({order}), array({','.join(str(i / parts) for i in range(1, parts))}))").collect()][0]
    edges = [None, *[int(b) for b in bounds], None]
    t = F.unix_micros(order)
    for low, high in zip(edges, edges[1:]):
        rows = df.where((F.lit(True) if low is None else t >= low) & (F.lit(True) if high is None else t < high))
        rows.coalesce(1).write.mode("append").parquet(path)
    return flows.file_stream(spark, path, df.schema, files_per_batch=1)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_cooldown(spark):
    log = rules.known_only(views.sightings(spark, SF)).select("id", "entity_id", "ts")
    for hours, strict in ((6, False), (40, True)):
        kept = state.cooldown(in_files(spark, log, "ts", 5), ["entity_id"], "ts", hours * 3600, "id", strict)
        want = cooldown(log, ["entity_id"], "ts", hours * 3600, ["id"], strict)
        assert rows_of(flows.drain(kept, "c"), "id") == rows_of(want, "id")


def test_best_row(spark):
    rows = views.track_rows(spark, SF).withColumn(
        "ts", F.timestamp_micros((F.col("second") * 1_000_000).cast("long") + 1_704_067_200_000_000)
    )
    value = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * F.col("sharpness")
    stream = in_files(spark, rows, "ts", 4)
    got = flows.drain(state.best_row(stream, ["track_id"], "ts", "det_key", value), "b")
    want = {r[0]: r[1] for r in rows_of(best_track_row(rows, ["track_id"], "second", ["det_key"]), "track_id", "det_key")}
    found = {r[0]: r[1] for r in rows_of(got, "track_id", "det_key")}
    assert found.items() <= want.items()
    # Only tracks whose window the watermark has not passed may be missing.
    end = rows.agg(F.max("second")).first()[0]
    late = {r[0] for r in rows_of(rows.groupBy("track_id").agg(F.min("second").alias("s")).where(F.col("s") >= end - 2.3), "track_id")}
    assert set(want) - set(found) <= late


def test_consensus(spark):
    p = TrackParams(vote_window_seconds=86400.0, vote_limit=4, idle_seconds=40 * 86400.0)
    log = views.sightings(spark, SF).select("track_id", "id", "entity_id", "similarity", "ts")
    got = flows.drain(state.consensus(in_files(spark, log, "ts", 5), ["track_id"], "ts", "id", p=p), "v")
    batch = consensus_window(log.withColumn("second", F.unix_micros("ts") / 1e6), ["track_id"], "second", "id", p=p)
    columns = ("track_id", "entity_id", "similarity", "votes")
    assert rows_of(got, *columns) == rows_of(batch, *columns)


def test_tracks(spark):
    rows = views.detections(spark, SF).withColumn(
        "ts", F.timestamp_micros(F.col("frame_id") * 125_000 + 1_704_067_200_000_000)
    )
    got = flows.drain(state.track_frames(in_files(spark, rows, "ts", 4), "source_id", "frame_id", "det_key", "ts"), "t")
    assert rows_of(got, "det_key", "track_id") == rows_of(stitch_tracks(rows), "det_key", "track_id")


def test_gallery_change_shows_in_the_next_batch(spark):
    caps = views.captures(spark, SF).withColumn("ts", F.timestamp_micros((F.col("second") * 1_000_000).cast("long")))
    probes = caps.where("is_probe")
    seen = []

    def gallery():
        seen.append(1)
        return caps.where("NOT is_probe").where(F.lit(len(seen) > 1))

    found = flows.match_stream(in_files(spark, probes, "ts", 2), gallery, "capture_id", "capture_id", "m")
    known = found.where("entity_id <> 'unknown'").count()
    assert len(seen) == 2 and found.count() == probes.count()
    assert known < found.where("similarity > 0").count() + 1


def test_rules_are_isolated_and_replayed(spark):
    feeds = rules.default_rules()

    def broken(batch, start=1):
        raise ValueError("no")

    feeds.register("broken", rules.Feed(broken, number="alert_id"))
    on = feeds.enabled({"broken": {"enabled": True}, "alerts": {"enabled": True}}, active="visits")
    assert sorted(on) == ["alerts", "broken", "visits"]
    log = views.sightings(spark, SF)
    path, failed = flows.rule_stream(in_files(spark, log, "ts", 3), on, "r")
    assert set(failed) == {"broken"}
    assert rows_of(spark.read.parquet(f"{path}/visits"), "id") == rows_of(rules.visits(log), "id")
    want = rows_of(rules.alerts(log), "alert_id", "id")
    assert rows_of(spark.read.parquet(f"{path}/alerts"), "alert_id", "id") == want
    assert set(flows.replay_failed(spark, path, on)) == {"broken"}
    mended = on | {"broken": rules.Feed(rules.alerts, number="alert_id")}
    for _ in range(2):  # the second call finds nothing left to do
        assert flows.replay_failed(spark, path, mended) == {}
        assert rows_of(spark.read.parquet(f"{path}/broken"), "alert_id", "id") == want


def test_attendance_looks_back_over_batches(spark):
    log = views.sightings(spark, SF)
    on = rules.default_rules(40 * 3600.0).enabled({}, active="attendance")
    path, failed = flows.rule_stream(in_files(spark, log.select("id", "entity_id", "name", "similarity", "ts"), "ts", 4), on, "a")
    assert not failed
    assert rows_of(spark.read.parquet(f"{path}/attendance"), "id", "confidence") == rows_of(rules.attendance(log, 40 * 3600.0), "id", "confidence")


@pytest.mark.parametrize("seed", [1])
def test_late_rows_are_suppressed(spark, seed):
    rng = random.Random(seed)
    base = 1_704_067_200_000_000
    rows = [(i, "k", base + i * 1_000_000) for i in range(60)]
    late = [(100, "k", base + 5_000_000)]
    schema = "id long, k string, t long"
    path = scratch_path(spark, "late")
    for part in (rows, late):
        rng.shuffle(part)
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("t")).drop("t")
        df.coalesce(1).write.mode("append").parquet(path)
    stream = flows.file_stream(spark, path, df.schema, files_per_batch=1)
    kept = flows.drain(state.cooldown(stream, ["k"], "ts", 10, "id", delay="1 second"), "late")
    assert rows_of(kept, "id") == [(i,) for i in range(0, 60, 10)]


def test_tables_of_many_files(spark, tmp_path):
    """A table may be a folder; its files come in no order of time and more than a hundred may lie in it."""
    from sightline.plans import all_queries

    for name, files in (("events", 110), ("embeddings", 3)):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        rows.repartition(files, rows.columns[0]).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_cooldown", "stream_match"):
        query = all_queries()[name]
        want = query(spark, SF)
        assert rows_of(query(spark, str(tmp_path)), *want.columns) == rows_of(want, *want.columns)


def test_match_without_files(spark, tmp_path):
    probes = views.probes(spark, SF)
    stream = flows.file_stream(spark, str(tmp_path), probes.schema)
    assert flows.match_stream(stream, lambda: views.gallery(spark, SF), "capture_id", "capture_id", "none").collect() == []


def test_large_staged_tables_come_in_time_order(spark, monkeypatch):
    """Several micro-batches of bounded size give what one gives."""
    from sightline.plans import all_queries, stream_queries

    staged, cut = [], stream_queries.timed_batches
    monkeypatch.setattr(stream_queries, "timed_batches", lambda *a, **o: staged.append(a[3]) or cut(*a, **o))
    for name in ("stream_tracks", "stream_best_row"):
        query = all_queries()[name]
        monkeypatch.setattr(stream_queries, "BATCH_ROWS", 4_000_000)
        want = query(spark, SF)
        monkeypatch.setattr(stream_queries, "BATCH_ROWS", 2_500)
        assert rows_of(query(spark, SF), *want.columns) == rows_of(want, *want.columns)
    assert [len(edges) for edges in staged] == [1, 1]
