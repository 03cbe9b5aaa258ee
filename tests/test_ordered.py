"""Order-dependent operators against plain folds, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import ordered
from sightline.operators.ordered import cooldown, gaps, previous_row, sessions, smoothed_rate

BASE = 1_700_000_000_000_000


def make(spark, seed, n=600, span=4000, ties=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(12)}"
        t = rng.randrange(span) * 1_000_000 if ties else rng.randrange(span * 1_000_000)
        rows.append((i, key if rng.random() > 0.05 else None, t))
    df = spark.createDataFrame(rows, "id long, key string, t long").select(
        "id", "key", F.timestamp_micros(F.col("t") + BASE).alias("ts")
    )
    return rows, df


def fold(rows, seconds, strict):
    last, kept = {}, set()
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        away = None if key not in last else t - last[key]
        if away is None or (away > seconds * 1e6 if strict else away >= seconds * 1e6):
            last[key] = t
            kept.add(i)
    return kept


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("bucket", [None, 3, 11, 40, 333])
def test_cooldown_is_the_fold(spark, batch_rows, seed, bucket):
    rows, df = make(spark, seed)
    for seconds, strict in ((10, False), (10, True), (37, False)):
        kept = cooldown(df, ["key"], "ts", seconds, ["id"], strict, bucket_seconds=bucket)
        assert {r.id for r in kept.collect()} == fold(rows, seconds, strict)


def test_cooldown_keeps_every_column(spark):
    _, df = make(spark, 9)
    wide = df.withColumn("extra", F.array(F.lit(1.5))).withColumn("text", F.lit("x"))
    assert cooldown(wide, ["key"], "ts", 10, ["id"]).columns == wide.columns


@pytest.mark.parametrize("bucket", [7, 100, 86400])
def test_gaps_and_previous(spark, bucket):
    rows, df = make(spark, 4, ties=False)
    by_key = {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        by_key.setdefault(key, []).append((t, i))
    want = {(k, a[0], b[0]) for k, v in by_key.items() for a, b in zip(v, v[1:]) if b[0] - a[0] > 25e6}
    got = gaps(df, ["key"], "ts", 25, bucket).select("key", F.unix_micros("gap_start"), F.unix_micros("gap_end")).collect()
    assert {(r[0], r[1] - BASE, r[2] - BASE) for r in got} == {x for x in want}
    before = {b[1]: a[1] for v in by_key.values() for a, b in zip(v, v[1:])}
    for r in previous_row(df, ["key"], "ts", "id", ["id"], bucket).collect():
        assert r.previous_id == before.get(r.id)


@pytest.mark.parametrize("bucket", [7, 100, 86400])
def test_sessions(spark, bucket):
    rows, df = make(spark, 5)
    want, last = {}, {}
    for _, key, t in sorted(rows, key=lambda r: r[2]):
        if key not in last or t - last[key] > 25e6:
            want.setdefault(key, []).append([t, t, 0])
        last[key] = t
        want[key][-1][1] = t
        want[key][-1][2] += 1
    got = {}
    for r in sessions(df, ["key"], "ts", 25, bucket).select(
        "key", F.unix_micros("session_start").alias("a"), F.unix_micros("session_end").alias("b"), "rows"
    ).orderBy("a").collect():
        got.setdefault(r.key, []).append([r.a - BASE, r.b - BASE, r.rows])
    assert got == want


@pytest.mark.parametrize("bucket", [13, 86400])
def test_smoothed_rate(spark, batch_rows, bucket):
    rows, df = make(spark, 6, n=1500)
    state, want = {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        last, rate = state.get(key, (None, 0.0))
        if last is not None and t > last:
            rate = 0.9 * rate + 0.1 * 1e6 / (t - last)
        state[key] = (t, rate)
        want[i] = rate
    got = {r.id: r.rate for r in smoothed_rate(df, ["key"], "ts", ["id"], bucket_seconds=bucket).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("bound", [5, 60])
def test_buckets_fit_the_rows(spark, monkeypatch, bound):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", bound)
    rows, df = make(spark, 3, n=900)
    width = ordered.fitting_width(df, ["key"], "ts", ordered.DAY)
    assert width < ordered.DAY
    counts = df.groupBy("key", F.floor(F.unix_micros("ts") / width)).count().agg(F.max("count")).first()[0]
    assert counts <= bound or width == ordered.MICROS
    kept = cooldown(df, ["key"], "ts", 300, ["id"])
    assert {r.id for r in kept.collect()} == fold(rows, 300, False)
    by_key = {}
    for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
        by_key.setdefault(key, []).append(t)
    want = sum(sum(1 for a, b in zip(v, v[1:]) if b - a > 20e6) + 1 for v in by_key.values())
    assert sessions(df, ["key"], "ts", 20).count() == want
    assert gaps(df, ["key"], "ts", 20).count() == want - len(by_key)


@pytest.mark.parametrize("strict", [False, True])
def test_long_gaps_of_crowded_keys(spark, monkeypatch, strict):
    """A day's gap, a third and more of all rows on one key, and buckets that may hold 25 rows."""
    rng = random.Random(31)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", rng.randrange(20 * 86400) * 1_000_000) for i in range(1500)]
    rows += [(2000 + i, "hot", 86400_000_000 * (i // 2)) for i in range(40)] + [(3000, None, 5)] + [(3001 + i, None, 7_000_000) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, key string, t long").select("id", "key", F.timestamp_micros(F.col("t") + BASE).alias("ts"))
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 25)
    called, widths = [], []
    whole, near = ordered.pointer_cooldown, ordered.next_times
    monkeypatch.setattr(ordered, "pointer_cooldown", lambda *a: called.append(1) or whole(*a))
    monkeypatch.setattr(ordered, "next_times", lambda times, gap, width: widths.append((times, width)) or near(times, gap, width))
    kept = {r.id for r in cooldown(df, ["key"], "ts", 86400, ["id"], strict).collect()}
    assert called and kept == fold([(i, k, t + BASE) for i, k, t in rows], 86400, strict)
    times, width = widths[0]
    fullest = times.groupBy("_k", F.expr(f"_t div {width}L")).count().agg(F.max("count")).first()[0]
    assert fullest <= 25


def test_next_times(spark):
    rng = random.Random(32)
    times = {("a", t) for t in rng.sample(range(3000), 200)} | {("b", 5), ("b", 2900)}
    df = spark.createDataFrame(sorted(times), "_k string, _t long")
    for gap, width in ((1, 7), (50, 20), (400, 1000), (2895, 3)):
        got = {(r["_k"], r["_t"]): r["_next"] for r in ordered.next_times(df, gap, width).collect()}
        want = {(k, t): min((u for j, u in times if j == k and u >= t + gap), default=None) for k, t in times}
        assert got == {key: u for key, u in want.items() if u is not None}
