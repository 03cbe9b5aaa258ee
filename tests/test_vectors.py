"""Similarity join, greedy keep and box joins against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import kernels
from sightline.operators.candidates import first_independent, merge_candidates
from sightline.operators.greedy import deduplicate, fill_buffer, greedy_keep, suppress_boxes
from sightline.operators.overlap import iou_pairs, overlap_pairs
from sightline.operators.similarity import lsh_topk, similarity_topk


def vectors(spark, n, d=8, seed=0, copies=0.0, keys=3):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, d))
    for i in range(1, n):
        if rng.random() < copies:
            m[i] = m[0]
    # the first key holds most rows
    key = [0 if rng.random() < 0.6 else int(rng.integers(1, keys)) for _ in range(n)]
    rows = [(i, f"e{key[i]}", float(i % 7), m[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, entity_id string, quality double, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    return df, unit, [f"e{k}" for k in key]


def brute(q, qk, g, gk, k, floor, same=False, other=False, not_self=False):
    out = {}
    for i in range(len(q)):
        sims = np.round(g @ q[i], 12)
        hits = [
            (-sims[j], j) for j in range(len(g))
            if sims[j] >= floor and (not same or gk[j] == qk[i]) and (not other or gk[j] != qk[i]) and (not not_self or i != j)
        ]
        if hits:
            out[i] = [j for _, j in sorted(hits)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("rank").collect():
        out.setdefault(r.id, []).append(r.match_id)
    return out


@pytest.mark.parametrize("block", [7, 1000])
@pytest.mark.parametrize("copies", [0.0, 0.4])
def test_topk(spark, batch_rows, block, copies):
    q, qm, qk = vectors(spark, 40, seed=1)
    g, gm, gk = vectors(spark, 90, seed=2, copies=copies)
    assert found(similarity_topk(q, g, "id", "id", 4, 0.2, block_rows=block)) == brute(qm, qk, gm, gk, 4, 0.2)
    assert found(similarity_topk(q, g, "id", "id", 4, 0.2, block_rows=block, lane_rows=3)) == brute(qm, qk, gm, gk, 4, 0.2)
    other = similarity_topk(q, g, "id", "id", 4, 0.2, query_label="entity_id", exclude_label=True, block_rows=block)
    assert found(other) == brute(qm, qk, gm, gk, 4, 0.2, other=True)
    same = similarity_topk(g, g, "id", "id", 2, -1.0, by="entity_id", exclude_id=True, block_rows=block)
    assert found(same) == brute(gm, gk, gm, gk, 2, -1.0, same=True, not_self=True)


@pytest.mark.parametrize("block", [7, 1000])
def test_best_labels(spark, block):
    q, qm, _ = vectors(spark, 30, seed=3)
    g, gm, gk = vectors(spark, 80, seed=4, keys=6)
    want = {}
    for i in range(30):
        best = {}
        for j, s in enumerate(np.round(gm @ qm[i], 12)):
            if s >= 0 and (gk[j] not in best or s > best[gk[j]]):
                best[gk[j]] = s
        want[i] = sorted(best, key=lambda e: -best[e])[:3]
    got = {}
    for r in similarity_topk(q, g, "id", "id", 3, 0.0, per_label=True, block_rows=block).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.match_label)
    assert got == want


def test_approximate_hits_are_exact_and_mostly_complete(spark):
    q, qm, qk = vectors(spark, 60, d=16, seed=5)
    g, gm, gk = vectors(spark, 300, d=16, seed=6)
    got = found(lsh_topk(q, g, "id", "id", 3, 0.5, block_rows=20))
    want = brute(qm, qk, gm, gk, 3, 0.5)
    for i, hits in got.items():
        assert len(hits) == len(set(hits))
        assert all(gm[j] @ qm[i] >= 0.5 - 1e-9 for j in hits)
    close = sum(len(set(got.get(i, [])) & set(h)) for i, h in want.items())
    assert close >= 0.8 * sum(len(h) for h in want.values())


def greedy(unit, keys, order, threshold, cap=None):
    kept = {}
    for i in order:
        mine = kept.setdefault(keys[i], [])
        if (cap is None or len(mine) < cap) and all(round(float(unit[i] @ unit[j]), 12) < threshold for j in mine):
            mine.append(i)
    return {i for v in kept.values() for i in v}


@pytest.mark.parametrize("block", [9, 10_000])
@pytest.mark.parametrize("copies", [0.0, 0.5])
def test_deduplicate(spark, batch_rows, block, copies):
    df, unit, keys = vectors(spark, 150, seed=7, copies=copies)
    order = sorted(range(150), key=lambda i: (-(i % 7), i))
    got = {r.id for r in deduplicate(df, ["entity_id"], "id", threshold=0.4, block_rows=block, lanes=3).collect()}
    assert got == greedy(unit, keys, order, 0.4)


@pytest.mark.parametrize("block", [9, 10_000])
def test_buffer_stops_at_capacity(spark, block):
    df, unit, keys = vectors(spark, 150, seed=8)
    got = fill_buffer(df, ["entity_id"], "id", "id", threshold=0.5, capacity=6, block_rows=block, lanes=3)
    assert {r.id for r in got.collect()} == greedy(unit, keys, range(150), 0.5, cap=6)


def test_rows_without_vector_are_dropped(spark):
    df, _, _ = vectors(spark, 20, seed=9)
    holes = df.withColumn("embedding", F.when(F.col("id") % 4 != 0, F.col("embedding")))
    kept = greedy_keep(
        holes, ["entity_id"], [F.asc("id")], F.col("embedding"), kernels.VectorConflict(0.99), "id"
    )
    assert all(r.id % 4 for r in kept.collect())


@pytest.mark.parametrize("block", [11, 10_000])
def test_merge_candidates(spark, block):
    df, unit, _ = vectors(spark, 120, seed=10)
    openers, want = [], {}
    for i in range(120):
        best = max(openers, key=lambda j: (round(float(unit[i] @ unit[j]), 12), -j), default=None)
        if best is not None and unit[i] @ unit[best] > 0.5:
            want[i] = best
        else:
            openers.append(i)
            want[i] = i
    got = merge_candidates(df, "id", "id", 0.5, block_rows=block)
    assert {r.id: r.candidate for r in got.collect()} == want


def boxes(spark, n, seed, copies=0.2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w, h = (rng.choice([5.0, 40.0, 300.0, 900.0]) * rng.uniform(0.8, 1.2) for _ in range(2))
        x, y = rng.uniform(-60, 500, 2)
        b = (x, y, x + w, y + h)
        if i and rng.random() < copies:
            b = rows[-1][2:6]
        rows.append((i, "hot" if rng.random() < 0.6 else "cold", *map(float, b), float(rng.integers(0, 5))))
    return rows, spark.createDataFrame(rows, "id long, f string, x1 double, y1 double, x2 double, y2 double, score double")


def iou(a, b):
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if inter > 0 else 0.0


@pytest.mark.parametrize("cell", [50.0, 128.0, 2000.0])
def test_box_pairs(spark, cell):
    rows, df = boxes(spark, 80, 1)
    want = {
        (a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and iou(a[2:6], b[2:6]) >= 0.1
    }
    pairs = overlap_pairs(df, df, ["f"], 0.1, ["id"], cell).collect()
    assert len(pairs) == len(want)
    assert {(r.left_id, r.right_id) for r in pairs} == want
    assert {(r.left_id, r.right_id) for r in iou_pairs(df, ["f"], "id", 0.1).collect()} == {p for p in want if p[0] < p[1]}


@pytest.mark.parametrize("block", [7, 10_000])
def test_suppress_boxes(spark, block):
    rows, df = boxes(spark, 120, 2, copies=0.4)
    kept = {}
    for r in sorted(rows, key=lambda r: (-r[6], r[0])):
        mine = kept.setdefault(r[1], [])
        if all(iou(r[2:6], k[2:6]) < 0.4 for k in mine):
            mine.append(r)
    got = suppress_boxes(df, ["f"], F.col("score"), "id", block_rows=block, lanes=3).collect()
    assert {r.id for r in got} == {r[0] for v in kept.values() for r in v}


def test_lanes_grow_with_the_queries(spark):
    q, _, _ = vectors(spark, 200, seed=3)
    g, _, _ = vectors(spark, 30, seed=4)
    lanes = similarity_topk(q, g, "id", "id", 1, -1.0, block_rows=10, lane_rows=5)
    plan = lanes._jdf.queryExecution().executedPlan().toString()
    # 3 blocks x 40 lanes: one cell per task.
    assert ", 120)" in plan or ",120" in plan.replace(" ", "")


@pytest.mark.parametrize("block", [4, 1000])
def test_merge_with_equal_times(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 8))
    m = [base[int(rng.integers(0, 6))] + 0.35 * rng.standard_normal(8) for _ in range(60)]
    rows = [(int(i), float(i // 6), v.tolist()) for i, v in zip(rng.permutation(60), m)]
    df = spark.createDataFrame(rows, "id long, t double, embedding array<double>")
    opened, want = [], {}
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        u = np.array(v) / np.linalg.norm(v)
        best = max(((round(float(u @ w), 12), -j) for j, w in opened), default=(-1.0, 0))
        if best[0] > 0.75:
            want[i] = -best[1]
        else:
            opened.append((i, u))
            want[i] = i
    got = merge_candidates(df, "id", "t", threshold=0.75, block_rows=block)
    assert {r["id"]: r["candidate"] for r in got.collect()} == want


def test_one_group_of_100_000_rows_settles_in_rounds(spark, caplog):
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(1500, 12))
    rows = (centres[rng.integers(0, 1500, 100_000)] + 0.2 * rng.normal(size=(100_000, 12))).round(4)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    kept = np.zeros((100_000, 12))
    places = []
    for i, v in enumerate(unit):  # the plain walk
        if not len(places) or (kept[: len(places)] @ v).max() < 0.9:
            kept[len(places)] = v
            places.append(i)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(100_000), "embedding": list(rows)}), "id long, embedding array<double>").repartition(8)
    with caplog.at_level("INFO"):
        got = [r["id"] for r in first_independent(df, "id", "id", 0.9).select("id").collect()]
    assert sorted(got) == places
    assert 2 <= sum("round" in m for m in caplog.messages) < 40


def test_shuffled_rows_grow_with_the_sides():
    """Vectors that are shuffled per row of input: no more on a gallery sixty times as large."""
    from sightline.operators.similarity import grid

    def copies(gallery, queries, block):
        parts, lanes = grid(gallery, queries, 64, 12, block_rows=block)
        assert gallery / parts <= 2 * 65_536
        return (parts * queries + lanes * gallery) / (gallery + queries)

    for block in (100, 150, 32_768):
        assert copies(984_000, 246_000, block) <= 8
        assert copies(984_000, 246_000, block) <= 2.5 * copies(16_400, 4_100, block)


def test_equal_vectors_are_one_search(spark):
    """Tracks that share a vector, or have none, each get the decision."""
    from sightline.operators.tracks import recognise_tracks
    from sightline.params import MatchParams

    gallery, _, _ = vectors(spark, 30, seed=21)
    some = gallery.where("id < 3").select("id", "embedding")
    best = some.crossJoin(spark.range(5).withColumnRenamed("id", "copy")).selectExpr("id * 10 + copy AS det_key", "embedding")
    best = best.unionByName(spark.createDataFrame([(99, None)], best.schema))
    got = recognise_tracks(best, gallery, "det_key", "id", F.lit(1.0), p=MatchParams(accept=0.9, floor=0.5)).collect()
    keys = {r.id: r.entity_id for r in gallery.collect()}
    assert {r.det_key: r.entity_id for r in got} == {i * 10 + c: keys[i] for i in range(3) for c in range(5)} | {99: "unknown"}
    assert {r.det_key: r.similarity for r in got}[99] == 0.0


def test_candidates_meet_the_kept_rows_and_not_each_other(spark, monkeypatch):
    """pairs of rows compared stay far below the square of the table."""
    from sightline.operators import candidates

    rng = np.random.default_rng(31)
    n, centres = 12_000, rng.normal(size=(40, 12))
    rows = (centres[rng.integers(0, 40, n)] + 0.1 * rng.normal(size=(n, 12))).round(4)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    places = []
    for i, v in enumerate(unit):
        if not places or (unit[places] @ v).max() < 0.9:
            places.append(i)
    compared, search = [], candidates.similarity_topk

    def counted(queries, gallery, *args, **options):
        compared.append(queries.count() * gallery.count())
        return search(queries, gallery, *args, **options)

    monkeypatch.setattr(candidates, "similarity_topk", counted)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "embedding": list(rows)}), "id long, embedding array<double>").repartition(8)
    got = [r["id"] for r in first_independent(df, "id", "id", 0.9).select("id").collect()]
    assert sorted(got) == places
    assert sum(compared) < n * n / 4
