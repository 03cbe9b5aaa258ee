"""Frame linking and stitching against a plain tracker that walks one frame after the other."""

import random
from collections import defaultdict

import pytest

from sightline.operators.overlap import frame_links, track_ids
from sightline.params import TrackParams

P = TrackParams()


def share(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0.0) * max(h, 0.0)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def plain_tracker(rows):
    """(links, track of each row); rows are (source, frame, id, score, box)."""
    frames, links, tracks = defaultdict(list), {}, {}
    for s, f, i, score, box in rows:
        if score >= P.low_score:
            frames[s, f].append((i, score, box))
    for s, f in sorted(frames):
        old = [(i, b) for i, _, b in sorted(frames.get((s, f - 1), [])) if i in tracks]
        new, free = sorted(frames[s, f]), {i for i, _ in old}
        for band in ("high", "low"):
            here = [(i, b) for i, score, b in new if (score >= P.high_score) == (band == "high")]
            least = P.high_iou if band == "high" else P.low_iou
            pairs = sorted((-share(b, c), i, j) for i, b in old for j, c in here if share(b, c) >= least)
            for v, i, j in pairs:
                if i in free and j not in tracks:
                    free.remove(i)
                    links[i, j] = (band, round(-v, 9))
                    tracks[j] = tracks[i]
        for i, score, _ in new:
            if i not in tracks and score >= max(P.new_score, P.high_score):
                tracks[i] = f"{s}:{i}"
    return links, tracks


def crowd(seed, frames=60):
    rng, rows, i = random.Random(seed), [], 0
    for source in ("a", "b"):
        for f in range(frames):
            if rng.random() < 0.06:
                continue
            for _ in range(rng.randint(1, 9)):
                x, y = rng.choice([0, 10, 25, 40, 80]) + rng.randint(0, 6), rng.choice([0, 15, 60])
                box = (float(x), float(y), float(x + 30), float(y + 30))
                for _ in range(rng.choice([1, 1, 1, 3])):
                    rows.append((source, f, i, rng.choice([0.05, 0.2, 0.3, 0.36, 0.38, 0.5, 0.9]), box))
                    i += 1
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame(
        [(s, f, i, score, *box) for s, f, i, score, box in rows],
        "source_id string, frame_id long, det_key long, score double, x1 double, y1 double, x2 double, y2 double",
    )


@pytest.mark.parametrize("seed,bucket,warm", [(1, 4, 1), (2, 7, 7), (3, 512, 16), (4, 2, 1)])
def test_crowded_frames(spark, seed, bucket, warm):
    rows = crowd(seed)
    links, tracks = plain_tracker(rows)
    df = frame_of(spark, rows)
    got = frame_links(df, bucket_frames=bucket, warm_frames=warm).collect()
    assert {(r["prev_det_key"], r["next_det_key"]): (r["band"], round(r["iou"], 9)) for r in got} == links
    assert {r["det_key"]: r["track_id"] for r in track_ids(df, bucket_frames=bucket, warm_frames=warm).collect()} == tracks


def test_copies_are_all_linked(spark):
    box = (0.0, 0.0, 30.0, 30.0)
    df = frame_of(spark, [("a", f, 10 * f + k, 0.9, box) for f in (1, 2) for k in range(3)])
    assert {(r["prev_det_key"], r["next_det_key"]) for r in frame_links(df).collect()} == {(10 + k, 20 + k) for k in range(3)}


def test_only_tracks_stand_on_the_previous_side(spark):
    a, b, c = (0.0, 0.0, 30.0, 30.0), (4.0, 0.0, 34.0, 30.0), (3.0, 0.0, 33.0, 30.0)
    df = frame_of(spark, [("a", 1, 1, 0.9, a), ("a", 1, 2, 0.36, b), ("a", 2, 3, 0.9, c)])
    assert {r["det_key"]: r["track_id"] for r in track_ids(df).collect()} == {1: "a:1", 3: "a:1"}


def test_few_boxes_link_as_many_do(monkeypatch):
    """The walk over a handful of boxes gives what the arrays give, in a fraction of the time."""
    import time

    import numpy as np

    from sightline.operators import kernels

    rng = np.random.default_rng(3)
    frames = []
    for k in range(4000):
        corner = rng.integers(0, 25, (5, 2)).astype(float)
        frames.append((k, [k * 8 + j for j in range(5)], rng.choice([0.05, 0.2, 0.35, 0.4, 0.9], 5), np.hstack([corner, corner + rng.integers(0, 40, (5, 2))])))

    def walked():
        linker, start = kernels.FrameLinker(0.35, 0.2, 0.5, 0.4), time.perf_counter()
        return [tuple(map(list, linker.step(*f))) for f in frames], time.perf_counter() - start

    few, quick = walked()
    monkeypatch.setattr(kernels, "FEW_PAIRS", -1)
    arrays, slow = walked()
    assert few == arrays
    assert quick < 0.7 * slow
