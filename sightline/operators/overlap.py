"""Box overlap joins, frame-to-frame linking and track stitching.

Boxes meet through a grid: each is copied to the cells it covers, boxes of one
cell are joined, and a pair counts only in the cell that holds the top-left
corner of its intersection, so every overlapping pair appears exactly once and
boxes far apart are never compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.functions.geometry import area, association_score, box, iou, spatial_score
from sightline.operators import kernels
from sightline.params import EnrolParams, TrackParams
from sightline.session import checkpointed

CELL = 256.0
CORNERS = ["x1", "y1", "x2", "y2"]


def _cell_range(low: str, high: str, cell: float) -> Column:
    first, last = F.floor(F.col(low) / cell).cast("int"), F.floor(F.col(high) / cell).cast("int")
    return F.sequence(first, F.greatest(first, last))


def _to_cells(boxes: DataFrame, prefix: str, cell: float) -> DataFrame:
    return boxes.withColumn("_cx", F.explode(_cell_range(f"{prefix}x1", f"{prefix}x2", cell))).withColumn(
        "_cy", F.explode(_cell_range(f"{prefix}y1", f"{prefix}y2", cell))
    )


def overlap_pairs(
    left: DataFrame, right: DataFrame, on: list[str], threshold: float, keep: list[str], cell: float = CELL
) -> DataFrame:
    """Pairs with IoU ≥ ``threshold`` (> 0) among rows with equal ``on`` columns.

    Columns: ``on``, ``iou`` and the ``keep`` columns of both sides with the
    prefixes ``left_`` and ``right_``.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        named = df.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).select(
            *on, *[F.col(c).alias(prefix + c) for c in dict.fromkeys([*CORNERS, *keep])]
        )
        return _to_cells(named, prefix, cell)

    pairs = side(left, "left_").join(side(right, "right_"), [*on, "_cx", "_cy"])
    corner_x = F.floor(F.greatest("left_x1", "right_x1") / cell) == F.col("_cx")
    corner_y = F.floor(F.greatest("left_y1", "right_y1") / cell) == F.col("_cy")
    share = iou(box("left_"), box("right_"))
    return (
        pairs.where(corner_x & corner_y)
        .withColumn("iou", share)
        .where(F.col("iou") >= threshold)
        .select(*on, "iou", *[f"left_{c}" for c in keep], *[f"right_{c}" for c in keep])
    )


def iou_pairs(boxes: DataFrame, on: list[str], row_id: str, threshold: float) -> DataFrame:
    """Unordered pairs of boxes of the same ``on`` group with IoU ≥ ``threshold``."""
    return overlap_pairs(boxes, boxes, on, threshold, [row_id]).where(
        F.col(f"left_{row_id}") < F.col(f"right_{row_id}")
    )


BUCKET_FRAMES = 512
WARM_FRAMES = 16


def _limits(p: TrackParams) -> tuple[float, float, float, float]:
    return p.high_score, p.high_iou, p.low_iou, p.new_score


def linked_frames(
    detections: DataFrame, source: str = "source_id", frame: str = "frame_id", row_id: str = "det_key",
    p: TrackParams = TrackParams(), bucket_frames: int = BUCKET_FRAMES, warm_frames: int = WARM_FRAMES,
) -> DataFrame:
    """Every usable detection with its link to the frame before and the head of its track.

    Columns: ``source``, ``_bucket``, ``frame``, ``row_id``, the box, ``_prev``, ``_iou``,
    ``_high``, ``_head``, ``_open``. A source's frames are cut into buckets that are walked
    apart. What a bucket needs of the one before is which rows of its last frame are in a
    track; the first guess comes from walking only the last frames of each bucket. Buckets
    whose guess proves wrong are walked again until none is, so the outcome is that of one
    walk over all frames; most guesses hold, since tracks end and begin all the time.
    """
    bucket = F.floor(F.col(frame) / bucket_frames).cast("long")
    rows = detections.where((F.col("score") >= p.low_score) & F.col(frame).isNotNull()).select(
        source, bucket.alias("_bucket"), F.col(frame).cast("long").alias(frame), row_id, *[F.col(c).cast("double").alias(c) for c in CORNERS],
        F.col("score").cast("double").alias("score"), F.lit(False).alias("_carried"),
    )
    rows = checkpointed(rows)
    found = T.StructType(
        [rows.schema[source], rows.schema["_bucket"], rows.schema[frame], rows.schema[row_id], *[rows.schema[c] for c in CORNERS]]
        + [T.StructField("_prev", rows.schema[row_id].dataType), *T._parse_datatype_string("_iou double, _high boolean")]
        + [T.StructField("_head", rows.schema[row_id].dataType), T.StructField("_open", T.BooleanType())]
    )
    found = T.StructType([T.StructField(f.name, f.dataType, True) for f in found])
    key = [source, "_bucket"]

    def walk(part: DataFrame) -> DataFrame:
        dealt = part.repartition(*key).sortWithinPartitions(*key, frame, row_id)
        return dealt.mapInArrow(kernels.frame_walk(key, frame, row_id, _limits(p), to_arrow_schema(found)), found)

    def carry_of(result: DataFrame) -> DataFrame:
        last = result.where((F.pmod(F.col(frame), F.lit(bucket_frames)) == bucket_frames - 1) & F.col("_head").isNotNull())
        return last.select(
            source, (F.col("_bucket") + 1).alias("_bucket"), frame, row_id, *CORNERS, F.lit(None).cast("double").alias("score"), F.lit(True).alias("_carried")
        )

    def marks(carry: DataFrame, name: str) -> DataFrame:
        return carry.groupBy(*key).agg(F.sort_array(F.collect_set(row_id)).alias(name))

    warm = rows.where(F.pmod(F.col(frame), F.lit(bucket_frames)) >= bucket_frames - warm_frames)
    used = checkpointed(carry_of(walk(warm)))
    result = checkpointed(walk(rows.unionByName(used)))
    while True:
        now = checkpointed(carry_of(result))
        differ = marks(used, "_used").join(marks(now, "_now"), key, "full").where(~F.col("_used").eqNullSafe(F.col("_now")))
        changed = checkpointed(differ.select(*key))
        if changed.isEmpty():
            return result
        again = walk(rows.unionByName(now).join(changed, key, "left_semi"))
        result, used = checkpointed(result.join(changed, key, "left_anti").unionByName(again)), now


def frame_links(
    detections: DataFrame, source: str = "source_id", frame: str = "frame_id", row_id: str = "det_key", p: TrackParams = TrackParams(), **options
) -> DataFrame:
    """One-to-one links between the detections of a frame and the tracks alive in the frame before.

    First detections scoring at least ``high_score`` are linked at IoU ≥ ``high_iou``; the
    tracks still free are then linked to detections in the low band at IoU ≥ ``low_iou``.
    Columns: ``prev_<row_id>``, ``next_<row_id>``, ``iou``, ``band``.
    """
    rows = linked_frames(detections, source, frame, row_id, p, **options).where(F.col("_prev").isNotNull())
    band = F.when(F.col("_high"), F.lit("high")).otherwise(F.lit("low"))
    return rows.select(F.col("_prev").alias(f"prev_{row_id}"), F.col(row_id).alias(f"next_{row_id}"), F.col("_iou").alias("iou"), band.alias("band"))


def track_ids(
    detections: DataFrame, source: str = "source_id", frame: str = "frame_id", row_id: str = "det_key", p: TrackParams = TrackParams(), **options
) -> DataFrame:
    """Stable track id of every detection that belongs to a track: ``row_id``, ``track_id``.

    Inside a bucket the walk knows each track's head. Only tracks that come from the bucket
    before are chained, over the rows of bucket borders, by pointer doubling (rounds = log2
    of the buckets that a track spans).
    """
    rows = linked_frames(detections, source, frame, row_id, p, **options).where(F.col("_head").isNotNull())
    # A border row's head may be a border row of the bucket before, and so on.
    borders = rows.where("_open").select(F.col("_head").alias("node")).distinct()
    pointers = checkpointed(
        borders.join(rows.select(F.col(row_id).alias("node"), F.col("_head").alias("up"), F.col("_open").alias("more")), "node")
    )
    while not pointers.where("more").isEmpty():
        hop = pointers.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("more").alias("_more"))
        ahead = pointers.where("more").join(hop, "up")
        pointers = checkpointed(
            pointers.where("NOT more").unionByName(ahead.select("node", F.col("_up").alias("up"), F.col("_more").alias("more")))
        )
    through = rows.where("_open").join(pointers.select(F.col("node").alias("_head"), F.col("up").alias("_root")), "_head")
    rooted = rows.where("NOT _open").withColumn("_root", F.col("_head")).select(source, row_id, "_root").unionByName(through.select(source, row_id, "_root"))
    return rooted.select(row_id, F.concat_ws(":", F.col(source), F.col("_root").cast("string")).alias("track_id"))


def stitch_tracks(
    detections: DataFrame, source: str = "source_id", frame: str = "frame_id", row_id: str = "det_key",
    p: TrackParams = TrackParams(),
) -> DataFrame:
    """Detections that belong to a track, with its ``track_id``."""
    return detections.join(track_ids(detections, source, frame, row_id, p), row_id)


def largest_box(boxes: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """The largest box of each group; the smaller id wins a tie."""
    order = F.struct(area(box()).alias("area"), -F.col(row_id))
    best = F.max_by(F.struct(*[c for c in boxes.columns if c not in keys]), order)
    return boxes.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def associate_target(
    targets: DataFrame,
    detections: DataFrame,
    on: list[str],
    target_id: str,
    row_id: str,
    frame_w: float = 640.0,
    frame_h: float = 480.0,
    p: EnrolParams = EnrolParams(),
) -> DataFrame:
    """The detection that continues each locked target, gated on identity.

    ``targets`` has ``target_id``, box, ``identity`` of each detection comes as a
    column of ``detections`` or is computed by the caller. The best score is
    chosen first; the gate (stricter when ``lost``) is applied to the winner.
    """
    t = targets.select(
        *on, target_id, "lost", *[F.col(c).alias(f"t_{c}") for c in CORNERS]
    )
    d = detections.where(
        (F.col("score") >= p.min_confidence)
        & (F.col("x2") - F.col("x1") >= p.min_width)
        & (F.col("y2") - F.col("y1") >= p.min_height)
    )
    spatial = spatial_score(box(), box("t_"), frame_w, frame_h)
    scored = t.join(d, on).withColumn(
        "association", association_score(F.col("identity"), spatial, F.col("score"), p)
    )
    best = F.max_by(
        F.struct(row_id, "identity", "association"), F.struct(F.col("association"), -F.col(row_id))
    )
    gate = F.when(F.col("lost"), p.reacquire_similarity).otherwise(p.lock_similarity)
    return (
        scored.groupBy(target_id, "lost")
        .agg(best.alias("_b"))
        .select(target_id, "lost", "_b.*")
        .where(F.col("identity") >= gate)
    )


def link_annotations(
    annotations: DataFrame, detections: DataFrame, on: list[str], annotation_id: str, row_id: str, threshold: float = 0.15
) -> DataFrame:
    """Attach a detection to each annotated box: by its ``detection_id``, else by
    best IoU ≥ ``threshold`` in the same ``on`` group."""
    named = annotations.join(
        detections.select(*on, F.col(row_id).alias("detection_id")).withColumn("_found", F.lit(True)),
        [*on, "detection_id"],
        "left",
    )
    direct = named.where("_found").select(
        *on, annotation_id, F.col("detection_id").alias(row_id), F.lit(1.0).alias("iou"), F.lit("id").alias("method")
    )
    rest = named.where(F.col("_found").isNull()).select(*on, annotation_id, *CORNERS)
    # Of equal detections the smallest id wins, so only that one is compared.
    single = detections.groupBy(*on, *CORNERS).agg(F.min(row_id).alias("_id"))
    pairs = overlap_pairs(rest.withColumnRenamed(annotation_id, "_id"), single, on, threshold, ["_id"])
    best = F.max_by(F.struct(F.col("right__id"), F.col("iou")), F.struct(F.col("iou"), -F.col("right__id")))
    by_box = pairs.groupBy(*on, F.col("left__id").alias(annotation_id)).agg(best.alias("_b")).select(
        *on, annotation_id, F.col("_b.right__id").alias(row_id), F.col("_b.iou").alias("iou"), F.lit("iou").alias("method")
    )
    return direct.unionByName(by_box)
