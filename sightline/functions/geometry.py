"""Box expressions. A box is a tuple of four Columns (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.params import EnrolParams

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", alias: str | None = None) -> Box:
    """The four corner columns, optionally prefixed and qualified."""
    lead = f"{alias}." if alias else ""
    return tuple(F.col(f"{lead}{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def min_side(b: Box) -> Column:
    return F.least(F.greatest(F.lit(0.0), width(b)), F.greatest(F.lit(0.0), height(b)))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; empty or inverted boxes give 0."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(
        zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    )
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(zero)


def center_distance(a: Box, b: Box, frame_w: float, frame_h: float) -> Column:
    """Distance of the box centres as a share of the frame diagonal."""
    dx = (a[0] + a[2]) / 2 - (b[0] + b[2]) / 2
    dy = (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2
    w, h = max(1.0, frame_w), max(1.0, frame_h)
    return F.sqrt(dx * dx + dy * dy) / F.lit(max((w * w + h * h) ** 0.5, 1.0))


def spatial_score(a: Box, b: Box, frame_w: float, frame_h: float) -> Column:
    near = F.greatest(F.lit(0.0), 1 - center_distance(a, b, frame_w, frame_h) * 4)
    return F.lit(0.6) * iou(a, b) + F.lit(0.4) * near


def association_score(
    identity: Column, spatial: Column, confidence: Column, p: EnrolParams = EnrolParams()
) -> Column:
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return (
        F.lit(p.identity_weight) * identity
        + F.lit(p.spatial_weight) * spatial
        + F.lit(p.confidence_weight) * conf
    )


def unpad_box(b: Box, pad_left: Column, pad_top: Column, scale: Column, img_w: Column, img_h: Column) -> Box:
    """Map a box out of a padded, scaled frame and clip it to the image."""
    zero = F.lit(0.0)
    return (
        F.greatest(zero, (b[0] - pad_left) / scale),
        F.greatest(zero, (b[1] - pad_top) / scale),
        F.least(img_w.cast("double"), (b[2] - pad_left) / scale),
        F.least(img_h.cast("double"), (b[3] - pad_top) / scale),
    )


def unpad_landmarks(points: Column, pad_left: Column, pad_top: Column, scale: Column) -> Column:
    """The same mapping for ``ARRAY<ARRAY<DOUBLE>>`` points (not clipped)."""
    return F.transform(points, lambda p: F.array((p[0] - pad_left) / scale, (p[1] - pad_top) / scale))
