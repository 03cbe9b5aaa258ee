"""Pose and quality expressions over five landmarks and measured values.

Landmarks are ``ARRAY<ARRAY<DOUBLE>>`` in the order left eye, right eye, nose,
left mouth corner, right mouth corner. ``with_face`` turns them into distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.geometry import Box, height, width
from sightline.functions.text import fixed
from sightline.params import CAPTURE_FAILURES, CAPTURE_PASSES, SAMPLE_FAILURES, EnrolParams, QualityParams

LEFT_EYE, RIGHT_EYE, NOSE, LEFT_MOUTH, RIGHT_MOUTH = range(5)


def point(landmarks: Column, i: int) -> tuple[Column, Column]:
    return landmarks[i][0], landmarks[i][1]


def midpoint(a, b):
    return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2


def distance(a, b) -> Column:
    dx, dy = a[0] - b[0], a[1] - b[1]
    return F.sqrt(dx * dx + dy * dy)


FACE = ("face_points", "face_left", "face_right", "face_drop", "face_mouth", "face_eyes", "face_smile")


def with_face(df: DataFrame, landmarks: Column) -> DataFrame:
    """Append the distances the pose and quality expressions read.

    They are columns of their own, so each is computed once per row and the
    generated code of the expressions above them stays small.
    """
    nose, left_eye, right_eye = (point(landmarks, i) for i in (NOSE, LEFT_EYE, RIGHT_EYE))
    left_mouth, right_mouth = point(landmarks, LEFT_MOUTH), point(landmarks, RIGHT_MOUTH)
    eyes, mouth = midpoint(left_eye, right_eye), midpoint(left_mouth, right_mouth)
    return df.withColumns(
        {
            "face_points": F.size(landmarks),
            "face_left": distance(nose, left_eye),
            "face_right": distance(nose, right_eye),
            "face_drop": distance(nose, eyes),
            "face_mouth": distance(mouth, eyes),
            "face_eyes": distance(left_eye, right_eye),
            "face_smile": distance(left_mouth, right_mouth),
        }
    )


def _side() -> Column:
    """Nose position between the eyes, -1 to 1, positive when nearer the right eye."""
    left, right = F.col("face_left"), F.col("face_right")
    return (left - right) / (left + right + F.lit(1e-6))


def _tilt() -> Column:
    return F.col("face_drop") / (F.col("face_mouth") + F.lit(1e-6))


def pose_yaw() -> Column:
    """Quality convention: positive when the nose is nearer the right eye."""
    return F.when(F.col("face_points") >= 3, _side()).otherwise(0.0)


def pose_pitch() -> Column:
    return F.when(F.col("face_points") >= 5, _tilt() - F.lit(0.45)).otherwise(0.0)


def enrol_yaw() -> Column:
    """Enrolment convention: the opposite sign."""
    return F.when(F.col("face_points") >= 5, -_side()).otherwise(0.0)


def enrol_pitch() -> Column:
    return F.when(F.col("face_points") >= 5, _tilt() - F.lit(0.44)).otherwise(0.0)


def smile_ratio() -> Column:
    return F.col("face_smile") / (F.col("face_eyes") + F.lit(1e-6))


def pose_bin(yaw: Column, pitch: Column, smile: bool = False) -> Column:
    """Seven-way bin of the quality convention; with ``smile`` the face distances are
    read as well and a smile wins."""
    bins = (
        F.when(yaw < -0.40, "LEFT_60")
        .when(yaw > 0.40, "RIGHT_60")
        .when(yaw < -0.15, "LEFT_30")
        .when(yaw > 0.15, "RIGHT_30")
        .when(pitch > 0.18, "UP")
        .when(pitch < -0.18, "DOWN")
        .otherwise("FRONTAL")
    )
    if not smile:
        return bins
    smiling = (F.col("face_points") >= 5) & (smile_ratio() > 0.62)
    return F.when(smiling, "SMILE").otherwise(bins)


def enrol_pose_bin(yaw: Column, pitch: Column, p: EnrolParams = EnrolParams()) -> Column:
    return (
        F.when(yaw <= p.left_yaw[0], "LEFT_PROFILE")
        .when(yaw >= p.right_yaw[1], "RIGHT_PROFILE")
        .when(yaw <= p.left_yaw[1], "SLIGHT_LEFT")
        .when(yaw >= p.right_yaw[0], "SLIGHT_RIGHT")
        .when(pitch > 0.18, "UP")
        .when(pitch < -0.18, "DOWN")
        .otherwise("FRONTAL")
    )


def session_pose(pose: Column) -> Column:
    """Fold profiles into the slight turns and tilts into frontal."""
    return (
        F.when(pose.isin("LEFT_PROFILE", "SLIGHT_LEFT"), "SLIGHT_LEFT")
        .when(pose.isin("RIGHT_PROFILE", "SLIGHT_RIGHT"), "SLIGHT_RIGHT")
        .when(pose.isin("UP", "DOWN"), "FRONTAL")
        .otherwise(pose)
    )


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def capture_score(yaw: Column, pitch: Column, blur: Column, brightness: Column, digits: int = 4) -> Column:
    """Penalty score of a capture, 0..1."""
    light = (
        F.when(brightness < 40, (40 - brightness) / F.lit(40.0))
        .when(brightness > 220, (brightness - 220) / F.lit(35.0))
        .otherwise(0.0)
    )
    raw = 1 - F.lit(0.4) * F.abs(yaw) - F.lit(0.2) * F.abs(pitch) - F.lit(0.2) * light
    sharp = F.lit(0.8) + F.lit(0.2) * F.least(blur / F.lit(100.0), F.lit(1.0))
    return F.round(clamp01(raw * sharp), digits)


def capture_passes(good: Column, brightness: Column, p: QualityParams = QualityParams()) -> Column:
    return good & ~((brightness < p.min_brightness) | (brightness > p.max_brightness))


def sample_score(blur: Column, brightness: Column, eyes: Column, digits: int = 3) -> Column:
    """Weighted sharpness, exposure and size score of an enrolment sample, 0..1."""
    sharp = F.least(blur / F.lit(100.0), F.lit(1.0))
    light = 1 - F.abs(brightness - 128) / F.lit(128.0)
    size = F.least(eyes / F.lit(60.0), F.lit(1.0))
    return F.round(clamp01(F.lit(0.4) * sharp + F.lit(0.3) * light + F.lit(0.3) * size), digits)


def six_factor_score(
    blur: Column, area_px: Column, yaw: Column, brightness: Column, occlusion: Column, sharpness: Column
) -> Column:
    """The documented six-factor score: each factor scaled to 0..1 and weighted."""

    def scaled(c: Column, low: float, high: float) -> Column:
        return clamp01((c - F.lit(low)) / F.lit(high - low))

    return (
        F.lit(0.30) * scaled(blur, 0.0, 500.0)
        + F.lit(0.20) * scaled(area_px, 1000.0, 50000.0)
        + F.lit(0.15) * (1 - F.abs(yaw))
        + F.lit(0.15) * scaled(brightness, 40.0, 220.0)
        + F.lit(0.10) * (1 - occlusion)
        + F.lit(0.10) * scaled(sharpness, 0.0, 1000.0)
    )


def six_factor_rejects(
    blur: Column, area_px: Column, yaw: Column, brightness: Column, occlusion: Column
) -> Column:
    """True when the documented six-factor engine rejects a capture outright."""
    return (
        (blur < 30) | (area_px < 900) | (F.abs(yaw) > 0.6) | (brightness < 30) | (brightness > 240) | (occlusion > 0.4)
    )


def first_failure(b: Box, blur: Column, p: QualityParams = QualityParams()) -> Column:
    """Text of the first failing check, or the pass text; reads the face distances."""
    eyes, symmetry = F.col("face_eyes"), F.abs(_side())
    w, h = width(b), height(b)

    def told(check: str, *parts: Column | str) -> Column:
        before, after = CAPTURE_FAILURES[check]
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in (before, *parts, after)])

    size = (w.cast("int").cast("string"), "x", h.cast("int").cast("string"), f"px < {int(p.min_size)}")
    return (
        F.when((w < p.min_size) | (h < p.min_size), told("size", *size))
        .when(eyes < p.min_eye_distance, told("eyes", fixed(eyes, 1)))
        .when(symmetry > p.max_symmetry, told("turn", fixed(symmetry, 2)))
        .when(blur < p.min_blur, told("blur", fixed(blur, 1), f" < threshold: {p.min_blur}"))
        .otherwise(CAPTURE_PASSES)
    )


def failing_checks(
    b: Box,
    eyes: Column,
    blur: Column,
    brightness: Column,
    frame_w: float,
    frame_h: float,
    method: str = "WEBCAM",
    p: EnrolParams = EnrolParams(),
) -> Column:
    """Array of the reasons of all failing checks, empty when the sample passes."""
    size_ok = (width(b) >= p.min_width) & (height(b) >= p.min_height)
    if method == "CCTV":
        in_frame = (b[0] >= 0) & (b[1] >= 0) & (b[2] <= frame_w) & (b[3] <= frame_h)
    else:
        cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        mx, my = frame_w * 0.05, frame_h * 0.05
        in_frame = cx.between(mx, frame_w - mx) & cy.between(my, frame_h - my)
    passes = {
        "size": size_ok,
        "frame": in_frame,
        "eyes": eyes >= QualityParams().min_eye_distance,
        "sharpness": blur >= p.min_sharpness,
        "light": brightness.between(p.min_brightness, p.max_brightness),
    }
    return F.array_compact(F.array(*[F.when(~passes[check], text) for check, text in SAMPLE_FAILURES.items()]))
