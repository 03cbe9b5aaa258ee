"""Default parameters of the engine.

Fixed values: every number below is part of the behaviour being matched.
Operators take them as arguments, so a job can override any of them.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchParams:
    accept: float = 0.70
    floor: float = 0.35
    uncertain: float = 0.55
    single_shot_min: float = 0.50
    top_k: int = 10
    single_shot_k: int = 5


@dataclass(frozen=True)
class DuplicateParams:
    near: float = 0.90
    session: float = 0.88
    hard: float = 0.70
    soft: float = 0.52


@dataclass(frozen=True)
class TrackParams:
    high_score: float = 0.35
    low_score: float = 0.10
    new_score: float = 0.40
    high_iou: float = 0.20
    low_iou: float = 0.50
    idle_seconds: float = 30.0
    buffer_idle_seconds: float = 10.0
    buffer_capacity: int = 30
    window_rows: int = 12
    window_seconds: float = 1.2
    live_window_rows: int = 10
    live_window_seconds: float = 1.0
    service_quality_gate: float = 60.0
    live_quality_gate: float = 55.0
    vote_window_seconds: float = 3.0
    vote_limit: int = 5


@dataclass(frozen=True)
class CooldownParams:
    track_seconds: float = 5.0
    source_seconds: float = 8.0
    attendance_seconds: float = 60.0


@dataclass(frozen=True)
class QualityParams:
    min_size: float = 20.0
    min_eye_distance: float = 10.0
    max_symmetry: float = 0.50
    min_blur: float = 40.0
    min_brightness: float = 30.0
    max_brightness: float = 240.0


@dataclass(frozen=True)
class EnrolParams:
    min_samples: int = 5
    target_samples: int = 6
    max_samples: int = 8
    lock_similarity: float = 0.55
    reacquire_similarity: float = 0.60
    duplicate_similarity: float = 0.88
    capture_interval: float = 1.0
    min_confidence: float = 0.45
    min_width: float = 45.0
    min_height: float = 45.0
    min_sharpness: float = 18.0
    min_brightness: float = 25.0
    max_brightness: float = 235.0
    identity_weight: float = 0.70
    spatial_weight: float = 0.20
    confidence_weight: float = 0.10
    max_references: int = 5
    left_yaw: tuple[float, float] = (-0.35, -0.12)
    right_yaw: tuple[float, float] = (0.12, 0.35)
    select_iou: float = 0.15


@dataclass(frozen=True)
class EnrichParams:
    match: float = 0.85
    quality: float = 0.80
    duplicate: float = 0.90
    max_active: int = 10


@dataclass(frozen=True)
class LivenessParams:
    active_seconds: float = 5.0
    healthy_seconds: float = 10.0
    grace_seconds: float = 60.0
    check_seconds: float = 10.0
    long_outage_checks: int = 18


NMS_IOU = 0.40

# Pose names, in the order in which missing ones are asked for.
POSES_ALL = ("FRONTAL", "SLIGHT_LEFT", "SLIGHT_RIGHT", "LEFT_PROFILE", "RIGHT_PROFILE", "UP", "DOWN")
POSES_SESSION = ("FRONTAL", "SLIGHT_LEFT", "SLIGHT_RIGHT")

# The guidance text shown for a missing pose.
POSE_GUIDANCE = {
    "FRONTAL": "Look straight toward the camera",
    "SLIGHT_LEFT": "Turn slightly left",
    "SLIGHT_RIGHT": "Turn slightly right",
    "LEFT_PROFILE": "Turn head further to the left",
    "RIGHT_PROFILE": "Turn head further to the right",
    "UP": "Tilt head slightly upward",
    "DOWN": "Tilt head slightly downward",
}
POSES_DONE_TEXT = "Great. All key poses captured."

# Texts of failing enrolment checks, in the order they are reported.
SAMPLE_FAILURES = {
    "size": "Face too small — move closer or choose a clearer face",
    "frame": "Keep the face fully inside the frame",
    "eyes": "Ensure eyes are visible",
    "sharpness": "Image blurry — hold still",
    "light": "Adjust lighting",
}

# Texts of the first failing capture check, filled with the measured value.
CAPTURE_FAILURES = {
    "size": ("Face size too small (", "px)"),
    "eyes": ("Low eye resolution (", "px)"),
    "turn": ("Extreme head yaw/turn (symmetry diff ", ")"),
    "blur": ("Blurry image (score: ", ")"),
}
CAPTURE_PASSES = "Good Quality Face"

# Constants of the rule feeds, the audit log and new candidates.
ATTENDANCE_TYPE = "ENTRY_LOG"
ALERT_TYPE = "WATCHLIST_MATCH"
ALERT_STATUS = "ACTIVE_ALERT"
VISIT_CATEGORY = "VIP_CUSTOMER"
AUDIT_REGISTER = "REGISTER_PERSON"
AUDIT_DELETE = "DELETE_PERSON"
AUDIT_ENRICH = "PROGRESSIVE_LEARNING_ADD"
CANDIDATE_STATUS = "READY"
CANDIDATE_QUALITY = 0.85
