"""Explicit schemas of the persisted tables. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T


ENTITIES = (
    "id long, entity_id string, first_name string, last_name string, name string, department string, "
    "role string, phone string, email string, company string, notes string, gallery_version int, "
    "source_candidate_id string, registered_at timestamp, updated_at timestamp"
)
CAPTURES = (
    "id long, entity_id string, image_path string, quality_score double, pose_bin string, "
    "gallery_version int, is_active boolean, created_at timestamp, yaw double, pitch double, "
    "brightness double, blur_score double"
)
GALLERY = (
    "id long, entity_id string, gallery_id long, image_id long, image_path string, gallery_version int, "
    "is_active boolean, created_at timestamp, archived_at timestamp, embedding array<float>"
)
CANDIDATES = (
    "id long, candidate_id string, status string, avg_quality double, seen_sources string, "
    "first_seen timestamp, last_seen timestamp, created_at timestamp"
)
CANDIDATE_IMAGES = (
    "id long, candidate_id string, image_path string, embedding_blob binary, quality_score double, "
    "pose_bin string, source_id string, created_at timestamp"
)
AUDIT = "id long, action string, entity_id string, details string, created_at timestamp"
SIGHTINGS = (
    "id long, entity_id string, name string, similarity double, track_id string, ts timestamp, "
    "source_id string, embedding_version int, quality_score double, snapshot_path string, status string"
)
SOURCES = (
    "id long, source_id string, name string, location string, enabled boolean, rotation int, "
    "fps_limit int, status string, last_heartbeat timestamp, error_count int, created_at timestamp"
)
DETECTIONS = (
    "source_id string, frame_id long, det_id long, ts timestamp, x1 double, y1 double, x2 double, y2 double, "
    "score double, sharpness double, landmarks array<array<double>>, embedding array<float>"
)

TABLES = {
    "entities": ENTITIES,
    "captures": CAPTURES,
    "gallery": GALLERY,
    "candidates": CANDIDATES,
    "candidate_images": CANDIDATE_IMAGES,
    "audit": AUDIT,
    "sightings": SIGHTINGS,
    "sources": SOURCES,
    "detections": DETECTIONS,
}



def struct(name: str) -> T.StructType:
    """The schema of a table as a type; needs a running session."""
    return T.StructType.fromDDL(TABLES[name])


# Source files may name their id column either way and carry credentials, which
# are left out of this schema and so never read.
SOURCE_FILE = (
    "array<struct<id: string, camera_id: string, name: string, location: string, brand: string, enabled: boolean, "
    "rotation: int, fps_limit: int, stream_type: string, channel: int, port: int>>"
)
GALLERY_MAP = "map<string, struct<person_id: string, name: string, embedding: array<double>>>"
