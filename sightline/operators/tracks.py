"""Rows of tracks: best row, one decision per track, consensus, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.geometry import box, min_side
from sightline.functions.text import detection_id, is_known, overlay_quality
from sightline.operators.match import consensus, match_entities
from sightline.params import MatchParams, TrackParams
from sightline.session import checkpointed


def opening_window(
    rows: DataFrame, track: list[str], second: str, order: list[str], max_rows: int, max_seconds: float
) -> DataFrame:
    """A track's first ``max_rows`` rows that lie less than ``max_seconds`` after its first.

    The row limit comes first, so Spark cuts each map task's rows down to the
    limit before the shuffle and a long track never travels whole.
    """
    ordered = W.partitionBy(*track).orderBy(second, *order)
    first = F.first(second).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        rows.withColumn("_rn", F.row_number().over(ordered))
        .where(F.col("_rn") <= max_rows)
        .withColumn("_first", first)
        .where(F.col(second) - F.col("_first") < max_seconds)
        .drop("_rn", "_first")
    )


def best_track_row(
    rows: DataFrame,
    track: list[str],
    second: str,
    order: list[str],
    estimate: Column | None = None,
    max_rows: int = TrackParams().window_rows,
    max_seconds: float = TrackParams().window_seconds,
) -> DataFrame:
    """Best row of each track's opening window by min side × sharpness, earliest on ties."""
    score = estimate if estimate is not None else min_side(box()) * F.col("sharpness")
    window = opening_window(rows, track, second, order, max_rows, max_seconds).withColumn("estimate", score)
    best = F.row_number().over(W.partitionBy(*track).orderBy(F.desc("estimate"), second, *order))
    return window.withColumn("_rn", best).where("_rn = 1").drop("_rn")


def recognise_tracks(
    best: DataFrame, gallery: DataFrame, row_id: str, gallery_id: str, quality: Column,
    gate: float = TrackParams().service_quality_gate, p: MatchParams = MatchParams(), **options,
) -> DataFrame:
    """One decision per track from its best row; a row below the quality gate is unknown.
    Tracks with equal vectors are one search."""
    best = checkpointed(best)  # ranked once: it feeds the match and the rows without one
    gated = best.where(quality * 100 >= gate).select(row_id, "embedding")
    single = checkpointed(gated.groupBy("embedding").agg(F.min(row_id).alias("_first")))
    matched = match_entities(single, gallery, "_first", gallery_id, p, **options)
    found = gated.join(single, "embedding").join(matched, "_first").select(row_id, "entity_id", "similarity")
    # A row without a vector is looked up nowhere and stays unknown, as below the gate.
    return best.join(found, row_id, "left").withColumn(
        "entity_id", F.coalesce("entity_id", F.lit("unknown"))
    ).withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def consensus_window(
    votes: DataFrame,
    track: list[str],
    second: str,
    row_id: str,
    entity: str = "entity_id",
    similarity: str = "similarity",
    vote: str = "max",
    p: TrackParams = TrackParams(),
) -> DataFrame:
    """Decide a track once: at its first row ``vote_window_seconds`` after its start or
    at its ``vote_limit``-th known vote, whichever comes first.

    The votes are the known rows up to the deciding one. A track that reaches
    neither point has no row here; one that decides without votes is 'unknown'.
    """
    at = F.struct(F.col(second).alias("s"), F.col(row_id).alias("r"))
    starts = votes.groupBy(*track).agg(F.min(second).alias("_start"))
    by_time = (
        votes.select(*track, second, row_id)
        .join(starts, track)
        .where(F.col(second) >= F.col("_start") + p.vote_window_seconds)
        .groupBy(*track)
        .agg(F.min(at).alias("_time"))
    )
    nth = F.row_number().over(W.partitionBy(*track).orderBy(second, row_id))
    known = (
        votes.where(is_known(F.col(entity)))
        .select(*track, entity, similarity, second, row_id)
        .withColumn("_rn", nth)
        .where(F.col("_rn") <= p.vote_limit)
    )
    by_votes = known.where(F.col("_rn") == p.vote_limit).select(*track, at.alias("_votes_at"))
    decided = by_time.join(by_votes, track, "full").select(*track, F.least("_time", "_votes_at").alias("_at"))
    counted = known.join(decided, track).where(at <= F.col("_at"))
    winner = consensus(counted, track, entity, similarity, [second, row_id], vote)
    return decided.join(winner, track, "left").select(
        *track,
        F.coalesce(entity, F.lit("unknown")).alias(entity),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("votes", F.lit(0)).alias("votes"),
        F.col("_at.s").alias("decided_at"),
    )


def track_states(
    rows: DataFrame, track: list[str], ts: str, as_of: Column, matches: DataFrame | None = None,
    candidates: DataFrame | None = None, idle_seconds: float = TrackParams().idle_seconds,
) -> DataFrame:
    """Lifecycle state of each track at ``as_of``: LOST when idle too long, else
    RECOGNIZED, CANDIDATE or TRACKING.

    ``matches`` has the track columns and ``entity_id``; ``candidates`` the track
    columns and ``candidate_id``.
    """
    spans = rows.groupBy(*track).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("rows")
    )
    recognised = candidate = F.lit(False)
    if matches is not None:
        spans = spans.join(matches.select(*track, "entity_id"), track, "left")
        recognised = is_known(F.col("entity_id"))
    if candidates is not None:
        spans = spans.join(candidates.select(*track, "candidate_id"), track, "left")
        candidate = F.col("candidate_id").isNotNull()
    idle = (F.unix_micros(as_of) - F.unix_micros("last_seen")) > int(idle_seconds * 1_000_000)
    state = (
        F.when(idle, "LOST").when(recognised, "RECOGNIZED").when(candidate, "CANDIDATE").otherwise("TRACKING")
    )
    return spans.withColumn("state", state)


def with_matches(rows: DataFrame, matches: DataFrame, track: list[str]) -> DataFrame:
    """Track rows with their track's decision, if any."""
    return rows.join(matches, track, "left")


def decided_tracks(tracks: DataFrame, entity: str = "entity_id", best: str = "best_row") -> DataFrame:
    return tracks.where(F.col(entity).isNotNull() & F.col(best).isNotNull())


def overlay(rows: DataFrame, source: str = "source_id", track: str = "track_no") -> DataFrame:
    """Live overlay columns of track rows joined with their decisions."""
    decided = F.col("entity_id").isNotNull()
    return rows.select(
        detection_id(F.col(source), F.col(track)).alias("detection_id"),
        source,
        track,
        F.when(decided, F.coalesce("name", F.lit("Unknown"))).otherwise("Analyzing...").alias("name"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 3).alias("similarity"),
        is_known(F.col("entity_id")).alias("is_recognized"),
        overlay_quality(F.col("sharpness")).alias("quality"),
        F.col("score").alias("confidence"),
    )


def reopen_tracks(tracks: DataFrame, as_of: Column, last_seen: str = "last_seen", idle_seconds: float = 30.0) -> DataFrame:
    """Tracks still open at ``as_of``, stripped of their decision, for matching
    against a new gallery version."""
    open_now = F.unix_micros(as_of) - F.unix_micros(last_seen) <= int(idle_seconds * 1_000_000)
    return tracks.where(open_now).drop("entity_id", "name", "similarity")
