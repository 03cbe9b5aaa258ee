"""Enrolment sessions: sample acceptance, target lock, readiness, commit gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.functions.text import next_missing, progress_percent
from sightline.operators import kernels
from sightline.operators.greedy import BLOCK_ROWS, LANES, _strike, greedy_keep
from sightline.operators.match import check_duplicates, near_duplicates
from sightline.operators.registry import append_gallery, audit_rows, upsert_entities
from sightline.params import AUDIT_ENRICH, AUDIT_REGISTER, POSES_SESSION, EnrichParams, EnrolParams
from sightline.session import checkpointed


def _accept(rows: DataFrame, session: list[str], order: list[str], p: EnrolParams, interval: float) -> DataFrame:
    columns = [c for c in rows.columns if c != "_flag"]
    kernel = kernels.accept_samples(
        session, int(round(interval * 1_000_000)), p.duplicate_similarity, p.target_samples, p.max_samples, columns
    )
    schema = T.StructType([f for f in rows.schema if f.name != "_flag"])
    return rows.repartition(*session).sortWithinPartitions(*session, "_flag", "_t", *order).mapInArrow(kernel, schema)


def accept_samples(
    captures: DataFrame,
    session: list[str],
    ts: str,
    row_id: str,
    passed: Column,
    pose: Column,
    embedding: str = "embedding",
    interval: float | None = None,
    p: EnrolParams = EnrolParams(),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Accepted samples per session, numbered in ``sample_no``.

    In time order a capture that passes its gates is accepted when it is no
    near-duplicate of an accepted one, comes at least ``interval`` seconds after
    the last one, fewer than ``max_samples`` are held, and it brings a new pose or
    fewer than ``target_samples`` are held. ``interval`` 0 is the webcam form.

    A session above ``block_rows`` gated rows is walked in rounds of that many
    rows, the accepted samples (at most ``max_samples``) going ahead of each.
    """
    wait = p.capture_interval if interval is None else interval
    rows = (
        captures.where(passed & F.col(embedding).isNotNull())
        .withColumn("_t", F.unix_micros(ts))
        .withColumn("_pose", pose)
        .withColumn("_vec", F.col(embedding).cast("array<double>"))
    )
    sizes = rows.groupBy(*session).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    if sizes.isEmpty():
        accepted = _accept(rows.withColumn("_flag", F.lit(1)), session, [row_id], p, wait)
    else:
        big = checkpointed(sizes.drop("_n"))
        small = rows.join(big, session, "left_anti")
        open_rows = checkpointed(rows.join(big, session, "left_semi"))
        taken = open_rows.limit(0)
        nth = F.row_number().over(W.partitionBy(*session).orderBy("_t", row_id))
        while not open_rows.isEmpty():
            head = checkpointed(open_rows.withColumn("_rn", nth).where(F.col("_rn") <= block_rows).drop("_rn"))
            both = head.withColumn("_flag", F.lit(1)).unionByName(taken.withColumn("_flag", F.lit(0)))
            fresh = _accept(both, session, [row_id], p, wait)
            taken = checkpointed(taken.unionByName(fresh))
            full = taken.groupBy(*session).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= p.max_samples)
            rest = open_rows.join(head.select(row_id), row_id, "left_anti").join(full.drop("_n"), session, "left_anti")
            open_rows = checkpointed(
                _strike(rest, taken, session, kernels.VectorConflict(p.duplicate_similarity), LANES, row_id)
            )
        accepted = _accept(small.withColumn("_flag", F.lit(1)), session, [row_id], p, wait).unionByName(taken)
    number = F.row_number().over(W.partitionBy(*session).orderBy("_t", row_id))
    return accepted.withColumn("pose", F.col("_pose")).withColumn("sample_no", number.cast("long")).drop(
        "_t", "_pose", "_vec"
    )


def lock_parameters(p: EnrolParams = EnrolParams(), frame_w: float = 640.0, frame_h: float = 480.0) -> dict:
    return {
        "identity_weight": p.identity_weight, "spatial_weight": p.spatial_weight,
        "confidence_weight": p.confidence_weight, "diagonal": (frame_w**2 + frame_h**2) ** 0.5,
        "lock": p.lock_similarity, "reacquire": p.reacquire_similarity, "max_references": p.max_references,
        "duplicate": p.duplicate_similarity, "interval": int(p.capture_interval * 1_000_000),
        "min_samples": p.min_samples, "target": p.target_samples, "max_samples": p.max_samples,
        "min_confidence": p.min_confidence, "min_width": p.min_width, "min_height": p.min_height,
    }


def lock_schema(df: DataFrame, session: list[str]) -> T.StructType:
    keys = [T.StructField(c, df.schema[c].dataType, True) for c in [*session, "seq"]]
    extra = (
        "state string, track long, similarity double, captured boolean, reason string, samples int, locked boolean"
    )
    return T.StructType(keys + list(T._parse_datatype_string(extra)))


def target_lock(
    rows: DataFrame, session: list[str], ts: str, p: EnrolParams = EnrolParams(),
    frame_w: float = 640.0, frame_h: float = 480.0,
) -> DataFrame:
    """State of the target lock after every step of every session.

    Input: one row per detection and step with ``seq``, ``command`` (start, select,
    unlock, frame), ``track``, box, ``score``, ``passed``, ``pose``, ``embedding``;
    a step without detections is one row with null values. Rows are streamed in
    order past a fixed-size state, so a long session is never held in memory.
    """
    schema = lock_schema(rows, session)
    frame_gate = (
        (F.col("command") != "frame")
        | (
            (F.col("score") >= p.min_confidence)
            & (F.col("x2") - F.col("x1") >= p.min_width)
            & (F.col("y2") - F.col("y1") >= p.min_height)
        )
    )
    # Gate before the shuffle: a dropped detection travels as an empty row.
    slim = rows.withColumn(
        "embedding", F.when(frame_gate, F.col("embedding").cast("array<double>"))
    ).withColumn("_t", F.unix_micros(ts))
    kernel = kernels.target_lock(session, lock_parameters(p, frame_w, frame_h), to_arrow_schema(schema))
    return (
        slim.repartition(*session).sortWithinPartitions(*session, "seq", "track").mapInArrow(kernel, schema)
    )


def pose_coverage(
    samples: DataFrame, session: list[str], pose: str, p: EnrolParams = EnrolParams()
) -> DataFrame:
    """Samples, coverage, readiness, progress and next pose per session."""
    has = {name: F.bool_or(F.col(pose) == name) for name in POSES_SESSION}
    agg = samples.groupBy(*session).agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.coalesce(flag, F.lit(False)).alias(f"has_{name.lower()}") for name, flag in has.items()],
    )
    covered = F.col("has_frontal") & (F.col("has_slight_left") | F.col("has_slight_right"))
    seen = F.array_compact(F.array(*[F.when(F.col(f"has_{n.lower()}"), n) for n in POSES_SESSION]))
    n = F.col("samples")
    return agg.select(
        *session, "samples", *[f"has_{name.lower()}" for name in POSES_SESSION],
        (((n >= p.min_samples) & covered) | (n >= p.target_samples)).alias("ready"),
        progress_percent(n, p.target_samples).alias("progress_percent"),
        next_missing(POSES_SESSION, seen).alias("next_pose"),
    )


def solo_frames(
    detections: DataFrame, frame: list[str], session: list[str], order: list[str], passed: Column, limit: int
) -> DataFrame:
    """First ``limit`` gated detections per session from frames with exactly one."""
    singles = (
        detections.groupBy(*frame)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*[c for c in detections.columns if c not in frame])).alias("_d"))
        .where("_n = 1")
        .select(*frame, "_d.*")
    )
    nth = F.row_number().over(W.partitionBy(*session).orderBy(*order))
    return singles.where(passed).withColumn("sample_no", nth).where(F.col("sample_no") <= limit)


def enrich_gallery(
    matches: DataFrame,
    gallery: DataFrame,
    entity: str,
    row_id: str,
    gallery_id: str,
    ts: str,
    active: Column,
    p: EnrichParams = EnrichParams(),
) -> DataFrame:
    """Captures that may join their entity's gallery.

    ``matches`` has ``entity``, ``similarity``, ``quality`` and ``embedding``. A
    capture is added when match and quality reach their gates, it is no
    near-duplicate of the gallery or of one added before it, and fewer than
    ``max_active`` rows are active. ``version_step`` is the bump it causes.
    """
    # Few matches pass the gates, and they are read three times below.
    good = checkpointed(matches.where((F.col("similarity") >= p.match) & (F.col("quality") >= p.quality)))
    seen = near_duplicates(good, gallery, row_id, gallery_id, entity, p.duplicate)
    fresh = good.join(seen.where("NOT is_duplicate").select(row_id), row_id)
    vec = F.col("embedding").cast("array<double>")
    added = greedy_keep(
        fresh, [entity], [F.asc(ts), F.asc(row_id)], vec, kernels.VectorConflict(p.duplicate), row_id,
        cap=p.max_active,
    )
    counts = gallery.groupBy(entity).agg(F.count_if(active).alias("_active"))
    nth = F.row_number().over(W.partitionBy(entity).orderBy(ts, row_id))
    return (
        added.withColumn("version_step", nth.cast("long"))
        .join(counts, entity, "left")
        .where(F.col("version_step") <= F.lit(p.max_active) - F.coalesce("_active", F.lit(0)))
        .drop("_active")
    )


def commit_enrichment(added: DataFrame, entities: DataFrame, gallery: DataFrame, row_id: str, gallery_id: str) -> dict[str, DataFrame]:
    """Write enrich_gallery()'s captures into the tables: new registry, gallery and audit rows.

    Each capture raises its entity's version by one and is active from then on.
    ``added`` has ``entity_id``, ``pose_bin``, ``embedding`` and ``version_step``.
    """
    good = checkpointed(added)
    steps = good.groupBy("entity_id").agg(F.max("version_step").alias("_steps"))
    before = entities.select("entity_id", F.col("name").alias("_name"), F.coalesce("gallery_version", F.lit(1)).alias("_version"))
    new = good.join(before, "entity_id").withColumn("gallery_version", (F.col("_version") + F.col("version_step")).cast("int"))
    details = F.concat(
        F.lit("Added new "), F.col("pose_bin"), F.lit(" capture to "), F.col("_name"), F.lit("'s profile (version "),
        F.col("gallery_version"), F.lit(")."),
    )
    raised = (F.coalesce("gallery_version", F.lit(1)) + F.coalesce("_steps", F.lit(0))).cast("int")
    return {
        "entities": entities.join(steps, "entity_id", "left").withColumn("gallery_version", raised).select(*entities.columns),
        "gallery": append_gallery(
            gallery, new.drop("_name", "_version", "version_step").withColumn("is_active", F.lit(True)), row_id, gallery_id=gallery_id
        ),
        "audit": audit_rows(new, AUDIT_ENRICH, details),
    }


def committable(
    samples: DataFrame, gallery: DataFrame, entity: str, row_id: str, gallery_id: str,
    duplicate_threshold: float, p: EnrolParams = EnrolParams(),
) -> DataFrame:
    """Samples of the sessions that may be committed: enough samples, no duplicate
    of another entity."""
    enough = samples.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= p.min_samples)
    clash = check_duplicates(samples, gallery, row_id, gallery_id, entity, duplicate_threshold)
    return samples.join(enough.select(entity), entity, "left_semi").join(clash.select(entity), entity, "left_anti")


def commit_sessions(
    samples: DataFrame, people: DataFrame, entities: DataFrame, gallery: DataFrame, row_id: str, gallery_id: str,
    duplicate_threshold: float, p: EnrolParams = EnrolParams(),
) -> dict[str, DataFrame]:
    """Commit finished sessions: the new registry, gallery and audit rows.

    ``samples`` has ``entity_id``, ``pose`` and ``embedding``; ``people`` the registry
    fields of each session's entity. A session with too few samples or a duplicate
    of another entity changes nothing.
    """
    good = checkpointed(committable(samples, gallery, "entity_id", row_id, gallery_id, duplicate_threshold, p))
    done = good.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_samples"))
    registry = upsert_entities(entities, people.join(done.select("entity_id"), "entity_id", "left_semi"))
    nth = F.row_number().over(W.partitionBy("entity_id").orderBy(row_id))
    file = F.concat(F.lit("sample_"), F.col("sample_no"), F.lit("_"), F.lower("pose"), F.lit(".jpg"))
    versions = registry.select("entity_id", "gallery_version")
    new = (
        good.withColumn("sample_no", nth.cast("long"))
        .withColumn("image_path", F.concat(F.col("entity_id"), F.lit("/"), file))
        .join(versions, "entity_id")
        .withColumn("is_active", F.lit(True))
    )
    names = people.select("entity_id", F.col("name").alias("_name"))
    details = F.concat(
        F.lit("Registered "), F.col("_name"), F.lit(" with "), F.col("_samples"), F.lit(" gallery face samples.")
    )
    return {
        "entities": registry,
        "gallery": append_gallery(gallery, new, row_id, gallery_id=gallery_id),
        "audit": audit_rows(done.join(names, "entity_id"), AUDIT_REGISTER, details),
    }
