"""Matching decisions on top of the blocked similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.text import match_status
from sightline.functions.vector import centroid_normalize
from sightline.operators.similarity import similarity_topk
from sightline.params import DuplicateParams, MatchParams


def match_entities(
    probes: DataFrame, gallery: DataFrame, probe_id: str, gallery_id: str, p: MatchParams = MatchParams(), **options
) -> DataFrame:
    """Best entity per probe by its best vector, decided at ``accept``.

    The index is exact, so checking all vectors of the top-k entities and taking
    the best equals the best single vector; only that one is looked up.
    Columns: probe id, ``entity_id`` ('unknown' below ``accept``), ``similarity``.
    """
    return decided(probes, similarity_topk(probes, gallery, probe_id, gallery_id, 1, p.floor, **options), probe_id, p)


def decided(probes: DataFrame, hits: DataFrame, probe_id: str, p: MatchParams = MatchParams()) -> DataFrame:
    """The decision on each probe from its best hit, if it has one."""
    joined = probes.select(probe_id).join(hits, probe_id, "left")
    accepted = F.coalesce(F.col("similarity") >= p.accept, F.lit(False))
    return joined.select(
        probe_id,
        F.when(accepted, F.col("match_label")).otherwise("unknown").alias("entity_id"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 4).alias("similarity"),
    )


def match_with_status(
    probes: DataFrame, gallery: DataFrame, probe_id: str, gallery_id: str, p: MatchParams = MatchParams(), **options
) -> DataFrame:
    """Like ``match_entities`` but keeps a possible match's entity (floor ≤ sim < accept)."""
    hits = similarity_topk(probes, gallery, probe_id, gallery_id, 1, p.floor, **options)
    joined = probes.select(probe_id).join(hits, probe_id, "left")
    similarity = F.coalesce("similarity", F.lit(0.0))
    return joined.select(
        probe_id,
        F.coalesce("match_label", F.lit("unknown")).alias("entity_id"),
        F.round(similarity, 4).alias("similarity"),
        match_status(similarity, p).alias("status"),
    )


def single_shot(
    faces: DataFrame, gallery: DataFrame, face_id: str, gallery_id: str, landmarks: str | None = None,
    p: MatchParams = MatchParams(), **options,
) -> DataFrame:
    """Stateless match at max(accept, single_shot_min): recognized, low_confidence,
    unknown, or no_landmarks."""
    strong = max(p.accept, p.single_shot_min)
    usable = F.size(landmarks) >= 5 if landmarks else F.lit(True)
    hits = similarity_topk(faces.where(usable), gallery, face_id, gallery_id, 1, p.floor, **options)
    joined = faces.select(face_id, usable.alias("_usable")).join(hits, face_id, "left")
    sure = F.coalesce(F.col("similarity") >= strong, F.lit(False))
    return joined.select(
        face_id,
        F.when(sure, F.col("match_label")).otherwise("unknown").alias("entity_id"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 4).alias("similarity"),
        F.when(~F.col("_usable"), "no_landmarks")
        .when(sure, "recognized")
        .when(F.col("similarity").isNotNull(), "low_confidence")
        .otherwise("unknown")
        .alias("status"),
    )


def best_other_entity(
    vectors: DataFrame, gallery: DataFrame, vector_id: str, gallery_id: str, entity: str, floor: float, **options
) -> DataFrame:
    """Best gallery hit of another entity per new vector."""
    return similarity_topk(
        vectors, gallery, vector_id, gallery_id, 1, floor,
        label=entity, query_label=entity, exclude_label=True, **options,
    )


def check_duplicates(
    vectors: DataFrame, gallery: DataFrame, vector_id: str, gallery_id: str, entity: str = "entity_id",
    threshold: float = MatchParams().accept, **options,
) -> DataFrame:
    """One row per entity whose vectors hit another entity: the first vector's hit."""
    hits = best_other_entity(vectors, gallery, vector_id, gallery_id, entity, threshold, **options)
    named = vectors.select(vector_id, entity).join(hits, vector_id)
    first = F.min_by(F.struct(vector_id, "match_label", "similarity"), F.col(vector_id))
    return named.groupBy(entity).agg(first.alias("_b")).select(
        entity, F.col(f"_b.{vector_id}").alias(vector_id),
        F.col("_b.match_label").alias("matched_entity"), F.col("_b.similarity").alias("similarity"),
    )


def assess_duplicates(
    vectors: DataFrame, gallery: DataFrame, vector_id: str, gallery_id: str, entity: str = "entity_id",
    p: DuplicateParams = DuplicateParams(), **options,
) -> DataFrame:
    """Graded duplicate level per entity: none, soft or hard, with the best match."""
    hits = best_other_entity(vectors, gallery, vector_id, gallery_id, entity, p.soft, **options)
    named = vectors.select(vector_id, entity).join(hits, vector_id, "left")
    order = F.struct(F.col("similarity"), -F.col(vector_id))
    best = F.max_by(F.struct("match_label", "similarity"), F.when(F.col("similarity").isNotNull(), order))
    similarity = F.col("_b.similarity")
    return named.groupBy(entity).agg(best.alias("_b")).select(
        entity,
        F.when(similarity >= p.hard, "hard").when(similarity >= p.soft, "soft").otherwise("none").alias("level"),
        F.col("_b.match_label").alias("matched_entity"),
        F.round(F.coalesce(similarity, F.lit(0.0)), 4).alias("similarity"),
    )


def near_duplicates(
    queries: DataFrame, existing: DataFrame, query_id: str, existing_id: str, by: str,
    threshold: float = DuplicateParams().near, exclude_id: bool = False, **options,
) -> DataFrame:
    """Per query: the largest cosine to the set with the same key and whether it is
    a near-duplicate. An empty set gives (0.0, false)."""
    hits = similarity_topk(
        queries, existing, query_id, existing_id, 1, -1.0, by=by, exclude_id=exclude_id, **options
    )
    joined = queries.select(query_id).join(hits.select(query_id, "similarity"), query_id, "left")
    similarity = F.coalesce("similarity", F.lit(0.0))
    return joined.select(
        query_id, similarity.alias("max_similarity"), (similarity >= threshold).alias("is_duplicate")
    )


def entity_similarities(
    queries: DataFrame, gallery: DataFrame, query_id: str, gallery_id: str, k: int, floor: float, **options
) -> DataFrame:
    """Best similarity per query and entity, the ``k`` best entities of each query."""
    return similarity_topk(queries, gallery, query_id, gallery_id, k, floor, per_label=True, **options)


def centroids(
    vectors: DataFrame, key: str, order: list[str], embedding: str = "embedding", limit: int | None = None,
    similarity: str | None = None, least: float = 0.60,
) -> DataFrame:
    """Unit mean vector per key, of its first ``limit`` vectors when given, and only of
    those whose ``similarity`` is at ``least`` or above when that column is named.

    The mean is taken per dimension, so no key's vectors are gathered anywhere.
    """
    rows = vectors if similarity is None else vectors.where(F.col(similarity) >= least)
    if limit is not None:
        nth = F.row_number().over(W.partitionBy(key).orderBy(*order))
        rows = rows.withColumn("_rn", nth).where(F.col("_rn") <= limit)
    mean = (
        rows.select(key, F.posexplode(F.col(embedding).cast("array<double>")).alias("_pos", "_value"))
        .groupBy(key, "_pos")
        .agg(F.avg("_value").alias("_mean"))
    )
    packed = mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_mean"))).alias("_dims"))
    return packed.select(key, centroid_normalize(F.transform("_dims", lambda d: d["_mean"])).alias("centroid"))


def consensus(votes: DataFrame, track: list[str], entity: str, similarity: str, order: list[str], vote: str = "max") -> DataFrame:
    """Winning entity of a track's votes by its largest (or average) similarity;
    the entity voted for first wins a tie."""
    score = F.max(similarity) if vote == "max" else F.avg(similarity)
    per_entity = votes.groupBy(*track, entity).agg(
        score.alias("_score"), F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_votes")
    )
    best = F.min_by(F.struct(entity, "_score", "_votes"), F.struct(-F.col("_score"), F.col("_first")))
    return per_entity.groupBy(*track).agg(best.alias("_b")).select(
        *track, F.col(f"_b.{entity}").alias(entity), F.col("_b._score").alias("similarity"),
        F.col("_b._votes").alias("votes"),
    )
