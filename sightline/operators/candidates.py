"""Candidates: unknown tracks kept for review, listed, queued and merged."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.text import basename, stamp
from sightline.operators.numbering import dense_ids
from sightline.operators.similarity import similarity_topk
from sightline.params import CANDIDATE_QUALITY, CANDIDATE_STATUS
from sightline.session import checkpointed
from sightline.sources.tables import encode_embedding, json_list

LOG = logging.getLogger(__name__)


def create_candidates(tracks: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Candidate and first-image rows of unknown tracks.

    ``tracks`` has ``track_id``, ``source_id``, ``image_path`` and ``embedding``. The
    id is made from the track, so a recomputed task writes the same one.
    """
    rows = tracks.withColumn("candidate_id", F.concat(F.lit("CAND_"), F.upper(F.substring(F.sha1("track_id"), 1, 12))))
    candidates = rows.select(
        "candidate_id", F.lit(CANDIDATE_STATUS).alias("status"), F.lit(CANDIDATE_QUALITY).alias("avg_quality"),
        json_list(F.array("source_id")).alias("seen_sources"), as_of.alias("first_seen"), as_of.alias("last_seen"),
        as_of.alias("created_at"),
    )
    images = rows.select(
        "candidate_id", "image_path", encode_embedding(F.col("embedding")).alias("embedding_blob"),
        F.lit(CANDIDATE_QUALITY).alias("quality_score"), F.lit("FRONTAL").alias("pose_bin"), "source_id", as_of.alias("created_at"),
    )
    return candidates, images


def list_candidates(candidates: DataFrame, images: DataFrame, status: str | None = None) -> DataFrame:
    """Candidates, newest first, with their number of images."""
    rows = candidates.where(F.col("status") == status) if status else candidates
    counts = images.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("image_count"))
    return (
        rows.join(counts, "candidate_id", "left")
        .withColumn("image_count", F.coalesce("image_count", F.lit(0)))
        .orderBy(F.desc("created_at"), "candidate_id")
    )


def candidate_images(candidates: DataFrame, images: DataFrame) -> DataFrame:
    """One row per image with its link, flat, so no candidate's list must fit a task."""
    url = F.concat(F.lit("/faces/candidates/"), F.col("candidate_id"), F.lit("/"), basename(F.col("image_path")))
    linked = images.withColumn("image_url", url).withColumn("created", stamp(F.col("created_at"))).drop("created_at")
    return candidates.select("candidate_id", "status").join(linked, "candidate_id", "left")


def review_queue(
    images: DataFrame, key: str = "candidate_id", min_captures: int = 10, min_best: int = 4,
    min_quality: float = 0.65, min_sources: int = 1, best_quality: float = 0.8,
) -> DataFrame:
    """Candidates with enough captures, good captures, quality and sources."""
    return (
        images.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("captures"),
            F.count_if(F.col("quality_score") >= best_quality).alias("best"),
            F.round(F.avg("quality_score"), 6).alias("avg_quality"),
            F.count_distinct("source_id").alias("sources"),
        )
        .where(
            (F.col("captures") >= min_captures) & (F.col("best") >= min_best)
            & (F.col("avg_quality") >= min_quality) & (F.col("sources") >= min_sources)
        )
    )


FIRST_RUN = 4096
RUN_GROWTH = 8


def _unstruck(rows: DataFrame, kept: DataFrame, row_id: str, floor: float, options: dict) -> DataFrame:
    """The rows without an earlier rival among the kept ones."""
    struck = similarity_topk(rows, kept, row_id, row_id, 1, floor, **options)
    return rows.join(struck.select(row_id), row_id, "left_anti")


def _settled(left: DataFrame, row_id: str, floor: float, options: dict) -> list[DataFrame]:
    """The kept rows of one run, a table for each round."""
    kept, number, n_open = [], 0, left.count()
    while n_open:
        rivals = similarity_topk(left, left, row_id, row_id, 1, floor, **options)
        marked = checkpointed(left.join(rivals.select(row_id, F.lit(True).alias("_rival")), row_id, "left"))
        free = marked.where("_rival IS NULL").drop("_rival")
        kept.append(free)
        left = checkpointed(_unstruck(marked.where("_rival").drop("_rival"), free, row_id, floor, options))
        number, before, n_open = number + 1, n_open, left.count()
        LOG.info("round %d: %d of %d rows still open", number, n_open, before)
    return kept


def first_independent(
    rows: DataFrame, row_id: str, order: str, floor: float, embedding: str = "embedding", **options
) -> DataFrame:
    """The rows that a walk in order (then id) keeps when it drops each row that is at least
    ``floor`` similar to a kept one.

    The order is cut into runs, each ``RUN_GROWTH`` times as long as all before it. A run holds
    only the rows that the runs before it left open; its kept rows strike out their rivals in all
    that follows. So the table meets the kept rows, not itself, and rows are compared with each other
    within what a run has open.

    A run is resolved in rounds over all tasks: a row without an open earlier rival is kept,
    and kept rows strike out their rivals. Only the best rival of a row is ever written down. The
    number of rounds is the length of the longest chain of rivals in a run, not of the table; each
    round compares the rows still open. Equal vectors are one row from the start.
    """
    vec = F.col(embedding).cast("array<double>")
    slim = rows.where(F.col(embedding).isNotNull()).select(*dict.fromkeys([row_id, order]), vec.alias("embedding"))
    nth = F.row_number().over(W.partitionBy("embedding").orderBy(order, row_id))
    once = slim.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    placed = once.withColumn("_place", F.struct(F.col(order).cast("double"), F.col(row_id)))
    left = checkpointed(dense_ids(placed, "_place", "_at").drop("_place"))
    options = {"label": row_id, "earlier": order, **options}
    kept, total, end = [], left.count(), FIRST_RUN
    while True:
        found = _settled(left.where(F.col("_at") < end), row_id, floor, options)
        kept += found
        if end >= total:
            break
        left = left.where(F.col("_at") >= end)
        if found:
            openers = reduce(DataFrame.unionByName, found)
            left = checkpointed(_unstruck(left, openers, row_id, floor, options))
        end *= RUN_GROWTH
    chosen = reduce(DataFrame.unionByName, kept, left.limit(0)).select(row_id)
    return rows.join(chosen, row_id, "left_semi")


def merge_candidates(
    tracks: DataFrame, row_id: str, order: str, threshold: float = 0.75, embedding: str = "embedding", **options
) -> DataFrame:
    """Candidate of each unknown track: in time order a track joins the most similar
    open candidate above ``threshold``, else it opens one.

    The openers are the rows that a walk in order of time, then id, would keep; every other
    track is then looked up among the openers before it in that order.
    """
    above = threshold + 1e-12
    openers = checkpointed(first_independent(tracks, row_id, order, above, embedding, **options))
    rest = tracks.join(openers.select(row_id), row_id, "left_anti")
    joined = similarity_topk(
        rest, openers, row_id, row_id, 1, above, query_vec=embedding, gallery_vec=embedding, label=row_id,
        earlier=order, **options,
    )
    opened = openers.select(row_id, F.col(row_id).alias("candidate"), F.lit(1.0).alias("similarity"))
    return opened.unionByName(joined.select(row_id, F.col("match_id").alias("candidate"), "similarity"))
