"""Stored top-k matches brought up to date after a gallery change.

Queries that are still open meet only the vectors that came in. A stored list of fewer than ``k``
hits is whole: losing some leaves the rest right. A full list hides what came after its last
hit, so a query searches the whole gallery anew only where, after the change, fewer than
``k`` of its hits come at or before that place. The result equals a new search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.operators.match import decided
from sightline.operators.similarity import similarity_topk
from sightline.params import MatchParams
from sightline.session import checkpointed


def refresh_topk(
    found: DataFrame, queries: DataFrame, gallery: DataFrame, added: DataFrame, removed: DataFrame,
    query_id: str, gallery_id: str, k: int, floor: float, **options,
) -> DataFrame:
    """``found``, the hits of ``similarity_topk`` before the change, made those of ``gallery`` after it.

    ``added`` holds the new gallery rows, ``removed`` the ids of those that went; a row whose vector,
    label or other compared column changed stands in both. ``k``, ``floor`` and ``options`` must be those of
    ``found``. Queries that are no longer in ``queries`` lose their hits; those that were never
    searched must be searched by ``similarity_topk``, since no hits look like an empty list.
    Rows without a vector are in no list; repeated rows in ``removed`` count once.
    """
    if options.get("per_label") or options.get("distinct"):
        raise ValueError("lists by label or over several groups can't be brought up to date")
    hits = found.drop("rank").join(queries.select(query_id), query_id, "left_semi")
    gone = removed.select(F.col(gallery_id).alias("match_id")).distinct()
    kept = hits.join(gone, "match_id", "left_anti")
    fresh = similarity_topk(queries, added, query_id, gallery_id, k, floor, **options).drop("rank")
    last = found.where(F.col("rank") == k).select(query_id, F.col("similarity").alias("_s"), F.col("match_id").alias("_m"))
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("similarity"), F.asc("match_id")))
    seen = (F.col("similarity") > F.col("_s")) | (F.col("similarity") == F.col("_s")) & (F.col("match_id") <= F.col("_m"))
    merged = checkpointed(
        kept.unionByName(fresh).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
        .join(last, query_id, "left").withColumn("_sure", F.coalesce(seen, F.lit(True))).drop("_s", "_m")
    )
    # Full lists with too few sure hits, those without any hit left among them.
    sure = merged.where("_sure").groupBy(query_id).agg(F.count(F.lit(1)).alias("_n"))
    unsure = checkpointed(
        last.select(query_id).join(queries.select(query_id), query_id, "left_semi")
        .join(sure.where(F.col("_n") >= k), query_id, "left_anti")
    )
    anew = similarity_topk(queries.join(unsure, query_id, "left_semi"), gallery, query_id, gallery_id, k, floor, **options)
    settled = merged.drop("_sure").join(unsure, query_id, "left_anti")
    return settled.unionByName(anew)


def rematch_open(
    found: DataFrame, probes: DataFrame, gallery: DataFrame, added: DataFrame, removed: DataFrame,
    probe_id: str, gallery_id: str, p: MatchParams = MatchParams(), k: int = 1, **options,
) -> tuple[DataFrame, DataFrame]:
    """New decisions of the open tracks' probes after a gallery change, as ``match_entities`` would
    give them, and the hits to store for the next change. A longer list (``k``) survives more removals."""
    hits = checkpointed(refresh_topk(found, probes, gallery, added, removed, probe_id, gallery_id, k, p.floor, **options))
    return decided(probes, hits.where("rank = 1"), probe_id, p), hits
