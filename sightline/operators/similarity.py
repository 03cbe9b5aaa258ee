"""Blocked vector similarity join.

The gallery is cut into parts and the queries into lanes. A task holds one part as a
matrix while one lane streams past: each query's vector goes to every part, each gallery
row to every lane. The number of tasks follows from the cluster and a part from the
memory of a task, so what is shuffled grows with the two sides, not with their
product, as long as a part in every task holds the gallery. Only the best ``k`` hits per
query and part leave the task, and never a cross product.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.operators import kernels

BLOCK_ROWS = 32_768
LANE_ROWS = 400_000
PART_VALUES = 1 << 22  # of a part's matrix, 32 MB
TASK_PAIRS = 1 << 26  # worth a task of their own


def grid(of_gallery: int, of_queries: int, width: int, tasks: int, block_rows: int = BLOCK_ROWS, lane_rows: int = LANE_ROWS) -> tuple[int, int]:
    """(parts of the gallery, lanes of queries).

    Parts are blocks of ``block_rows`` while these are no more than ``tasks``. Beyond that there are
    ``tasks`` cells, or four times as many where there is work for them, near the ratio that
    shuffles least; a part holds ``PART_VALUES`` values at most, or a block if that is more.
    """
    wanted = tasks * min(4, max(1, of_gallery * of_queries // (TASK_PAIRS * tasks)))
    parts = math.ceil(of_gallery / block_rows)
    if parts > tasks:
        held = max(PART_VALUES // max(width, 1), block_rows)
        even = round(math.sqrt(wanted * of_gallery / max(of_queries, 1)))
        parts = min(parts, max(math.ceil(of_gallery / held), min(even, wanted)))
    parts = max(1, parts)
    return parts, max(1, math.ceil(wanted / parts), math.ceil(of_queries / lane_rows))


def similarity_topk(
    queries: DataFrame,
    gallery: DataFrame,
    query_id: str,
    gallery_id: str,
    k: int,
    floor: float,
    query_vec: str = "embedding",
    gallery_vec: str = "embedding",
    label: str = "entity_id",
    query_label: str | None = None,
    by: str | None = None,
    per_label: bool = False,
    exclude_label: bool = False,
    exclude_id: bool = False,
    earlier: str | None = None,
    distinct: bool = False,
    within: str | None = None,
    block_rows: int = BLOCK_ROWS,
    lane_rows: int = LANE_ROWS,
) -> DataFrame:
    """Best ``k`` gallery rows per query with cosine ≥ ``floor``.

    ``per_label``: the best row of each label, best ``k`` labels. ``by``: only
    rows with an equal value of that column are compared. ``exclude_label`` and
    ``exclude_id`` skip gallery rows that share the query's label or id; ``earlier``
    names a numeric column in which, ties broken by id, the gallery row must come before
    the query.
    ``distinct`` is for queries that stand in several ``by`` groups. ``within`` names an int column
    of the gallery and an array of ints of the queries: only rows named there are compared.
    Ties go to the smaller gallery id. Columns: ``query_id``, ``gallery_id``,
    ``label``, ``similarity``, ``rank``.
    """
    if within and per_label:
        raise ValueError("within and per_label do not go together")
    spark = queries.sparkSession
    id_type = gallery.schema[gallery_id].dataType
    label_type = gallery.schema[label].dataType
    position = F.col(earlier).cast("double") if earlier else F.lit(0.0)
    own_label = F.col(query_label) if query_label else F.lit(None)
    own_id = F.col(query_id).cast(id_type) if exclude_id or earlier else F.lit(None).cast(id_type)

    g = gallery.where(F.col(gallery_vec).isNotNull()).select(
        *([F.col(by).alias("_by")] if by else []),
        F.lit(None).cast(queries.schema[query_id].dataType).alias("_qid"),
        F.col(gallery_id).alias("_gid"),
        F.col(label).alias("_label"),
        F.col(gallery_vec).cast("array<double>").alias("_vec"),
        position.alias("_pos"),
        (F.array(within) if within else F.lit(None).cast("array<int>")).alias("_within"),
    )
    q = queries.where(F.col(query_vec).isNotNull()).select(
        *([F.col(by).alias("_by")] if by else []),
        F.col(query_id).alias("_qid"),
        own_id.alias("_gid"),
        own_label.cast(label_type).alias("_label"),
        F.col(query_vec).cast("array<double>").alias("_vec"),
        position.alias("_pos"),
        (F.col(within) if within else F.lit(None)).cast("array<int>").alias("_within"),
    )

    if by:
        g, q = g.where(F.col("_by").isNotNull()), q.where(F.col("_by").isNotNull())
        # Only keys above the block or lane size need more than one cell.
        sizes = (
            g.select("_by", F.lit(1).alias("g"), F.lit(0).alias("q"))
            .unionByName(q.select("_by", F.lit(0).alias("g"), F.lit(1).alias("q")))
            .groupBy("_by")
            .agg(F.sum("g").alias("g"), F.sum("q").alias("q"))
            .where((F.col("g") > block_rows) | (F.col("q") > lane_rows))
            .select(
                "_by",
                F.ceil(F.col("g") / block_rows).cast("int").alias("_nb"),
                F.ceil(F.col("q") / lane_rows).cast("int").alias("_nl"),
            )
        )
        g = g.join(sizes, "_by", "left")
        q = q.join(sizes, "_by", "left")
        blocks, lanes = F.coalesce("_nb", F.lit(1)), F.coalesce("_nl", F.lit(1))
        cell = ["_by", "_block", "_lane"]
        several = True
    else:
        # One pass over the slim sides counts both; blocks are the parts here.
        sides = g.select(F.lit(1).alias("g"), F.size("_vec").alias("w")).unionByName(q.select(F.lit(0).alias("g"), F.lit(0).alias("w")))
        of_gallery, all_rows, width = sides.agg(F.coalesce(F.sum("g"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("w"), F.lit(1))).first()
        n_blocks, n_lanes = grid(of_gallery, all_rows - of_gallery, width, spark.sparkContext.defaultParallelism, block_rows, lane_rows)
        blocks, lanes = F.lit(n_blocks), F.lit(n_lanes)
        cell = ["_block", "_lane"]
        several = n_blocks > 1

    one = F.lit(1)
    g = g.withColumn("_block", F.pmod(F.xxhash64("_gid"), F.greatest(blocks, one)).cast("int")).withColumn(
        "_lane", F.explode(F.sequence(F.lit(0), F.greatest(lanes, one) - 1))
    )
    q = q.withColumn("_lane", F.pmod(F.xxhash64("_qid"), F.greatest(lanes, one)).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.greatest(blocks, one) - 1))
    )
    columns = [*cell, "_side", "_qid", "_gid", "_label", "_vec", "_pos", *(["_within"] if within else [])]
    rows = g.withColumn("_side", F.lit(0)).select(columns).unionByName(
        q.withColumn("_side", F.lit(1)).select(columns)
    )
    order = ["_side", *(["_within"] if within else []), *(["_label"] if per_label else []), "_gid"]
    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType, True),
            T.StructField("match_id", id_type, True),
            T.StructField("match_label", label_type, True),
            T.StructField("similarity", T.DoubleType(), True),
        ]
    )
    if by:
        placed = rows.repartition(*cell)
    else:  # one cell per partition: an even spread, and one block in memory per task
        placed = rows.repartitionById(n_blocks * n_lanes, F.col("_block") * n_lanes + F.col("_lane"))
    hits = (
        placed.sortWithinPartitions(*cell, *order)
        .mapInArrow(
            kernels.topk_cells(
                cell, k, floor, per_label, exclude_label, exclude_id, earlier is not None, to_arrow_schema(schema), within is not None
            ),
            schema,
        )
    )
    best = [F.desc("similarity"), F.asc("match_id")]
    if distinct:
        hits = hits.dropDuplicates([query_id, "match_id"])
    if several and per_label:
        first = F.row_number().over(W.partitionBy(query_id, "match_label").orderBy(*best))
        hits = hits.withColumn("_n", first).where("_n = 1").drop("_n")
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(*best))
    return hits.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def lsh_topk(
    queries: DataFrame, gallery: DataFrame, query_id: str, gallery_id: str, k: int, floor: float,
    query_vec: str = "embedding", gallery_vec: str = "embedding", tables: int = 12, bits: int = 4, seed: int = 7,
    **options,
) -> DataFrame:
    """Approximate top-k: rows meet when the signs of ``bits`` random projections agree
    in one of ``tables`` tables; the similarity of those that meet is exact.

    A bucket that holds many rows is cut into blocks like any other key.
    """

    def bucketed(df: DataFrame, vec: str) -> DataFrame:
        codes = kernels.sign_codes(tables, bits, seed)
        coded = F.pandas_udf(codes, "array<string>")(F.col(vec).cast("array<double>"))
        return df.where(F.col(vec).isNotNull()).withColumn("_bucket", F.explode(coded))

    return similarity_topk(
        bucketed(queries, query_vec), bucketed(gallery, gallery_vec), query_id, gallery_id, k, floor,
        query_vec=query_vec, gallery_vec=gallery_vec, by="_bucket", distinct=True, **options,
    )
