"""Greedy keep in rank order: near-duplicate removal and box suppression.

Groups up to ``block_rows`` take one pass: shuffle by key, sort by rank, walk.
A larger group is resolved in rounds. Each round takes the next ``block_rows``
best open rows of the group (Spark's group limit cuts them down before the
shuffle), resolves them, and lets the kept ones strike out open rows spread over
many tasks. The outcome equals the single walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.operators import kernels
from sightline.session import checkpointed

BLOCK_ROWS = 20_000
LANES = 64


def _scan(rows: DataFrame, keys: list[str], order: list[Column], conflict, cap: int | None) -> DataFrame:
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(kernels.greedy_scan(keys, conflict, rows.columns, cap), rows.schema)


def _strike(open_rows: DataFrame, kept: DataFrame, keys: list[str], conflict, lanes: int, row_id: str) -> DataFrame:
    """Open rows that conflict with no kept row of their key."""
    cell = [*keys, "_lane"]
    columns = open_rows.columns
    left = kept.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("_side", F.lit(0))
    right = open_rows.withColumn("_lane", F.pmod(F.xxhash64(row_id), F.lit(lanes)).cast("int")).withColumn(
        "_side", F.lit(1)
    )
    rows = left.unionByName(right).repartition(*cell).sortWithinPartitions(*cell, "_side")
    return rows.mapInArrow(kernels.drop_conflicts(cell, conflict, columns), open_rows.schema)


def _without_copies(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best row of each set of equal vectors of a key.

    A copy clashes with whatever its best copy clashes with, and with that copy
    itself, so the others are never kept. The group limit drops most of them
    before the shuffle.
    """
    nth = F.row_number().over(W.partitionBy(*keys, "_vec").orderBy(*order))
    return rows.withColumn("_rn", nth).where(F.col("_rn") == 1).drop("_rn")


def greedy_keep(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    vec: Column,
    conflict,
    row_id: str,
    cap: int | None = None,
    block_rows: int = BLOCK_ROWS,
    lanes: int = LANES,
) -> DataFrame:
    """Keep, per key and in ``order``, each row that conflicts with no kept row.

    ``vec`` is an ``ARRAY<DOUBLE>`` the conflict test reads; rows without it are
    dropped. ``order`` must be total. ``cap`` stops a key after that many.
    """
    rows = df.withColumn("_vec", vec).where(F.col("_vec").isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    if sizes.isEmpty():
        return _scan(rows, keys, order, conflict, cap).drop("_vec")

    big = checkpointed(sizes.drop("_n"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    match = reduce(lambda a, b: a & b, same)
    small = rows.alias("a").join(big.alias("b"), match, "left_anti")
    open_rows = checkpointed(_without_copies(rows.alias("a").join(big.alias("b"), match, "left_semi"), keys, order))
    results = [_scan(small, keys, order, conflict, cap)]
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    while not open_rows.isEmpty():
        head = open_rows.withColumn("_rn", nth).where(F.col("_rn") <= block_rows).drop("_rn")
        head = checkpointed(head)
        kept = checkpointed(_scan(head, keys, order, conflict, cap))
        results.append(kept)
        rest = open_rows.join(head.select(row_id), row_id, "left_anti")
        open_rows = checkpointed(_strike(rest, kept, keys, conflict, lanes, row_id))
    merged = reduce(DataFrame.unionByName, results)
    if cap is not None:
        merged = merged.withColumn("_rn", nth).where(F.col("_rn") <= cap).drop("_rn")
    return merged.drop("_vec")


def deduplicate(
    captures: DataFrame,
    keys: list[str],
    row_id: str,
    quality: str = "quality",
    embedding: str = "embedding",
    threshold: float = 0.90,
    **options,
) -> DataFrame:
    """Best-quality-first near-duplicate removal by cosine."""
    order = [F.desc(quality), F.asc(row_id)]
    vec = F.col(embedding).cast("array<double>")
    return greedy_keep(captures, keys, order, vec, kernels.VectorConflict(threshold), row_id, **options)


def fill_buffer(
    captures: DataFrame,
    keys: list[str],
    ts: str,
    row_id: str,
    embedding: str = "embedding",
    threshold: float = 0.90,
    capacity: int = 30,
    **options,
) -> DataFrame:
    """First ``capacity`` captures per key, in time order, that are no near-duplicates."""
    order = [F.asc(ts), F.asc(row_id)]
    vec = F.col(embedding).cast("array<double>")
    return greedy_keep(
        captures, keys, order, vec, kernels.VectorConflict(threshold), row_id, cap=capacity, **options
    )


def suppress_boxes(
    boxes: DataFrame, keys: list[str], rank: Column, row_id: str, threshold: float = 0.40, **options
) -> DataFrame:
    """Keep one box per place: drop a box whose IoU with a better kept one ≥ ``threshold``."""
    corners = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    ranked = boxes.withColumn("_rank", rank)
    order = [F.desc("_rank"), F.asc(row_id)]
    kept = greedy_keep(ranked, keys, order, corners, kernels.BoxConflict(threshold), row_id, **options)
    return kept.drop("_rank")
