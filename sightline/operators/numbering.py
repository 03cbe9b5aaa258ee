"""Dense numbering over a unique long id without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.session import checkpointed

RANGE_ROWS = 1 << 20


def dense_ids(
    df: DataFrame, order_id: str, out: str, start: Column | int = 0, span: int = RANGE_ROWS, sparse: bool = True
) -> DataFrame:
    """Append ``out``: ``start``, ``start``+1, … in the order of the unique ``order_id``.

    Rows are range-partitioned by sampled bounds and numbered inside their partition;
    the counts per partition give each its offset, whatever holes the ids have. The
    partitioned rows are checkpointed, because a recomputed sample could move the bounds.

    Without ``sparse`` the ids are taken to be nearly dense: they fall into ranges of
    ``span`` values, which needs no checkpoint, and the table of range counts stays short.
    """
    if sparse:
        parts = df.repartitionByRange(order_id).sortWithinPartitions(order_id).withColumn("_range", F.spark_partition_id())
        inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
        ranged = checkpointed(parts.withColumn("_inside", inside))
    else:
        place = F.expr(f"({order_id} - pmod({order_id}, {span}L)) div {span}L")
        number = F.row_number().over(W.partitionBy("_range").orderBy(order_id))
        ranged = df.withColumn("_range", place).withColumn("_inside", number)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        ranged.join(offsets, "_range")
        .withColumn(out, (first + F.col("_offset") + F.col("_inside") - 1).cast("long"))
        .drop("_range", "_inside", "_offset")
    )
