"""Pages of the log at any offset, by a directory of row counts per range of its order.

The log is written once in ranges of its order; the directory counts each range's rows by source. A page
sums counts on the driver, one number per range, and reads only the ranges it lies in.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.reports import event_view

ROWS_PER_RANGE = 500_000
MOST_RANGES = 50_000


@dataclass(frozen=True)
class PagedLog:
    """A log under ``root`` in the order of ``by``, newest first: ``id``, or ``ts`` and then ``id``.

    Rows that are alike in the order stand in one range; null times come last.
    """

    root: str
    by: str = "id"

    def _order(self) -> list:
        return [F.desc(c) for c in dict.fromkeys((self.by, "id"))]

    def write(self, sightings: DataFrame, ranges: int | None = None) -> None:
        """Write the log's ranges, of ``ROWS_PER_RANGE`` rows if no number is given, then the directory."""
        ranges = ranges or min(MOST_RANGES, max(1, math.ceil(sightings.count() / ROWS_PER_RANGE)))
        if "_range" in sightings.columns:
            raise ValueError("_range is the name of a column of the log's own")
        dealt = sightings.repartitionByRange(ranges, *self._order()).withColumn("_range", F.spark_partition_id())
        dealt.sortWithinPartitions("_range", *self._order()).write.partitionBy("_range").parquet(f"{self.root}/rows")
        # An empty table that keeps the layout, also where the log has no rows.
        sightings.limit(0).write.parquet(f"{self.root}/layout")
        spark = sightings.sparkSession
        stored = spark.read.schema(f"source_id {sightings.schema['source_id'].dataType.simpleString()}, _range int").parquet(f"{self.root}/rows")
        counts = stored.groupBy("_range", "source_id").agg(F.count(F.lit(1)).alias("rows"))
        counts.coalesce(1).write.parquet(f"{self.root}/directory")

    def page(self, spark: SparkSession, limit: int = 50, offset: int = 0, source: str | None = None) -> DataFrame:
        """One page, as ``reports.history_page`` gives it."""
        directory = spark.read.parquet(f"{self.root}/directory")
        if source:
            directory = directory.where(F.col("source_id") == source)
        counts = directory.groupBy("_range").agg(F.sum("rows").alias("rows")).orderBy("_range").collect()
        before, skip, picked = 0, 0, []
        for r in counts:
            if before < offset + limit and before + r["rows"] > offset:
                if not picked:
                    skip = offset - before
                picked.append(f"{self.root}/rows/_range={r['_range']}")
            before += r["rows"]
        layout = spark.read.parquet(f"{self.root}/layout")
        rows = spark.read.schema(layout.schema).parquet(*picked) if picked else layout
        if source:
            rows = rows.where(F.col("source_id") == source)
        return event_view(rows.orderBy(*self._order()).offset(skip).limit(limit))
