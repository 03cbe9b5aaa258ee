"""Writers. Every write is a Spark job; nothing is gathered on the driver."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.reports import csv_name, csv_rows
from sightline.operators.rules import known_only


def append_sightings(sightings: DataFrame, path: str) -> None:
    """Append known sightings, partitioned by day so that range reports prune files."""
    rows = known_only(sightings).withColumn("day", F.to_date("ts"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table. ``df`` must not read from ``path``."""
    df.write.mode("overwrite").parquet(path)


def write_report_csv(sightings: DataFrame, folder: str, start: datetime, stop: datetime) -> str:
    """The report export as a folder of CSV files named after its range, in time order
    within and over the files."""
    path = f"{folder.rstrip('/')}/{csv_name(start, stop)}"
    csv_rows(sightings.orderBy("ts", "id")).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def save_gallery(gallery: DataFrame, path: str) -> None:
    """Gallery split by ``is_active``, so matching reads only the active part."""
    gallery.write.mode("overwrite").partitionBy("is_active").parquet(path)


def load_gallery(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("is_active").cast("boolean")) if active_only else rows
