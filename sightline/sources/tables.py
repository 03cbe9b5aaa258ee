"""Readers of the persisted tables and of the file formats around them."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.schemas import GALLERY_MAP, SOURCE_FILE, TABLES

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of the persisted tables, with its explicit schema."""
    return spark.read.schema(TABLES[name]).parquet(path)


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary``, or ``fallback`` when ``primary`` has no rows."""
    return primary.unionByName(fallback.where(~primary.exists()), allowMissingColumns=True)


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Detections of several sources as one table."""
    out = first
    for df in others:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source settings from a JSON array file.

    The id falls back from ``id`` to ``camera_id`` to ``cam_NN`` by position;
    missing fields get their defaults. Credentials and device addresses are not in
    the schema and are never read. An empty file gives one default source.
    """
    items = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.from_json("value", SOURCE_FILE)).alias("pos", "c")
    )
    place = F.col("pos") + 1
    numbered = F.format_string("cam_%02d", place)
    key = F.coalesce(F.nullif("c.id", F.lit("")), F.nullif("c.camera_id", F.lit("")), numbered)
    enabled = F.coalesce("c.enabled", F.lit(True))
    rows = items.withColumn("source_id", key).select(
        place.cast("long").alias("id"),
        "source_id",
        F.coalesce("c.name", F.concat(F.lit("Camera "), F.col("source_id"))).alias("name"),
        F.coalesce("c.location", F.lit("Default Location")).alias("location"),
        enabled.alias("enabled"),
        F.coalesce("c.rotation", F.lit(0)).alias("rotation"),
        F.coalesce(F.nullif("c.fps_limit", F.lit(0)), F.lit(15)).alias("fps_limit"),
        F.when(enabled, "ONLINE").otherwise("OFFLINE").alias("status"),
    )
    default = spark.range(1, 2).select(
        "id", F.lit("default_cam").alias("source_id"), F.lit("Default Camera").alias("name"),
        F.lit("Default Location").alias("location"), F.lit(True).alias("enabled"), F.lit(0).alias("rotation"),
        F.lit(15).alias("fps_limit"), F.lit("ONLINE").alias("status"),
    )
    return with_fallback(rows, default)


def read_gallery_map(spark: SparkSession, path: str) -> DataFrame:
    """Gallery rows from files that hold one JSON object keyed by gallery id."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", GALLERY_MAP)).alias("k", "v"))
    return entries.select(
        F.col("k").cast("long").alias("gallery_id"), F.col("v.person_id").alias("entity_id"),
        F.col("v.name").alias("name"), F.col("v.embedding").alias("embedding"),
    )


def _from_blob(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4").astype("f8"))


def _to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def decode_embedding(blob: Column) -> Column:
    """Float32 bytes as ``ARRAY<DOUBLE>``, an Arrow batch at a time."""
    return F.pandas_udf(_from_blob, "array<double>")(blob)


def encode_embedding(vector: Column) -> Column:
    return F.pandas_udf(_to_blob, "binary")(vector)


def extract_embeddings(
    images: DataFrame, extract: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """Hook for an embedding model: ``extract`` turns batches of image rows into batches
    with an ``embedding`` column. No model is part of this package."""
    return images.mapInPandas(extract, schema)


def json_list(values: Column) -> Column:
    return F.to_json(values)


def parse_json_list(text: Column) -> Column:
    """``ARRAY<STRING>`` of a JSON array column; empty when the text is missing."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
