"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import session
from sightline.session import scratch_path

__all__ = ["table", "written", "checkpointed", "scratch_path", "texts_of", "batches", "utf8", "ragged", "worker_store", "spread_join"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder: for tables far smaller than the input, in
    few files, at most three per core."""
    return session.checkpointed(df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism))


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty text."""
    return ["" if v is None else v for v in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a column, without decoding; null is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if v is None else v for v in column.cast(kind).to_pylist()]


def batches(schema: pa.Schema, rows: Callable, step: int = 512, per_task: bool = False) -> Callable:
    """A mapInArrow function that turns every ``step`` rows into the columns rows() gives.

    With ``per_task``, rows() is called once a task and gives the function to use.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = rows() if per_task else rows
        for batch in (whole.slice(k, step) for whole in stream for k in range(0, len(whole), step)):
            columns = made(batch)
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(columns.values(), schema.types, strict=True)],
                schema=schema,
            )

    return run


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start..start+length of many runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def worker_store() -> dict:
    """A dict that lasts as long as the Python worker, from one task to the next."""
    return sys.modules.setdefault("_worker_store", types.ModuleType("_worker_store")).__dict__


HOT_SHARE = 256


def spread_join(many: DataFrame, one: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``many`` joined with ``one``, whose keys are unique and whose ``weight`` counts the rows of
    ``many`` that have the key; ``total`` is their sum or more.

    A key with a 256th of all rows or more would fill one task. There are at most 256 such keys,
    so their rows of ``one`` are broadcast; the rest is shuffled. ``one`` should be a stored table.
    """
    hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    above, below = F.broadcast(one.where(hot)), one.where(~hot)
    left = many.join(above.select(key), key, "left_anti").join(below, key)
    return many.join(above, key).unionByName(left)
