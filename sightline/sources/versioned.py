"""Keyed tables on plain files whose changes rewrite only the partitions they touch.

Rows are dealt by a hash of their key to a fixed number of partitions. A change reads and writes
those of its keys, under the number of the new version; a small Parquet manifest then names, for
every partition, the version that holds it. A version exists once its manifest does, so a writer that dies
before leaves the last version as it was and does not stand in the way of the next; readers of older
versions are not disturbed. Files are written under a name of their own and never replaced. There is
one writer at a time: one that finds its version taken fails, and so do readers of a version
that two wrote at the same moment. Files of old versions and dead writers stay until the caller removes them.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_PART = 1_000_000
MOST_PARTS = 10_000
MANIFEST = "part int, at string, parts int, layout string"


@dataclass(frozen=True)
class KeyedTable:
    """A table under ``root``; ``key`` names the column whose hash deals its rows. Null keys share one partition."""

    root: str
    key: str

    def _place(self, parts: int, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(parts)).cast("int")

    def _manifests(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MANIFEST + ", version long").parquet(f"{self.root}/manifests")

    def version(self, spark: SparkSession) -> int | None:
        """The newest version, or None where the table was never written."""
        try:
            return self._manifests(spark).agg(F.max("version")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _manifest(self, spark: SparkSession, version: int | None) -> tuple[int, int, T.StructType, dict[int, str]]:
        """Version, number of partitions, row type, and the folder that holds each partition: at most ``MOST_PARTS``."""
        version = self.version(spark) if version is None else version
        if version is None:
            raise FileNotFoundError(f"no version of a table under {self.root}")
        rows = self._manifests(spark).where(F.col("version") == version).collect()
        if not rows:
            raise FileNotFoundError(f"no version {version} of a table under {self.root}")
        head, *others = [r for r in rows if r["part"] < 0]
        if others:
            raise RuntimeError(f"version {version} under {self.root} has two writers")
        return version, head["parts"], T.StructType.fromJson(json.loads(head["layout"])), {r["part"]: r["at"] for r in rows if r["part"] >= 0}

    def _files(self, spark: SparkSession, layout: T.StructType, held: dict[int, str]) -> DataFrame:
        if not held:
            return spark.createDataFrame([], layout)
        paths = [f"{self.root}/rows/at={at}/_part={part}" for part, at in sorted(held.items())]
        return spark.read.schema(layout).parquet(*paths)

    def _write(self, rows: DataFrame, version: int, parts: int, held: dict[int, str], touched: list[int] | None) -> int:
        spark = rows.sparkSession
        if clash := {"_part"} & set(rows.columns):
            raise ValueError(f"{clash} is the name of a column of the table's own")
        place = self._place(parts)
        if touched is not None:
            ours = F.array_contains(F.array(*[F.lit(t) for t in touched]), place)
            place = F.when(ours, place).otherwise(F.raise_error(F.lit("the change gave a key outside its partitions")).cast("int"))
        # Rebalanced rather than repartitioned: a partition with a key of very many rows gets several tasks.
        at = f"{version}-{uuid.uuid4().hex}"
        path = f"{self.root}/rows/at={at}"
        rows.withColumn("_part", place).hint("rebalance", "_part").write.partitionBy("_part").parquet(path)
        written = spark.read.schema(T.StructType([*rows.schema, T.StructField("_part", T.IntegerType())])).parquet(path)
        new = {r["_part"] for r in written.select("_part").distinct().collect()}
        gone = set(touched) if touched is not None else set(held)
        held = {p: folder for p, folder in held.items() if p not in gone} | dict.fromkeys(new, at)
        if (self.version(spark) or 0) != version - 1:
            raise RuntimeError(f"version {version} under {self.root} was taken by another writer")
        entries = [(-1, at, parts, rows.schema.json()), *((p, folder, parts, None) for p, folder in sorted(held.items()))]
        spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifests/version={version}")
        return version

    def create(self, rows: DataFrame, parts: int | None = None) -> int:
        """Write the first version, in one partition per ``ROWS_PER_PART`` rows if no number is given."""
        parts = parts or min(MOST_PARTS, max(1, math.ceil(rows.count() / ROWS_PER_PART)))
        return self._write(rows, 1, parts, {}, None)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        _, _, layout, held = self._manifest(spark, version)
        return self._files(spark, layout, held)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``, read from their partitions alone."""
        spark = keys.sparkSession
        _, parts, layout, held = self._manifest(spark, None)
        touched = self._touched(keys, parts)
        return self._files(spark, layout, {p: at for p, at in held.items() if p in touched}).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _touched(self, keys: DataFrame, parts: int) -> list[int]:
        return sorted(r["p"] for r in keys.select(self._place(parts).alias("p")).distinct().collect())

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Apply ``change`` to the partitions that hold ``keys`` (old rows or new ones); returns the new version.

        ``change`` gets those partitions' rows, of other keys too, and returns all that are to stand there,
        in the same layout. No keys: the newest version stays.
        """
        spark = keys.sparkSession
        version, parts, layout, held = self._manifest(spark, None)
        touched = self._touched(keys, parts)
        if not touched:
            return version
        old = self._files(spark, layout, {p: at for p, at in held.items() if p in touched})
        new = change(old)
        if missing := {f.name for f in layout} ^ set(new.columns):
            raise ValueError(f"the change adds or drops columns: {sorted(missing)}")
        new = new.select(*[F.col(f.name).cast(f.dataType) for f in layout])
        return self._write(new, version + 1, parts, held, touched)

    def holders(self, spark: SparkSession, version: int | None = None) -> dict[int, int]:
        """Which version wrote each partition that holds rows."""
        return {p: int(at.split("-")[0]) for p, at in self._manifest(spark, version)[3].items()}
