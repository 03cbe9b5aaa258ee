"""Streaming sources, built-in streaming aggregates, sinks and the live flow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.match import match_with_status
from sightline.operators.rules import Feed, dispatch
from sightline.params import MatchParams
from sightline.session import scratch_path


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType | str, files: str | None = None, files_per_batch: int = 100,
    kind: str = "parquet",
) -> DataFrame:
    """Files of a folder (parquet, json, orc or csv) as a stream; the file limit
    bounds a micro-batch."""
    reader = spark.readStream.format(kind).schema(schema).option("pathGlobFilter", files or f"*.{kind}")
    return reader.option("maxFilesPerTrigger", files_per_batch).load(folder)


def table_stream(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream of one micro-batch: its files
    are in no order of time, so in several batches rows of later ones would count as late."""
    folder, _, name = path.rstrip("/").rpartition("/")
    # A pattern that fits this path alone; a plain path has to be a folder.
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all data available now; return what it wrote.

    Output and progress live in the shared folder, so a restart resumes.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
    writer.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def drain_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Run ``write(batch, batch_id, path)`` for each micro-batch; returns the path."""
    path = scratch_path(stream.sparkSession, name)
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").foreachBatch(
        lambda batch, batch_id: write(batch, batch_id, path)
    ).trigger(availableNow=True).start().awaitTermination()
    return path


def daily_counts(stream: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Events per day and source; a day is emitted once the watermark has passed it."""
    day = F.window(ts, "1 day")
    return (
        stream.withWatermark(ts, delay)
        .groupBy(day.alias("_w"), F.coalesce("source_id", F.lit("default")).alias("source_id"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.date_format("_w.start", "yyyy-MM-dd").alias("day"), "source_id", "events")
    )


def session_counts(stream: DataFrame, keys: list[str], ts: str, idle_seconds: float, delay: str = "1 hour") -> DataFrame:
    """Closed sessions per key. The window is one microsecond longer than the idle
    limit, so rows exactly that far apart stay together, as in the batch form."""
    gap = f"{int(idle_seconds)} seconds 1 microseconds"
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, F.session_window(ts, gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("rows"), F.max(ts).alias("session_end"))
        .select(*keys, F.col("_w.start").alias("session_start"), "session_end", "rows")
    )


def rate_slots(stream: DataFrame, keys: list[str], ts: str, per_second: float, delay_seconds: int = 3600) -> DataFrame:
    """The first row to arrive for each key and time slot.

    A slot is remembered for its own length at least, so that it is never given out twice.
    """
    slot = int(round(1_000_000 / per_second))
    delay = f"{max(delay_seconds, -(-slot // 1_000_000))} seconds"
    return (
        stream.withColumn("_t", F.unix_micros(ts))
        .withColumn("slot", F.expr(f"(_t - pmod(_t, {slot}L)) div {slot}L"))
        .drop("_t")
        .withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark([*keys, "slot"])
    )


def match_stream(
    probes: DataFrame, gallery: Callable[[], DataFrame], probe_id: str, gallery_id: str, name: str,
    p: MatchParams = MatchParams(),
) -> DataFrame:
    """Match a probe stream against the gallery, read anew for every micro-batch, so
    a gallery change shows from the next batch on."""

    def write(batch: DataFrame, batch_id: int, path: str) -> None:
        batch.persist()  # read for the match and for the probes without one
        found = match_with_status(batch, gallery(), probe_id, gallery_id, p)
        found.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
        batch.unpersist()

    path = drain_batches(probes, name, write)
    spark = probes.sparkSession
    if not _exists(spark, f"{path}/out"):  # no file has come
        return match_with_status(spark.createDataFrame([], probes.schema), gallery(), probe_id, gallery_id, p)
    return spark.read.parquet(f"{path}/out").drop("batch")


def _next_number(spark: SparkSession, path: str, name: str, batch_id: int) -> int:
    """The first free number of a feed: one past the last that an earlier micro-batch gave."""
    folder = f"{path}/_numbers/{name}"
    if not _exists(spark, folder):
        return 1
    last = spark.read.parquet(folder).where(F.col("batch") < batch_id).agg(F.max("last")).first()[0]
    return 1 if last is None else last + 1


def _run_feed(rows: DataFrame, feed: Feed, name: str, path: str, batch_id: int) -> None:
    """Write one feed's records of a micro-batch under the batch's id, and its last number."""
    spark, out = rows.sparkSession, f"{path}/{name}/batch={batch_id}"
    if feed.number is None:
        feed.run(rows).write.mode("overwrite").parquet(out)
        return
    first = _next_number(spark, path, name, batch_id)
    feed.run(rows, start=first).write.mode("overwrite").parquet(out)
    last = spark.read.parquet(out).agg(F.coalesce(F.max(feed.number), F.lit(first - 1)).cast("long").alias("last"))
    last.write.mode("overwrite").parquet(f"{path}/_numbers/{name}/batch={batch_id}")


def rule_stream(events: DataFrame, feeds: dict[str, Feed], name: str) -> tuple[str, dict[str, str]]:
    """Run the feeds over a stream, each with its own output folder.

    Stateful feeds are streaming queries of their own. The others get each micro-batch,
    written under its id, so a repeated batch replaces itself. What a failed feed was to
    get is kept under ``_failed`` for replay_failed(). Returns the path and the error
    text of each feed that failed.
    """
    path = scratch_path(events.sparkSession, name)
    failed: dict[str, str] = {}
    by_batch = {n: f for n, f in feeds.items() if f.live is None}

    def live(feed: str) -> None:
        writer = feeds[feed].live(events).writeStream.format("parquet").outputMode("append").option("path", f"{path}/{feed}")
        writer.option("checkpointLocation", f"{path}/_progress/{feed}").trigger(availableNow=True).start().awaitTermination()

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        errors = dispatch(list(by_batch), lambda n: _run_feed(batch, by_batch[n], n, path, batch_id))
        for n in errors:
            batch.write.mode("overwrite").parquet(f"{path}/_failed/{n}/batch={batch_id}")
        failed.update(errors)
        batch.unpersist()

    failed.update(dispatch([n for n in feeds if n not in by_batch], live))
    events.writeStream.outputMode("append").option("checkpointLocation", f"{path}/_progress/_batches").foreachBatch(write).trigger(
        availableNow=True
    ).start().awaitTermination()
    return path, failed


def replay_failed(spark: SparkSession, path: str, feeds: dict[str, Feed]) -> dict[str, str]:
    """Give the kept micro-batches of failed feeds to the feeds again, in order.

    A batch that succeeds now is marked and not offered another time. Numbers go on after
    the last one given. Returns the error text of each feed that still fails.
    """

    def again(name: str) -> None:
        kept = spark.read.parquet(f"{path}/_failed/{name}")
        done = [r["batch"] for r in _marked(spark, f"{path}/_replayed/{name}")]
        for row in kept.select("batch").distinct().orderBy("batch").collect():
            if row["batch"] in done:
                continue
            rows = kept.where(F.col("batch") == row["batch"]).drop("batch")
            _run_feed(rows, feeds[name], name, path, REPLAY + row["batch"])
            spark.range(1).write.mode("overwrite").parquet(f"{path}/_replayed/{name}/batch={row['batch']}")

    return dispatch([n for n in feeds if _exists(spark, f"{path}/_failed/{n}")], again)


#: Replayed batches are written beyond all batch ids of the stream.
REPLAY = 1 << 40


def _exists(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.parquet(folder)
    except AnalysisException:
        return False
    return True


def _marked(spark: SparkSession, folder: str) -> list:
    return spark.read.parquet(folder).select("batch").distinct().collect() if _exists(spark, folder) else []
