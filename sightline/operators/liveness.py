"""Source health: liveness, outages, latest rows, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import any_contains, is_online
from sightline.operators.ordered import gaps
from sightline.params import LivenessParams


def liveness(rows: DataFrame, as_of: Column, started: Column | None = None, p: LivenessParams = LivenessParams()) -> DataFrame:
    """Age and state of each source at ``as_of``.

    ``active`` under ``active_seconds``, ``healthy`` under ``healthy_seconds``; an
    unhealthy source inside the grace period after ``started`` is INITIALIZING.
    """
    age = (F.unix_micros(as_of) - F.unix_micros("last_row")) / F.lit(1e6)
    latest = rows.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.max("ts").alias("last_row"))
    fresh = F.lit(False)
    if started is not None:
        fresh = (F.unix_micros(as_of) - F.unix_micros(started)) < int(p.grace_seconds * 1_000_000)
    healthy = F.col("age_seconds") < p.healthy_seconds
    return latest.withColumn("age_seconds", age).select(
        "source_id",
        F.round("age_seconds", 2).alias("age_seconds"),
        (F.col("age_seconds") < p.active_seconds).alias("is_active"),
        healthy.alias("is_healthy"),
        F.when(healthy, "ONLINE").when(fresh, "INITIALIZING").otherwise("RECONNECTING").alias("status"),
    )


def outages(
    rows: DataFrame, limit_seconds: float = LivenessParams().healthy_seconds,
    check_seconds: float = LivenessParams().check_seconds, long_checks: int = LivenessParams().long_outage_checks,
    bucket_seconds: float | None = None,
) -> DataFrame:
    """Gaps longer than ``limit_seconds`` between rows of a source, and whether they
    last more than ``long_checks`` checks."""
    found = gaps(rows.where(F.col("source_id").isNotNull()), ["source_id"], "ts", limit_seconds, bucket_seconds)
    return found.withColumn("is_long", F.floor(F.col("gap_seconds") / check_seconds) > long_checks)


def latest_per_source(rows: DataFrame, row_id: str = "id") -> DataFrame:
    best = F.max_by(F.struct(*[c for c in rows.columns if c != "source_id"]), F.struct("ts", row_id))
    found = rows.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(best.alias("_r"))
    return found.select("source_id", "_r.*")


def rate_sample(rows: DataFrame, keys: list[str], ts: str, per_second: float, row_id: str) -> DataFrame:
    """First row of each key in every time slot of 1/``per_second`` seconds."""
    slot = int(round(1_000_000 / per_second))
    slotted = rows.withColumn(
        "_t", F.unix_micros(ts)
    ).withColumn("_slot", F.expr(f"(_t - pmod(_t, {slot}L)) div {slot}L"))
    first = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("_t", row_id))
    return slotted.groupBy(*keys, "_slot").agg(first.alias("_r")).select(*keys, "_r.*")


def with_live_status(sources: DataFrame, live: DataFrame) -> DataFrame:
    """Sources with ``is_active`` from their liveness; a source without rows is not active."""
    return sources.join(live.select("source_id", "is_active"), "source_id", "left").withColumn(
        "is_active", F.coalesce("is_active", F.lit(False))
    )


def search_sources(sources: DataFrame, text: str | None = None, state: str | None = None) -> DataFrame:
    """Sources by text in name, id or location, and 'online' or 'offline'."""
    rows = sources
    if text:
        rows = rows.where(any_contains(text.strip(), F.col("name"), F.col("source_id"), F.col("location")))
    if state == "online":
        rows = rows.where(is_online(F.col("enabled"), F.col("status")))
    elif state == "offline":
        rows = rows.where(~is_online(F.col("enabled"), F.col("status")))
    return rows


def online_counts(sources: DataFrame) -> DataFrame:
    online = is_online(F.col("enabled"), F.col("status"))
    return sources.agg(F.count_if(online).alias("online"), F.count(F.lit(1)).alias("total"))


def online_first(sources: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` sources, online ones ahead."""
    online = is_online(F.col("enabled"), F.col("status"))
    return sources.withColumn("is_online", online).orderBy(F.desc("is_online"), "id").limit(n)


def duplicate_names(sources: DataFrame) -> DataFrame:
    """Sources whose name, ignoring case, is also that of another id."""
    named = sources.withColumn("_key", F.lower("name"))
    shared = named.groupBy("_key").agg(
        (F.min("source_id") != F.max("source_id")).alias("_shared")
    ).where("_shared")
    return named.join(shared.select("_key"), "_key", "left_semi").drop("_key")
