"""Reports, histories, timelines and exports over the sighting log."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.text import (
    any_contains, contains_text, day_key, fixed, is_known, or_default, percent_text, snapshot_url, stamp,
)



def report_range(start: str | None, end: str | None, as_of: datetime) -> tuple[datetime, datetime]:
    """Half-open range of a report: end date inclusive, 7 days when no start is given."""
    stop = datetime.strptime(end, "%Y-%m-%d") + timedelta(days=1) if end else as_of + timedelta(days=1)
    begin = datetime.strptime(start, "%Y-%m-%d") if start else stop - timedelta(days=7)
    return begin, stop


def preset_range(days: int, as_of: date) -> tuple[str, str]:
    """Inclusive dates of the last ``days`` days."""
    return (as_of - timedelta(days=days - 1)).isoformat(), as_of.isoformat()


def in_range(
    sightings: DataFrame, start: datetime, stop: datetime, source: str | None = None, entity: str | None = None
) -> DataFrame:
    """Rows with start ≤ ts < stop and, when given, that source and entity."""
    rows = sightings.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(stop)))
    if source:
        rows = rows.where(F.col("source_id") == source)
    if entity:
        rows = rows.where(F.col("entity_id") == entity)
    return rows


def known() -> Column:
    return is_known(F.col("entity_id"))


def totals(sightings: DataFrame) -> DataFrame:
    return sightings.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(known()).alias("known_events"),
        F.count_if(~known()).alias("unknown_events"),
        F.count_distinct(F.when(known(), F.col("entity_id"))).alias("unique_entities"),
    )


def known_ratio(sightings: DataFrame) -> DataFrame:
    share = F.count_if(known()) / F.count(F.lit(1))
    return sightings.agg(
        F.count_if(known()).alias("known"), F.count_if(~known()).alias("unknown"), F.round(share, 6).alias("known_share")
    )


def by_source(sightings: DataFrame) -> DataFrame:
    counts = sightings.groupBy(or_default(F.col("source_id"), "default").alias("source_id")).agg(
        F.count(F.lit(1)).alias("events")
    )
    return counts.orderBy(F.desc("events"), "source_id")


def by_day(sightings: DataFrame) -> DataFrame:
    return (
        sightings.groupBy(day_key(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("events")).orderBy("day")
    )


def top_entities(sightings: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` known (entity, name) pairs seen most often."""
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("entity_id"))
    return (
        sightings.where(known())
        .groupBy("entity_id", name.alias("name"))
        .agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.desc("events"), "entity_id", "name")
        .limit(n)
    )


def breakdown(sightings: DataFrame) -> DataFrame:
    """Totals, by source, by day and by known entity from one scan."""
    rows = sightings.select(
        or_default(F.col("source_id"), "default").alias("source_id"),
        day_key(F.col("ts")).alias("day"),
        F.when(known(), F.col("entity_id")).alias("entity_id"),
    )
    sets = [[F.col("source_id")], [F.col("day")], [F.col("entity_id")], []]
    counts = rows.groupingSets(sets, "source_id", "day", "entity_id").agg(
        F.count(F.lit(1)).alias("events"), F.grouping_id().alias("_g")
    )
    level = F.when(F.col("_g") == 3, "source").when(F.col("_g") == 5, "day").when(F.col("_g") == 6, "entity").otherwise("total")
    return (
        counts.withColumn("level", level)
        .where((F.col("level") != "entity") | F.col("entity_id").isNotNull())
        .select("level", F.coalesce("source_id", "day", "entity_id", F.lit("all")).alias("key"), "events")
    )


def entity_summary(sightings: DataFrame, entities: DataFrame, search: str | None = None) -> DataFrame:
    """Count, average confidence and first/last sighting per entity, newest first.

    First and last go by id. The registry's name wins over the logged one.
    """
    seen = F.struct("name", "ts", or_default(F.col("source_id"), "default").alias("source_id"))
    rows = sightings.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.round(F.avg("similarity"), 6).alias("avg_confidence"),
        F.max_by(seen, F.col("id")).alias("_last"),
        F.min_by(seen, F.col("id")).alias("_first"),
    )
    registry = entities.select("entity_id", F.nullif(F.col("name"), F.lit("")).alias("_registered"))
    summary = rows.join(registry, "entity_id", "left").select(
        "entity_id",
        F.when(F.col("entity_id") == "unknown", "Unknown Person")
        .otherwise(F.coalesce("_registered", "_last.name"))
        .alias("name"),
        "total_count",
        "avg_confidence",
        stamp(F.col("_last.ts")).alias("last_seen_time"),
        F.col("_last.source_id").alias("last_seen_source"),
        stamp(F.col("_first.ts")).alias("first_seen_time"),
        F.col("_first.source_id").alias("first_seen_source"),
    )
    if search:
        hay = [F.col(c) for c in ("name", "entity_id", "last_seen_source", "first_seen_source")]
        summary = summary.where(contains_text(search, *hay))
    return summary.orderBy(F.desc("last_seen_time"), "entity_id")


def search_events(sightings: DataFrame, text: str) -> DataFrame:
    return sightings.where(any_contains(text, F.col("name"), F.col("entity_id"), F.col("source_id")))


def search_entities(entities: DataFrame, text: str, columns: tuple[str, ...] = ("name", "entity_id", "department", "role")) -> DataFrame:
    return entities.where(any_contains(text, *[F.col(c) for c in columns]))


def hourly_histogram(sightings: DataFrame) -> DataFrame:
    """Events and unknown events per hour of day, all 24 hours present."""
    hours = sightings.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = sightings.groupBy(F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(~known()).alias("unknown")
    )
    return (
        hours.join(counts, "hour", "left")
        .select("hour", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("unknown", F.lit(0)).alias("unknown"))
        .orderBy("hour")
    )


def event_view(sightings: DataFrame) -> DataFrame:
    """Events as shown to a user: defaults filled, time as text, snapshot link."""
    extra = {}
    if "snapshot_path" in sightings.columns:
        extra["snapshot_url"] = snapshot_url(F.col("snapshot_path"))
    return sightings.select(
        "id", "entity_id", "name", "similarity", "track_id",
        or_default(F.col("source_id"), "default").alias("source_id"),
        stamp(F.col("ts")).alias("recognized_at"),
        *[c.alias(n) for n, c in extra.items()],
    )


def history_page(
    sightings: DataFrame, limit: int = 50, offset: int = 0, entity: str | None = None,
    source: str | None = None, by: str = "id",
) -> DataFrame:
    """One page of the log, newest first by ``id`` or ``ts``."""
    rows = sightings
    if entity:
        rows = rows.where(F.col("entity_id") == entity)
    if source:
        rows = rows.where(F.col("source_id") == source)
    order = [F.desc("id")] if by == "id" else [F.desc("ts"), F.desc("id")]
    return event_view(rows.orderBy(*order).offset(offset).limit(limit))


def audit_page(audit: DataFrame, limit: int = 50, order: str = "created_at") -> DataFrame:
    keys = [F.desc(c) for c in dict.fromkeys([order, "id"])]
    return audit.orderBy(*keys).limit(limit)


def latest_report_rows(sightings: DataFrame, n: int = 50) -> DataFrame:
    """Latest ``n`` events with the similarity as a percentage."""
    return (
        sightings.orderBy(F.desc("ts"), F.desc("id"))
        .limit(n)
        .select(
            "id", stamp(F.col("ts")).alias("timestamp"), or_default(F.col("name"), "Unknown").alias("name"),
            or_default(F.col("source_id"), "default").alias("source_id"),
            percent_text(F.col("similarity")).alias("similarity"),
        )
    )


def latest_per_entity(sightings: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest event of each entity, newest first; the smaller id wins equal times.

    An aggregate rather than a window, so a frequent entity is combined on the map side.
    """
    rows = sightings.withColumn("entity_id", or_default(F.col("entity_id"), "unknown"))
    order = F.struct(F.col("ts"), -F.col("id"))
    row = F.struct(*[c for c in rows.columns if c != "entity_id"])
    latest = rows.groupBy("entity_id").agg(F.max_by(row, order).alias("_r")).select("entity_id", "_r.*")
    latest = latest.orderBy(F.desc("ts"), "id")
    return latest.limit(limit) if limit else latest


def first_last_per_entity(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("entity_id").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def boundary_ids(sightings: DataFrame) -> DataFrame:
    """Distinct ids of all first and last events."""
    ends = first_last_per_entity(sightings)
    return ends.select(F.col("first_id").alias("id")).union(ends.select("last_id")).distinct()


def timeline(sightings: DataFrame, limit: int = 50, by: str = "id") -> DataFrame:
    """The last ``limit`` events of every entity, newest first, numbered ``position``."""
    order = [F.desc("id")] if by == "id" else [F.desc("ts"), F.desc("id")]
    position = F.row_number().over(W.partitionBy("entity_id").orderBy(*order))
    return (
        sightings.where(F.col("entity_id").isNotNull())
        .withColumn("position", position)
        .where(F.col("position") <= limit)
        .select(
            "entity_id", F.col("position").cast("long").alias("position"), "id",
            or_default(F.col("source_id"), "default").alias("source_id"), "similarity", "track_id",
            stamp(F.col("ts")).alias("timestamp"),
        )
    )


def timeline_header(sightings: DataFrame, limit: int = 50) -> DataFrame:
    """Per entity: latest name and time, events shown and in all, sources seen in the shown ones."""
    shown = timeline(sightings, limit, by="ts").groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("shown"),
        F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"),
    )
    latest = sightings.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.max_by(F.struct("name", "ts"), F.struct("ts", "id")).alias("_l"),
    )
    return latest.join(shown, "entity_id").select(
        "entity_id", F.col("_l.name").alias("name"), stamp(F.col("_l.ts")).alias("last_seen"), "shown", "total", "sources"
    )


def recent(rows: DataFrame, n: int, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """The ``n`` newest rows, overall or per key."""
    if not keys:
        return rows.orderBy(*order).limit(n)
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rn", nth).where(F.col("_rn") <= n).drop("_rn")


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """The first row with that key."""
    return df.where(F.col(column) == value).limit(1)


def members(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose key is in ``ids``."""
    return df.join(ids, column, "left_semi")


def csv_rows(sightings: DataFrame) -> DataFrame:
    """The report export: fixed columns, defaults filled, similarity to 4 places."""
    return sightings.select(
        F.col("id").alias("ID"),
        or_default(F.col("entity_id"), "unknown").alias("Entity ID"),
        or_default(F.col("name"), "Unknown").alias("Name"),
        fixed(F.coalesce("similarity", F.lit(0.0)), 4).alias("Similarity"),
        or_default(F.col("source_id"), "default").alias("Source"),
        F.col("track_id").alias("Track ID"),
        stamp(F.col("ts")).alias("Timestamp"),
    )


def csv_name(start: datetime, stop: datetime) -> str:
    last = stop - timedelta(days=1)
    return f"recognition_report_{start:%Y%m%d}_{last:%Y%m%d}.csv"


def rule_counts(**feeds: DataFrame) -> DataFrame:
    """Number of records of each rule feed."""
    parts = [feed.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("feed"), "records") for name, feed in feeds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
