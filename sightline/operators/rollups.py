"""Daily roll-ups of the sighting log, and reports that read them instead of the log.

The entity table holds the events of each day, source, known entity and name; rows of unknown entities
share one row per day and source. The source table holds the events of each day and source with
a distinct-count sketch of the known entities. Counts from either are exact; the sketches' standard
error is 1.04 / sqrt(2^SKETCH), 1.6 %. A refresh recomputes whole days from the log, so running
it twice does no harm.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, time, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import day_key, or_default
from sightline.operators import reports
from sightline.sources.versioned import KeyedTable

SKETCH = 12
PINS = "n long, entities long, sources long"
MIDNIGHT = time()


def entity_days(sightings: DataFrame) -> DataFrame:
    """(day, source_id, entity_id, name, events); entity and name are null for unknown entities."""
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("entity_id"))
    rows = sightings.select(
        day_key(F.col("ts")).alias("day"), or_default(F.col("source_id"), "default").alias("source_id"),
        F.when(reports.known(), F.col("entity_id")).alias("entity_id"), F.when(reports.known(), name).alias("name"),
    )
    return rows.groupBy("day", "source_id", "entity_id", "name").agg(F.count(F.lit(1)).alias("events"))


def source_days(entities: DataFrame) -> DataFrame:
    """(day, source_id, events, known, seen) of an entity table; ``seen`` is a sketch of its entities."""
    return entities.groupBy("day", "source_id").agg(
        F.sum("events").alias("events"), F.sum(F.when(F.col("entity_id").isNotNull(), F.col("events")).otherwise(0)).alias("known"),
        F.hll_sketch_agg("entity_id", F.lit(SKETCH)).alias("seen"),
    )


@dataclass(frozen=True)
class Rollups:
    """Roll-ups under ``root``. Both tables are rewritten by day; a pin written last names the versions that
    belong together, so readers never see one table ahead of the other. One writer at a time."""

    root: str

    @property
    def entities(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/entities", "day")

    @property
    def sources(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/sources", "day")

    def pinned(self, spark: SparkSession) -> tuple[int, int, int] | None:
        """Number and table versions of the newest complete write."""
        try:
            row = spark.read.schema(PINS).parquet(f"{self.root}/pins").agg(F.max_by(F.struct("n", "entities", "sources"), "n").alias("pin")).first()
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return tuple(row["pin"])

    def _pin(self, spark: SparkSession, n: int, entities: int, sources: int) -> None:
        spark.createDataFrame([(n, entities, sources)], PINS).coalesce(1).write.mode("append").parquet(f"{self.root}/pins")

    def create(self, sightings: DataFrame, parts: int = 64) -> None:
        """The first roll-ups of a log, in a folder of their own; a create that died needs a new folder."""
        spark = sightings.sparkSession
        entities = self.entities.create(entity_days(sightings), parts)
        sources = self.sources.create(source_days(self.entities.read(spark, entities)), parts)
        self._pin(spark, 1, entities, sources)

    def refresh(self, sightings: DataFrame, days: DataFrame) -> None:
        """Recompute the ``days`` (day, as text) from the log; other days' partitions stay as they are.

        After a refresh that died between the tables, the source table is derived anew for all days.
        """
        spark = sightings.sparkSession
        n, entities, _ = self.pinned(spark)
        behind = self.entities.version(spark) != entities
        days = days.select("day").distinct()
        fresh = entity_days(sightings.withColumn("day", day_key(F.col("ts"))).join(days, "day", "left_semi"))
        entities = self.entities.rewrite(days, lambda old: old.join(days, "day", "left_anti").unionByName(fresh))
        now = self.entities.read(spark, entities)
        touched = now.select("day").union(self.sources.read(spark).select("day")).union(days).distinct() if behind else days
        small = source_days(now.join(touched, "day", "left_semi"))
        sources = self.sources.rewrite(touched, lambda old: old.join(touched, "day", "left_anti").unionByName(small))
        self._pin(spark, n + 1, entities, sources)

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The entity and the source table of the newest complete write."""
        _, entities, sources = self.pinned(spark)
        return self.entities.read(spark, entities), self.sources.read(spark, sources)

    def between(
        self, sightings: DataFrame, start: datetime, stop: datetime, source: str | None = None, entity: str | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """Both tables for start ≤ ts < stop. The log is read only for the parts of days at the two ends;
        with an ``entity``, the source table is derived from the entity table."""
        entities, sources = self.read(sightings.sparkSession)
        first, last = start.date() + timedelta(days=start.time() != MIDNIGHT), stop.date()
        stored = (F.col("day") >= first.isoformat()) & (F.col("day") < last.isoformat())
        entities, sources = entities.where(stored), sources.where(stored)
        if source:
            entities, sources = entities.where(F.col("source_id") == source), sources.where(F.col("source_id") == source)
        if entity:
            entities = entities.where(F.col("entity_id") == entity)
            sources = source_days(entities)
        morning, evening = datetime.combine(first, MIDNIGHT), datetime.combine(last, MIDNIGHT)
        ends = [(start, stop)] if morning > evening else [(a, b) for a, b in ((start, morning), (evening, stop)) if a < b]
        for a, b in ends:
            rest = entity_days(reports.in_range(sightings, a, b, source, entity))
            entities, sources = entities.unionByName(rest), sources.unionByName(source_days(rest))
        return entities, sources


def _events():
    return F.coalesce(F.sum("events"), F.lit(0)).alias("events")


def totals(entities: DataFrame) -> DataFrame:
    """As ``reports.totals``, from the entity table."""
    known = F.sum(F.when(F.col("entity_id").isNotNull(), F.col("events")))
    unknown = F.sum(F.when(F.col("entity_id").isNull(), F.col("events")))
    return entities.agg(
        _events().alias("total_events"), F.coalesce(known, F.lit(0)).alias("known_events"),
        F.coalesce(unknown, F.lit(0)).alias("unknown_events"), F.count_distinct("entity_id").alias("unique_entities"),
    )


def quick_totals(sources: DataFrame) -> DataFrame:
    """Totals from the source table alone; ``approx_entities`` estimates the distinct known entities."""
    known = F.coalesce(F.sum("known"), F.lit(0))
    return sources.agg(
        _events().alias("total_events"), known.alias("known_events"), (F.coalesce(F.sum("events"), F.lit(0)) - known).alias("unknown_events"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("seen")), F.lit(0)).alias("approx_entities"),
    )


def by_source(sources: DataFrame) -> DataFrame:
    return sources.groupBy("source_id").agg(_events()).orderBy(F.desc("events"), "source_id")


def by_day(sources: DataFrame) -> DataFrame:
    return sources.groupBy("day").agg(_events()).orderBy("day")


def top_entities(entities: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` known (entity, name) pairs seen most often."""
    counts = entities.where("entity_id IS NOT NULL").groupBy("entity_id", "name").agg(_events())
    return counts.orderBy(F.desc("events"), "entity_id", "name").limit(n)


def breakdown(entities: DataFrame) -> DataFrame:
    """As ``reports.breakdown``: totals, by source, by day and by known entity."""
    sets = [[F.col("source_id")], [F.col("day")], [F.col("entity_id")], []]
    counts = entities.groupingSets(sets, "source_id", "day", "entity_id").agg(_events(), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 3, "source").when(F.col("_g") == 5, "day").when(F.col("_g") == 6, "entity").otherwise("total")
    named = counts.withColumn("level", level).where((F.col("level") != "entity") | F.col("entity_id").isNotNull())
    return named.select("level", F.coalesce("source_id", "day", "entity_id", F.lit("all")).alias("key"), "events")
