"""Roll-ups against the reports over the log itself; pages by directory against whole sorts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sightline.functions.text import day_key
from sightline.operators import reports, rollups
from sightline.operators.paging import PagedLog
from sightline.operators.rollups import Rollups
from sightline.session import scratch_path

SCHEMA = "id long, entity_id string, name string, similarity double, track_id string, source_id string, ts timestamp"
START = datetime(2024, 3, 1)


def log_of(spark, n, first=0):
    """A third of all rows on one entity; unknown, empty and null ids; null times; repeated rows."""
    def row(i):
        entity = "P_0" if i % 3 == 0 else ("unknown", "", None)[i % 7] if i % 7 < 3 else f"P_{i % 50}"
        at = None if i % 41 == 0 else START + timedelta(minutes=37 * i)
        return i, entity, ("", None, "n")[i % 3], 0.5, f"t{i % 9}", (None, "", "cam_1", "cam_2")[i % 4], at

    rows = [row(i) for i in range(first, first + n)]
    return spark.createDataFrame(rows + rows[:5], SCHEMA)


def rows_of(df):
    return sorted(map(str, df.collect()))


RANGES = [
    (datetime(2024, 3, 2), datetime(2024, 3, 9), None, None), (datetime(2024, 3, 2, 7, 30), datetime(2024, 3, 8, 0, 1), None, None),
    (datetime(2024, 3, 2, 7), datetime(2024, 3, 2, 19), None, None), (datetime(2024, 3, 2, 19), datetime(2024, 3, 3, 5), "cam_1", None),
    (datetime(2024, 3, 2, 1), datetime(2024, 3, 12), None, "P_0"), (datetime(2030, 1, 1), datetime(2030, 1, 9), None, None),
]


@pytest.fixture(scope="module")
def stored(spark):
    log = log_of(spark, 600).cache()
    made = Rollups(scratch_path(spark, "rollups"))
    made.create(log.where("id < 250"), 8)
    made.refresh(log, log.where("id >= 250").select(day_key(F.col("ts")).alias("day")))
    return log, made


@pytest.mark.parametrize("start,stop,source,entity", RANGES)
def test_reports_from_rollups(stored, start, stop, source, entity):
    log, made = stored
    entities, sources = made.between(log, start, stop, source, entity)
    rows = reports.in_range(log, start, stop, source, entity)
    assert rows_of(rollups.totals(entities)) == rows_of(reports.totals(rows))
    assert rows_of(rollups.by_source(sources)) == rows_of(reports.by_source(rows))
    assert rows_of(rollups.by_day(sources)) == rows_of(reports.by_day(rows))
    assert rollups.top_entities(entities).collect() == reports.top_entities(rows).collect()
    assert rows_of(rollups.breakdown(entities)) == rows_of(reports.breakdown(rows))
    quick, exact = rollups.quick_totals(sources).first(), reports.totals(rows).first()
    assert (quick["total_events"], quick["known_events"], quick["unknown_events"]) == exact[:3]
    assert abs(quick["approx_entities"] - exact["unique_entities"]) <= 0.05 * exact["unique_entities"]


def test_whole_days_read_no_log(stored):
    log, made = stored
    for part in made.between(log, *RANGES[0]):
        assert part.inputFiles() and all(made.root.split("/")[-1] in f for f in part.inputFiles())
        assert "InMemoryTableScan" not in part._jdf.queryExecution().executedPlan().toString()


def test_refresh_twice_and_after_a_dead_writer(spark):
    log = log_of(spark, 200)
    made = Rollups(scratch_path(spark, "rollups"))
    made.create(log.where("id < 100"), 4)
    days = log.where("id >= 100").select(day_key(F.col("ts")).alias("day"))
    before = [rows_of(t.drop("seen")) for t in made.read(spark)]
    # A writer that dies after the entity table: readers still see both tables as they were.
    fresh = rollups.entity_days(log)
    made.entities.rewrite(days, lambda old: old.join(days, "day", "left_anti").unionByName(fresh.join(days, "day", "left_semi")))
    assert [rows_of(t.drop("seen")) for t in made.read(spark)] == before
    # The next refresh is for one other day only, and brings both tables together again.
    made.refresh(log, spark.createDataFrame([("2024-03-01",)], "day string"))
    made.refresh(log, days)
    made.refresh(log, days.limit(0))
    entities, sources = made.read(spark)
    assert rows_of(entities) == rows_of(fresh) and rows_of(sources.drop("seen")) == rows_of(rollups.source_days(fresh).drop("seen"))


def test_empty_log(spark):
    log = log_of(spark, 10).limit(0)
    made = Rollups(scratch_path(spark, "rollups"))
    made.create(log, 4)
    entities, sources = made.between(log, *RANGES[1])
    assert tuple(rollups.totals(entities).first()) == (0, 0, 0, 0) and tuple(rollups.quick_totals(sources).first()) == (0, 0, 0, 0)
    assert rollups.by_day(sources).count() == 0


@pytest.mark.parametrize("by", ["id", "ts"])
def test_pages_at_any_offset(spark, by):
    log = log_of(spark, 300).where("id >= 5").cache()
    paged = PagedLog(scratch_path(spark, "pages"), by)
    paged.write(log, 12)
    for source in (None, "cam_2"):
        for offset, limit in ((0, 7), (3, 60), (60, 25), (140, 9), (265, 50), (290, 50), (5000, 5), (0, 0)):
            want = reports.history_page(log, limit, offset, source=source, by=by).collect()
            assert paged.page(spark, limit, offset, source).collect() == want, (source, offset)
    files = paged.page(spark, 5, 270).inputFiles()
    assert 0 < len({f.split("_range=")[1].split("/")[0] for f in files}) <= 2


def test_pages_of_an_empty_log(spark):
    paged = PagedLog(scratch_path(spark, "pages"))
    paged.write(log_of(spark, 5).limit(0))
    assert paged.page(spark, 10).count() == 0
