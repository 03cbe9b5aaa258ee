"""Rule feeds over known sightings and their dispatch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import is_known, stamp
from sightline.operators.numbering import dense_ids
from sightline.operators.ordered import cooldown
from sightline.params import ALERT_STATUS, ALERT_TYPE, ATTENDANCE_TYPE, VISIT_CATEGORY, CooldownParams

Rule = Callable[..., DataFrame]


@dataclass(frozen=True)
class Feed:
    """A rule and how it runs over a stream.

    ``number`` names a column of ids that go on from one micro-batch to the next; the rule
    then takes ``start``. ``live`` is the stateful form of a rule that looks back beyond
    its micro-batch; without it the rule sees each micro-batch by itself.
    """

    run: Rule
    number: str | None = None
    live: Rule | None = None


def known_only(sightings: DataFrame) -> DataFrame:
    return sightings.where(is_known(F.col("entity_id")))


def attendance(sightings: DataFrame, seconds: float = CooldownParams().attendance_seconds) -> DataFrame:
    """Entry records: an entity's sightings more than ``seconds`` after its last record."""
    return attendance_records(cooldown(known_only(sightings), ["entity_id"], "ts", seconds, ["id"], strict=True))


def attendance_records(kept: DataFrame) -> DataFrame:
    return kept.select(
        "id", "entity_id", "name", F.lit(ATTENDANCE_TYPE).alias("type"), stamp(F.col("ts")).alias("timestamp"),
        F.col("similarity").alias("confidence"),
    )


def live_attendance(stream: DataFrame, seconds: float = CooldownParams().attendance_seconds) -> DataFrame:
    """Entry records over a stream: each entity's last record is kept between micro-batches."""
    from sightline.streaming import state

    rows = known_only(stream).select("id", "entity_id", "name", "similarity", "ts")
    return attendance_records(state.cooldown(rows, ["entity_id"], "ts", seconds, "id", strict=True))


def alerts(sightings: DataFrame, entities: DataFrame | None = None, roles: list[str] | None = None, start: int = 1) -> DataFrame:
    """Alert records, numbered from ``start`` on in id order. ``roles`` limits them to entities with
    such a role; without it every known sighting raises one."""
    rows = known_only(sightings)
    if roles:
        watched = entities.where(F.col("role").isin(*roles)).select("entity_id")
        rows = rows.join(watched, "entity_id", "left_semi")
    return dense_ids(rows, "id", "alert_id", start=start).select(
        "alert_id", "id", "entity_id", "name", F.lit(ALERT_TYPE).alias("alert_type"),
        stamp(F.col("ts")).alias("timestamp"), F.col("similarity").alias("match_similarity"),
        F.lit(ALERT_STATUS).alias("status"),
    )


def visits(sightings: DataFrame) -> DataFrame:
    return known_only(sightings).select(
        "id", "entity_id", "name", F.lit(VISIT_CATEGORY).alias("category"), stamp(F.col("ts")).alias("timestamp")
    )


class RuleSet:
    """Named feeds, switched on by settings."""

    def __init__(self) -> None:
        self._feeds: dict[str, Feed] = {}

    def register(self, name: str, rule: Rule | Feed) -> None:
        self._feeds[name] = rule if isinstance(rule, Feed) else Feed(rule)

    def enabled(self, settings: dict[str, dict], active: str) -> dict[str, Feed]:
        """Feeds set ``enabled``, or named ``active`` when the setting is absent."""
        return {n: r for n, r in self._feeds.items() if settings.get(n, {}).get("enabled", n == active)}


def default_rules(attendance_seconds: float = CooldownParams().attendance_seconds) -> RuleSet:
    rules = RuleSet()
    rules.register(
        "attendance", Feed(lambda rows: attendance(rows, attendance_seconds), live=lambda rows: live_attendance(rows, attendance_seconds))
    )
    rules.register("alerts", Feed(alerts, number="alert_id"))
    rules.register("visits", Feed(visits))
    return rules


def dispatch(names: list[str], run: Callable[[str], None]) -> dict[str, str]:
    """Run every named feed; a failing one does not stop the others.

    Returns the error text of each failed feed.
    """
    errors: dict[str, str] = {}
    for name in names:
        try:
            run(name)
        except Exception as error:  # a consumer's failure stays its own
            errors[name] = str(error)
    return errors
