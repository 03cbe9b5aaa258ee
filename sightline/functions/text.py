"""Display, key and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.params import POSE_GUIDANCE, POSES_DONE_TEXT, MatchParams

STAMP = "yyyy-MM-dd HH:mm:ss"


def or_default(c: Column, default) -> Column:
    """``c`` unless it is null or empty text."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def is_known(entity: Column) -> Column:
    """True for a non-empty id other than 'unknown'; null counts as unknown."""
    return F.coalesce((entity != "") & (entity != "unknown"), F.lit(False))


def stamp(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, STAMP), F.lit(""))


def day_key(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("unknown"))


def file_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def snapshot_url(path: Column, folder: str = "/faces/snapshots/") -> Column:
    return F.when(F.nullif(path, F.lit("")).isNotNull(), F.concat(F.lit(folder), basename(path)))


def entity_image_url(entity: Column, path: Column) -> Column:
    return F.concat(F.lit("/faces/"), entity, F.lit("/"), basename(path))


def track_key(source: Column, track: Column) -> Column:
    return F.concat_ws(":", source, track.cast("string"))


def detection_id(source: Column, track: Column) -> Column:
    return F.concat(source, F.lit("_face_"), track.cast("string"))


def contains_text(query: str, *columns: Column) -> Column:
    """Case-insensitive substring search over the joined columns."""
    joined = F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.contains(F.lower(joined), F.lit(query.lower().strip()))


def any_contains(query: str, *columns: Column) -> Column:
    """Case-insensitive substring search in any one of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(query.lower())), F.lit(False))
    return found


def confidence_band(similarity: Column) -> Column:
    return F.when(similarity >= 0.85, "high").when(similarity >= 0.70, "medium").otherwise("low")


def fixed(c: Column, digits: int) -> Column:
    """Text with that many decimals, rounded from the exact binary value, ties to even."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits))


def percent_text(similarity: Column, digits: int = 1) -> Column:
    return F.concat(fixed(F.coalesce(similarity, F.lit(0.0)) * 100, digits), F.lit("%"))


def match_status(similarity: Column, p: MatchParams = MatchParams()) -> Column:
    return (
        F.when(similarity >= p.accept, "RECOGNIZED")
        .when(similarity >= p.floor, "POSSIBLE_MATCH")
        .otherwise("UNKNOWN")
    )


def uncertain_status(similarity: Column, p: MatchParams = MatchParams()) -> Column:
    """The documented three-way band: MATCH, UNCERTAIN, UNKNOWN."""
    return (
        F.when(similarity > p.accept, "MATCH")
        .when((similarity > p.uncertain) & (similarity < p.accept), "UNCERTAIN")
        .otherwise("UNKNOWN")
    )


def default_status(entity: Column) -> Column:
    return F.when(is_known(entity), "RECOGNIZED").otherwise("UNKNOWN")


def full_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))


def first_word(name: Column) -> Column:
    return F.substring_index(name, " ", 1)


def after_first_word(name: Column) -> Column:
    return F.array_join(F.slice(F.split(name, " "), 2, 2147483647), " ")


def parse_utc(text: Column) -> Column:
    """Timestamp of UTC text with or without a zone; unreadable text gives null."""
    zoned = text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$")
    as_utc = F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z"))
    return F.try_to_timestamp(F.when(zoned, text).otherwise(as_utc))


def to_zone(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def age_text(ts: Column, as_of: Column) -> Column:
    """Compact age such as '5m ago' relative to ``as_of``."""
    seconds = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1_000_000)))

    def unit(divisor: int, suffix: str) -> Column:
        return F.concat(F.floor(seconds / divisor).cast("string"), F.lit(f"{suffix} ago"))

    return (
        F.when(ts.isNull(), "")
        .when(seconds < 60, unit(1, "s"))
        .when(seconds < 3600, unit(60, "m"))
        .when(seconds < 86400, unit(3600, "h"))
        .otherwise(unit(86400, "d"))
    )


def progress_percent(collected: Column, target: int) -> Column:
    return F.floor(F.least(F.lit(1.0), collected / F.lit(max(1, target))) * 100).cast("int")


def remaining_samples(collected: Column, target: int) -> Column:
    return F.greatest(F.lit(0), F.lit(target) - collected)


def remaining_seconds(collected: Column, target: int) -> Column:
    return F.ceil(remaining_samples(collected, target) * F.lit(1.2))


def overlay_quality(sharpness: Column) -> Column:
    return F.round(F.least(sharpness / F.lit(80.0), F.lit(1.0)), 2)


def is_online(enabled: Column, status: Column) -> Column:
    return F.coalesce(enabled, F.lit(False)) & (F.coalesce(status, F.lit("")) != "OFFLINE")


def next_missing(required, collected: Column) -> Column:
    """First required name not yet in ``collected``; null when none is missing."""
    wanted = F.array(*[F.lit(r) for r in required])
    return F.try_element_at(F.array_except(wanted, collected), F.lit(1))


def guidance(next_pose: Column) -> Column:
    """What to ask of the person for the next missing pose, or that none is missing."""
    text = F.when(next_pose.isNull(), POSES_DONE_TEXT)
    for pose, instruction in POSE_GUIDANCE.items():
        text = text.when(next_pose == pose, instruction)
    return text.otherwise("Adjust face angle")
