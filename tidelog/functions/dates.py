"""Dates, days of a time zone, durations and their display, as columns over UTC timestamps without zone."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"^\d{4}-\d{2}-\d{2}$"
DATE_TIME = r"^\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}:\d{2}|T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?Z?)$"


def day_bounds(day: str, zone: str = "UTC") -> tuple[datetime, datetime]:
    """The UTC instants, without zone, between which a local day lies; 23 or 25 hours apart on some days.

    Constant bounds reach the scan as pushed filters, unlike a conversion of each row's time.
    """
    first = date.fromisoformat(day)
    utc = lambda d: datetime.combine(d, time(), ZoneInfo(zone)).astimezone(timezone.utc).replace(tzinfo=None)
    return utc(first), utc(first + timedelta(days=1))


def is_date(text: str) -> bool:
    """Whether ``text`` is a real calendar day written YYYY-MM-DD."""
    try:
        return re.match(DATE, text) is not None and date.fromisoformat(text) is not None
    except ValueError:
        return False


def is_date_time(text: str) -> bool:
    """Whether ``text`` is a real time written with a blank, or as ISO with optional milliseconds and Z."""
    try:
        return re.match(DATE_TIME, text) is not None and datetime.fromisoformat(text.replace(" ", "T").rstrip("Z")) is not None
    except ValueError:
        return False


def valid_date(c: Column) -> Column:
    """:func:`is_date` of a string column; null counts as no date."""
    return F.coalesce(c.rlike(DATE) & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def valid_date_time(c: Column) -> Column:
    """:func:`is_date_time` of a string column; null counts as no time."""
    return F.coalesce(c.rlike(DATE_TIME) & F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "T", " "), "Z$", "")).isNotNull(), F.lit(False))


def parsed(c: Column) -> Column:
    """The UTC time, without zone, of a string that is a day, a time, or a time with an offset; null for others."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:[.]\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?)?$"), F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(F.when(c.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), c).otherwise(F.concat(c, F.when(F.length(c) > 10, F.lit("Z")).otherwise(F.lit(" 00:00:00Z"))))).cast("timestamp_ntz")))


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def zone_names(zone: str) -> dict[int, str]:
    """The short names of a zone by its offset from UTC in minutes, the latest first to count."""
    names = {}
    for year in range(1970, 2038):
        for month in range(1, 13):
            at = datetime(year, month, 1, tzinfo=ZoneInfo(zone))
            names[int(at.utcoffset().total_seconds()) // 60] = at.tzname()
    return names


def display(ts: Column, zone: str = "UTC") -> Column:
    """Jan 15, 2024, 10:00 AM UTC, in the zone; null for null."""
    if zone == "UTC":
        return F.date_format(ts, "MMM d, yyyy, hh:mm a 'UTC'")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))
    offset = F.timestamp_diff("MINUTE", ts.cast("timestamp_ntz"), local).cast("int")
    names = F.create_map(*[F.lit(x) for item in zone_names(zone).items() for x in item])
    return F.concat(F.date_format(local, "MMM d, yyyy, hh:mm a "), F.element_at(names, offset))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, rounded down; null if either is missing."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000)).cast("long")


def duration_text(seconds: Column) -> Column:
    """1h 4m 26s without parts that are zero, 0s for nothing; null for null and for negative durations."""
    h, m, s = F.floor(seconds / 3600).cast("long"), F.floor((seconds % 3600) / 60).cast("long"), seconds % 60
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s"))
    return F.when(seconds >= 0, F.when(text == "", F.lit("0s")).otherwise(text))
