"""Recordings addressed by URI. The scheme, and 20 rows listed and 10 read under ``recent``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.dates import iso_date, iso_millis
from tidelog.operators import retrieval
from tidelog.params import ByDate, Listing

SCHEME = "lifelog://"
LISTED, READ = 20, 10
TEMPLATES = {f"{SCHEME}recent": "the newest recordings", SCHEME + "{date}": "all recordings of a day", SCHEME + "{date}/{id}": "one recording of a day"}
_FORM = re.compile(re.escape(SCHEME) + r"(?:(?P<recent>recent)|(?P<date>\d{4}-\d{2}-\d{2})(?:/(?P<id>.+))?)?")


_DATED = rf"^{SCHEME}(\d{{4}}-\d{{2}}-\d{{2}})(?:/(.+))?$"


@dataclass
class Address:
    recent: bool = False
    date: str | None = None
    id: str | None = None


def parse(uri: str) -> Address | None:
    """The parts of a URI; None if it isn't valid. The bare scheme is valid and addresses the templates."""
    m = _FORM.fullmatch(uri)
    return Address(bool(m["recent"]), m["date"], m["id"]) if m else None


def parts(uri: Column) -> Column:
    """:func:`parse` of a column of URIs: a struct (valid, recent, date, id); what is missing is null."""
    date, id = (F.nullif(F.regexp_extract(uri, _DATED, k), F.lit("")) for k in (1, 2))
    recent = F.coalesce(uri == f"{SCHEME}recent", F.lit(False))
    valid = recent | F.coalesce(uri == SCHEME, F.lit(False)) | date.isNotNull()
    return F.struct(valid.alias("valid"), recent.alias("recent"), date.alias("date"), id.alias("id"))


def rows(recordings: DataFrame, counts: DataFrame) -> DataFrame:
    """(uri, name, description, mime_type, id, start_time, end_time, has_markdown, content_count): a row per recording.

    ``recordings`` have ``has_markdown``, ``counts`` have (lifelog_id, content_count). A recording without start time has no date and so no URI.
    """
    df = recordings.join(counts.withColumnRenamed("lifelog_id", "id"), "id", "left")
    return df.select(
        F.concat(F.lit(SCHEME), iso_date(F.col("start_time")), F.lit("/"), F.col("id")).alias("uri"), F.col("title").alias("name"),
        F.concat(F.lit("Lifelog from "), iso_millis(F.col("start_time")), F.lit(" to "), F.coalesce(iso_millis(F.col("end_time")), F.lit("unknown"))).alias("description"),
        F.lit("application/json").alias("mime_type"), "id", "start_time", "end_time", "has_markdown", F.coalesce("content_count", F.lit(0)).cast("long").alias("content_count"),
    )


def listed(logs: DataFrame, uri: str) -> DataFrame | None:
    """The recordings under a URI, newest first; of the bare scheme the templates; None for one that lists nothing."""
    a = parse(uri)
    if a == Address():
        return logs.sparkSession.createDataFrame(list(TEMPLATES.items()), "uri string, description string")
    if a and a.recent:
        return retrieval.recent(logs, Listing(limit=LISTED))
    return retrieval.by_date(logs, ByDate(date=a.date)) if a and a.date and not a.id else None


def read(logs: DataFrame, uri: str) -> DataFrame | None:
    """The recordings a URI addresses: the newest, a day's, or the one that begins on the day and has the id; None for others."""
    a = parse(uri)
    if a and a.recent:
        return retrieval.recent(logs, Listing(limit=READ))
    if not a or not a.date:
        return None
    return retrieval.by_date(logs if not a.id else logs.where(F.col("id") == a.id), ByDate(date=a.date))
