"""Looking recordings up: by id, day, range, recency and keyword, page by page.

Rows come in deliveries; a query sees each recording's latest. Predicates on the time are not pushed
below that choice, as a later delivery may change it: the scan for candidate ids has them instead,
with constant bounds that reach the files' statistics, and only candidates' deliveries are compared.
"""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.dates import day_bounds, is_date, seconds_between
from tidelog.functions.text import node_kind
from tidelog.params import ByDate, ById, ByRange, Listing, Search
from tidelog.sources import latest_delivery

FIELDS = ["wearer_id", "title", "markdown", "start_time", "end_time"]
NODE_FIELDS = ["parent_node_id", "ordinal", "kind", "content", "speaker_name", "speaker_identifier"]


class NotFound(LookupError):
    """No recording has the id."""


def recordings(logs: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Each recording once, in its latest delivery, with ``fields``: only those are read and shuffled."""
    return latest_delivery(logs, ["id"], fields)


def nodes(contents: DataFrame, fields: list[str] = NODE_FIELDS) -> DataFrame:
    """Each content node once, in its latest delivery, with ``fields``; its ``kind`` is in lower case."""
    rows = contents.withColumn("kind", node_kind(F.col("node_type")))
    return latest_delivery(rows, ["node_id", "lifelog_id"], fields)


def _newest_first(direction: str) -> list[Column]:
    by = ("start_time", "id")
    return [F.col(c).asc_nulls_last() if direction == "asc" else F.col(c).desc_nulls_last() for c in by]


def _fields(p: Listing) -> list[str]:
    return FIELDS if p.include_markdown else [f for f in FIELDS if f != "markdown"]


def _listed(df: DataFrame, p: Listing) -> DataFrame:
    """The order, limit and projection of a listing. With a limit Spark keeps only that many rows of each task."""
    ordered = df.orderBy(*_newest_first(p.direction))
    limited = ordered.limit(p.limit) if p.limit else ordered
    return limited if p.include_markdown else limited.select("id", "wearer_id", "title", F.lit(None).cast("string").alias("markdown"), "start_time", "end_time")


def newest(logs: DataFrame, n: int, after: Column | None = None) -> DataFrame:
    """(id, start_time): the ``n`` newest recordings, of those where ``after`` holds; only keys and times are read and shuffled."""
    times = recordings(logs, ["start_time"]).where("start_time is not null")
    return (times if after is None else times.where(after)).orderBy(*_newest_first("desc")).limit(n)


def _of(logs: DataFrame, ids: DataFrame, p: Listing) -> DataFrame:
    """The recordings of a few ids, which are broadcast: those of a listing with a limit, MOST at most."""
    return recordings(logs.join(F.broadcast(ids.select("id")), "id", "left_semi"), _fields(p))


def beginning(logs: DataFrame, start: datetime, end: datetime, fields: list[str] = FIELDS) -> DataFrame:
    """Recordings that begin in [start, end): candidate ids by any delivery, then the latest delivery decides."""
    inside = (F.col("start_time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("start_time") < F.lit(end).cast("timestamp_ntz"))
    candidates = logs.where(inside).select("id").distinct()
    return recordings(logs.join(candidates, "id", "left_semi"), fields).where(inside)


def by_id(logs: DataFrame, p: ById) -> DataFrame:
    """The recording with the id, or no row; the id reaches the scan as a pushed filter."""
    return _listed(recordings(logs.where(F.col("id") == p.id), _fields(p)), p)


def required(df: DataFrame) -> DataFrame:
    """``df``, or :class:`NotFound` if it has no row."""
    if df.isEmpty():
        raise NotFound("no recording has this id")
    return df


def by_ids(logs: DataFrame, ids: DataFrame) -> DataFrame:
    """The recordings whose id stands in ``ids``; Spark broadcasts the ids if they are few."""
    return recordings(logs.join(ids.select("id").distinct(), "id", "left_semi"))


def by_date(logs: DataFrame, p: ByDate) -> DataFrame:
    """Recordings that begin on a day of the time zone."""
    return _listed(beginning(logs, *day_bounds(p.date, p.timezone), _fields(p)), p)


def by_range(logs: DataFrame, p: ByRange, date_only: bool = False) -> DataFrame:
    """Recordings that begin in [start, end), in the time zone; ``date_only`` cuts both to their days."""

    def instant(text: str) -> datetime:
        if date_only or is_date(text):
            return day_bounds(text[:10], p.timezone)[0]
        local = datetime.fromisoformat(text.replace(" ", "T").rstrip("Z"))
        return local if text.endswith("Z") else local.replace(tzinfo=ZoneInfo(p.timezone)).astimezone(timezone.utc).replace(tzinfo=None)

    return _listed(beginning(logs, instant(p.start), instant(p.end), _fields(p)), p)


def recent(logs: DataFrame, p: Listing) -> DataFrame:
    """The newest recordings, 10 without a limit; ``direction`` orders them and doesn't choose them."""
    return _listed(_of(logs, newest(logs, p.limit or 10), p), p)


def page_after(logs: DataFrame, start_time: str, id: str, size: int) -> DataFrame:
    """The next ``size`` recordings, newest first, after the one that begins at ``start_time`` with ``id``."""
    at = F.lit(start_time).cast("timestamp_ntz")
    after = (F.col("start_time") < at) | ((F.col("start_time") == at) & (F.col("id") < id))
    p = Listing(limit=size)
    return _listed(_of(logs, newest(logs, size, after), p), p)


def holds(term: str, *columns: str) -> Column:
    """Whether any column has the term, letter case aside; a literal test, so no sign in it is special."""
    tests = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False)) for c in columns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _top(contents: DataFrame) -> DataFrame:
    """The nodes of a recording's own list; what is nested in them is not searched or shown."""
    return contents.where("parent_node_id is null")


def matches(logs: DataFrame, contents: DataFrame, terms: list[str], fetch_limit: int, fields: list[str] = FIELDS) -> DataFrame:
    """The ``fetch_limit`` newest recordings with ``hits``: for each term whether title, markdown or a top node's content has it.

    The limit comes before the test, so it bounds what is searched; wide columns and nodes are read for
    those recordings alone, whose ids (``fetch_limit`` at most, 100) are broadcast. One pass for all terms.
    """
    ids = newest(logs, fetch_limit)
    wide = _of(logs, ids, Listing()).withColumn("own", F.array(*[holds(t, "title", "markdown") for t in terms]))
    few = F.broadcast(ids.select(F.col("id").alias("lifelog_id")))
    said = nodes(contents.join(few, "lifelog_id", "left_semi"), ["parent_node_id", "content"])
    inside = _top(said).groupBy(F.col("lifelog_id").alias("id")).agg(F.array(*[F.coalesce(F.bool_or(holds(t, "content")), F.lit(False)) for t in terms]).alias("inside"))
    hits = F.when(F.col("inside").isNull(), F.col("own")).otherwise(F.zip_with("own", "inside", lambda a, b: a | b))
    return wide.join(inside, "id", "left").select("id", *fields, hits.alias("hits"))


def search(logs: DataFrame, contents: DataFrame, p: Search) -> DataFrame:
    """Of the ``fetch_limit`` newest recordings those with the term in title, markdown or a top node's content."""
    return _listed(matches(logs, contents, [p.term], p.fetch_limit).where(F.col("hits")[0]).drop("hits"), p)


def contents_of(listing: DataFrame, contents: DataFrame, p: Listing) -> DataFrame:
    """The nodes of the recordings of a listing, without headings unless ``include_headings``; for listings with a limit."""
    of = contents.join(F.broadcast(listing.select(F.col("id").alias("lifelog_id"))), "lifelog_id", "left_semi")
    found = nodes(of)
    return found if p.include_headings else found.where("kind is null or not startswith(kind, 'heading')")


def having(df: DataFrame, least_seconds: int = 0, most_seconds: int | None = None, words: tuple[str, ...] = ()) -> DataFrame:
    """Rows of recordings by what is known of them: their duration in [least, most] seconds and all ``words`` in title or markdown.

    A recording of unknown duration stays only if there is no bound.
    """
    seconds = seconds_between(F.col("start_time"), F.col("end_time"))
    if least_seconds:
        df = df.where(seconds >= least_seconds)
    if most_seconds is not None:
        df = df.where(seconds <= most_seconds)
    for w in words:
        df = df.where(holds(w, "title", "markdown"))
    return df


def search_nodes(contents: DataFrame, term: str) -> DataFrame:
    """(lifelog_id, n_hits): every recording with a node whose content has the term; no limit, one pass."""
    return nodes(contents, ["content"]).where(holds(term, "content")).groupBy("lifelog_id").agg(F.count(F.lit(1)).alias("n_hits"))
