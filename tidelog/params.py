"""Query parameters, checked before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass
from zoneinfo import ZoneInfo, available_timezones

from tidelog.functions.dates import is_date, is_date_time

MOST = 100


class InvalidParameter(ValueError):
    """A parameter that no query can be planned with."""

    def __init__(self, name: str, problem: str):
        super().__init__(f"{name}: {problem}")
        self.name, self.problem = name, problem


def flag(name: str, value: object) -> bool:
    """A boolean, or one written as text; the text 'false' is false."""
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value.strip().lower() in {"true", "false"}:
        return value.strip().lower() == "true"
    raise InvalidParameter(name, "must be true or false")


def count(name: str, value: object, most: int = MOST) -> int:
    """A whole number from 1 to ``most``, or one written as text."""
    try:
        number = int(value) if isinstance(value, str) else value
    except ValueError:
        number = None
    if not isinstance(number, int) or isinstance(number, bool) or not 1 <= number <= most:
        raise InvalidParameter(name, f"must be a whole number from 1 to {most}")
    return number


@dataclass
class Listing:
    """What all listings share. Without a limit all rows come; the newest come first unless ``direction`` is 'asc'."""

    limit: int | None = None
    timezone: str = "UTC"
    direction: str = "desc"
    include_markdown: bool = True
    include_headings: bool = True

    def __post_init__(self) -> None:
        self.limit = None if self.limit is None else count("limit", self.limit)
        if self.timezone not in available_timezones():
            raise InvalidParameter("timezone", "must be an IANA name")
        ZoneInfo(self.timezone)
        if self.direction not in {"asc", "desc"}:
            raise InvalidParameter("direction", "must be asc or desc")
        self.include_markdown, self.include_headings = flag("include_markdown", self.include_markdown), flag("include_headings", self.include_headings)


@dataclass
class ById(Listing):
    id: str = ""

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.id:
            raise InvalidParameter("id", "is required")


@dataclass
class ByDate(Listing):
    date: str = ""

    def __post_init__(self) -> None:
        super().__post_init__()
        if not is_date(self.date):
            raise InvalidParameter("date", "must be a day written YYYY-MM-DD")


@dataclass
class ByRange(Listing):
    """Recordings that begin from ``start`` on and before ``end``; a day as ``end`` is its first instant."""

    start: str = ""
    end: str = ""

    def __post_init__(self) -> None:
        super().__post_init__()
        for name in ("start", "end"):
            value = getattr(self, name)
            if not (is_date(value) or is_date_time(value)):
                raise InvalidParameter(name, "must be YYYY-MM-DD or YYYY-MM-DD HH:mm:ss")


@dataclass
class Search(Listing):
    """A term looked for in the ``fetch_limit`` newest recordings."""

    term: str = ""
    fetch_limit: int = 20

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.term:
            raise InvalidParameter("term", "is required")
        self.fetch_limit = count("fetch_limit", self.fetch_limit)
