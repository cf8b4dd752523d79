"""Column helpers for unevenly written values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_kind(c: Column) -> Column:
    """A node's kind as written in any case and with any blanks around it."""
    return F.lower(F.trim(c))
