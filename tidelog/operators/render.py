"""Recordings as text. The labels of the lines, heading and quote marks, and the rule between items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.dates import display, duration_text, seconds_between
from tidelog.params import MOST, count
from tidelog.sources import cut

RULE = "\n---\n\n"


def shown_title(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))


def outline(nodes: DataFrame) -> DataFrame:
    """(lifelog_id, headings, body): numbered headings of both levels, and the lines of all nodes, of a recording's own list.

    That is the nodes at the top, in the order of their ordinal, then of node id; what is nested in them
    is not shown. A row holds one recording's lines, as the recording itself does. Unknown kinds have no line.
    """
    text = F.coalesce(F.col("content"), F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "node_id", "kind", text.alias("content"), _line().alias("line"))))
    rows = nodes.where("parent_node_id is null").groupBy("lifelog_id").agg(ordered.alias("n"))
    heads = F.transform(F.filter("n", _is_heading), lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x["content"]))
    return rows.select("lifelog_id", F.array_join(heads, "\n").alias("headings"), F.array_join(F.transform("n", lambda x: x["line"]), "\n").alias("body"))


def in_order(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``path``, which sorts a recording's nodes as they are read: each before what is nested in it, siblings by ordinal, then node id.

    ``path`` holds (ordinal, node_id) from the top down. Pointer doubling: each round joins a node to the
    farthest ancestor known so far and takes over its path and its own farthest, so a depth of d takes
    log2(d) rounds of one join each. Nodes whose parent is not among ``nodes``, or that are their own
    ancestors, are left out.
    """
    step = F.array(F.struct(F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "node_id"))
    ways = cut(nodes.select("lifelog_id", "node_id", F.col("parent_node_id").alias("above"), step.alias("path")))
    while not ways.where("above is not null").isEmpty():
        upper = ways.select("lifelog_id", F.col("node_id").alias("above"), F.col("above").alias("higher"), F.col("path").alias("upper"))
        risen = ways.where("above is not null").join(upper, ["lifelog_id", "above"]).where("not exists(upper, x -> x.node_id = node_id)")  # in no circle
        ways = cut(ways.where("above is null").unionByName(risen.select("lifelog_id", "node_id", F.col("higher").alias("above"), F.concat("upper", "path").alias("path"))))
    return nodes.join(ways.where("above is null").drop("above"), ["lifelog_id", "node_id"])


def transcript(nodes: DataFrame) -> DataFrame:
    """(lifelog_id, body): the lines of all nodes of every level, in reading order; one recording's lines in a row."""
    lines = F.array_sort(F.collect_list(F.struct("path", _line().alias("line"))))
    return in_order(nodes).groupBy("lifelog_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))


def _line() -> Column:
    text = F.coalesce(F.col("content"), F.lit(""))
    return F.when(F.col("kind") == "heading1", F.concat(F.lit("\n# "), text)).when(F.col("kind") == "heading2", F.concat(F.lit("\n## "), text)).when(F.col("kind") == "blockquote", F.concat(F.lit("> "), text))


def _is_heading(node: Column) -> Column:
    return node["kind"].isin("heading1", "heading2")


def first_headings(nodes: DataFrame, most: int = 3) -> DataFrame:
    """(lifelog_id, headings): the first ``most`` headings of each recording's own list, in order."""
    rows = nodes.where("parent_node_id is null and kind in ('heading1', 'heading2')").groupBy("lifelog_id")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "node_id", F.coalesce("content", F.lit("")).alias("content"))))
    return rows.agg(F.array_join(F.transform(F.slice(ordered, 1, most), lambda x: x["content"]), "\n").alias("headings"))


def rendered(recordings: DataFrame, outlines: DataFrame | None = None, include_markdown: bool = True, include_headings: bool = True, zone: str = "UTC") -> DataFrame:
    """(id, start_time, text): each recording as lines: id, title, times in the zone and duration as far as known, headings, content.

    The content is the markdown if wanted and not empty, else the nodes' lines.
    """
    part = lambda label, value: F.concat(F.lit(f"{label}: "), value)  # noqa: E731  null if the value is
    duration = duration_text(seconds_between(F.col("start_time"), F.col("end_time")))
    df = recordings if outlines is None else recordings.join(outlines.withColumnRenamed("lifelog_id", "id"), "id", "left")
    nothing = F.lit(None).cast("string")
    headings, body = (F.nullif(F.col(c), F.lit("")) if outlines is not None else nothing for c in ("headings", "body"))
    markdown = F.nullif(F.col("markdown"), F.lit("")) if include_markdown else nothing
    lines = [
        part("ID", F.col("id")), part("Title", shown_title(F.col("title"))), part("Start Time", display(F.col("start_time"), zone)), part("End Time", display(F.col("end_time"), zone)), part("Duration", duration),
        F.concat(F.lit("\nHeadings:\n"), headings) if include_headings else nothing, F.concat(F.lit("\nContent:\n"), F.coalesce(markdown, body)),
    ]
    return df.select("id", "start_time", F.concat_ws("\n", *lines).alias("text"))


def result_set(items: DataFrame, term: str | None = None, most: int = MOST) -> DataFrame:
    """(text): a header with the number of items and the items, newest first, ``most`` at most, which is what a listing may hold."""
    tail = f' matching "{term}"' if term else ""
    items = items.orderBy(F.desc_nulls_last("start_time"), F.desc("id")).limit(count("most", most))
    joined = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("start_time", "id", "text")))), lambda x: x["text"]), RULE)
    n = F.count(F.lit(1))
    header = F.concat(F.lit("Found "), n.cast("string"), F.when(n == 1, F.lit(" lifelog")).otherwise(F.lit(" lifelogs")), F.lit(f"{tail}:\n\n"))
    return items.agg(F.when(n == 0, F.lit(f"No lifelogs found{tail}")).otherwise(F.concat(header, joined)).alias("text"))


def preview(markdown: Column, size: int = 100) -> Column:
    return F.left(F.coalesce(markdown, F.lit("")), F.lit(size))
