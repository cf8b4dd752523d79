"""Queries of the core problems: continuous periods and gaps (1), nested records (5), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import node_kind
from tidelog.operators import intervals, nested
from tidelog.sources import latest_delivery, table


def recording_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wearer_id, s, e): the latest delivery of every recording, in epoch ms."""
    logs = table(spark, sf_dir, "lifelogs").select("id", "received_at", "wearer_id", intervals.epoch_ms(F.col("start_time")).alias("s"), intervals.epoch_ms(F.col("end_time")).alias("e"))
    return latest_delivery(logs, ["id"], ["wearer_id", "s", "e"])


def utterance_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lifelog_id, s, e): the latest delivery of every blockquote node, in epoch ms."""
    nodes = table(spark, sf_dir, "lifelog_contents").select(
        "node_id", "lifelog_id", "received_at", (node_kind(F.col("node_type")) == "blockquote").alias("quote"), intervals.epoch_ms(F.col("start_time")).alias("s"), intervals.epoch_ms(F.col("end_time")).alias("e")
    )
    return latest_delivery(nodes, ["node_id", "lifelog_id"], ["quote", "s", "e"]).where("quote")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the continuous periods of wearers (under 24 hours) and of recordings (any length)."""
    wearer = intervals.gaps(recording_intervals(spark, sf_dir), "wearer_id", "s", "e").where(F.col("gap_end") - F.col("gap_start") < intervals.DAY_MS)
    lifelog = intervals.gaps(utterance_intervals(spark, sf_dir), "lifelog_id", "s", "e", intervals.HOUR_MS)
    rows = lambda df, level, key: df.select(F.lit(level).alias("level"), F.col(key).cast("string").alias("entity_key"), F.col("gap_start").alias("gap_start_ms"), F.col("gap_end").alias("gap_end_ms"))
    return rows(wearer, "wearer", "wearer_id").unionByName(rows(lifelog, "lifelog", "lifelog_id"))


def p1_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuous periods of every wearer and of every recording's utterances."""
    wearer = intervals.periods(recording_intervals(spark, sf_dir), "wearer_id", "s", "e")
    lifelog = intervals.periods(utterance_intervals(spark, sf_dir), "lifelog_id", "s", "e", intervals.HOUR_MS)
    rows = lambda df, level, key: df.select(F.lit(level).alias("level"), F.col(key).cast("string").alias("entity_key"), F.col("period_start").alias("period_start_ms"), F.col("period_end").alias("period_end_ms"))
    return rows(wearer, "wearer", "wearer_id").unionByName(rows(lifelog, "lifelog", "lifelog_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every node of every recording in the payloads, with its parent's."""
    return nested.paths(table(spark, sf_dir, "lifelog_payloads"), "payload_id").distinct()


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat node table of the payloads."""
    return nested.nodes(table(spark, sf_dir, "lifelog_payloads"), "payload_id")


def p5_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat recording table of the payloads."""
    return nested.recordings(table(spark, sf_dir, "lifelog_payloads"), "payload_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p5_found, p5_nodes, p5_recordings)}

_INTERVALS = """
with logs as (
  select 'wearer' as level, cast(wearer_id as varchar) as entity_key, start_time, end_time from (
    select *, row_number() over (partition by id order by received_at desc nulls last) as rn from lifelogs) where rn = 1),
quotes as (
  select 'lifelog' as level, lifelog_id as entity_key, start_time, end_time from (
    select *, row_number() over (partition by node_id, lifelog_id order by received_at desc nulls last) as rn from lifelog_contents)
  where rn = 1 and lower(trim(node_type)) = 'blockquote'),
spans as (
  select level, entity_key, epoch_ms(start_time) as s, epoch_ms(end_time) as e from (select * from logs union all select * from quotes)
  where entity_key is not null and epoch_ms(end_time) > epoch_ms(start_time)),
marked as (
  select *, max(e) over (partition by level, entity_key order by s, e rows between unbounded preceding and 1 preceding) as reach from spans),
numbered as (
  select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by level, entity_key order by s, e rows unbounded preceding) as n from marked),
periods as (
  select level, entity_key, n, min(s) as period_start_ms, max(e) as period_end_ms from numbered group by level, entity_key, n)
"""

NODE_TREE = """
with recursive bodies as (
  select payload_id, cast(body as json) as j from lifelog_payloads where body is not null and json_valid(body)),
lists as (
  select payload_id, coalesce(j->'$.data.lifelogs', j->'$.data.lifelog', j->'$.data', j) as d from bodies),
recordings as (
  select payload_id, i - 1 as recording_no, r from (
    select payload_id, unnest(case json_type(d) when 'ARRAY' then cast(d as json[]) when 'OBJECT' then [d] else [] end) as r,
      generate_subscripts(case json_type(d) when 'ARRAY' then cast(d as json[]) when 'OBJECT' then [d] else [] end, 1) as i
    from lists)
  where json_type(r) = 'OBJECT' and (json_exists(r, '$.id') or json_exists(r, '$.contents'))),
entries as (
  select payload_id, recording_no, r->>'$.id' as lifelog_id, '' as parent_path,
    case when json_type(r->'$.contents') = 'VARCHAR' then cast(r->>'$.contents' as json) else r->'$.contents' end as children
  from recordings),
tree as (
  select payload_id, recording_no, lifelog_id, parent_path as node_path, '' as parent_path, children, 0 as depth, cast(null as json) as node from entries
  union all
  select payload_id, recording_no, lifelog_id, case when node_path = '' then '' else node_path || '.' end || cast(i - 1 as varchar), node_path,
    case when json_type(x->'$.children') = 'VARCHAR' then cast(x->>'$.children' as json) else x->'$.children' end, depth + 1, x
  from (
    select payload_id, recording_no, lifelog_id, node_path, depth, unnest(l) as x, generate_subscripts(l, 1) as i from (
      select *, case json_type(children) when 'ARRAY' then cast(children as json[]) when 'OBJECT' then [children] else [] end as l from tree))
  where json_type(x) = 'OBJECT')
"""

SQL = {
    "p1_found": _INTERVALS
    + """
select level, entity_key, gap_start_ms, gap_end_ms from (
  select level, entity_key, lag(period_end_ms) over (partition by level, entity_key order by n) as gap_start_ms, period_start_ms as gap_end_ms from periods)
where gap_start_ms is not null and (level = 'lifelog' or gap_end_ms - gap_start_ms < 86400000)
""",
    "p1_periods": _INTERVALS + "select level, entity_key, period_start_ms, period_end_ms from periods",
    "p5_found": NODE_TREE + "select distinct payload_id, lifelog_id, node_path, parent_path from tree where depth > 0",
    "p5_nodes": NODE_TREE
    + """
select payload_id, cast(recording_no as int) as recording_no, lifelog_id, node_path, parent_path, cast(depth as int) as depth,
  node->>'$.type' as node_type, node->>'$.content' as content, node->>'$.startTime' as start_time, node->>'$.endTime' as end_time,
  try_cast(node->>'$.startOffsetMs' as bigint) as start_offset_ms, try_cast(node->>'$.endOffsetMs' as bigint) as end_offset_ms,
  node->>'$.speakerName' as speaker_name, node->>'$.speakerIdentifier' as speaker_identifier
from tree where depth > 0
""",
    "p5_recordings": NODE_TREE
    + """
select r.payload_id, cast(r.recording_no as int) as recording_no, r.r->>'$.id' as lifelog_id, r.r->>'$.title' as title, r.r->>'$.markdown' as markdown,
  r.r->>'$.startTime' as start_time, r.r->>'$.endTime' as end_time,
  cast((select count(*) from tree t where t.payload_id = r.payload_id and t.recording_no = r.recording_no and t.depth > 0) as int) as n_nodes
from recordings r
""",
}
