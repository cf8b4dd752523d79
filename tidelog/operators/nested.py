"""Nested recordings in JSON bodies turned into flat tables with parent-child links.

Higher-order SQL functions do all of it inside the row: each step of a fold transforms the nodes of
one level into those of the next with their ancestors' key and position attached, ``flatten`` joins
the levels, and one ``inline`` per target table emits its rows. The fold goes as deep as the body
does, there is no shuffle, and the JSON is parsed once per body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NODES = "array<struct<path:string,parent:string,node:variant>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once as ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _is_object(v: str) -> str:
    return f"try_variant_get({v}, '$', 'struct<id:variant>') is not null"  # cast to a field or two: a map would copy the object


def _as_list(v: str, n: str) -> str:
    """SQL for the entries of ``v``: a list, a lone object as a list of one, or either written as text.

    ``n`` keeps the names of nested lambdas apart.
    """
    of = lambda x: f"coalesce(try_variant_get({x}, '$', 'array<variant>'), if({_is_object(x)}, array({x}), null))"
    text = _let(f"try_parse_json(try_variant_get(v{n}, '$', 'string'))", f"t{n}", of(f"t{n}"))
    return _let(v, f"v{n}", f"coalesce({of(f'v{n}')}, {text})")


def _level(children: str, prefix: str, parent: str, n: str) -> str:
    """SQL for the nodes among the entries ``children``, with their paths; null entries and bare values are none."""
    entries = f"transform({_as_list(children, n)}, (c{n}, i{n}) -> struct(concat({prefix}, i{n}) as path, {parent} as parent, c{n} as node))"
    return f"coalesce(filter({entries}, e{n} -> {_is_object(f'e{n}.node')}), cast(array() as {_NODES}))"


def _all_nodes(contents: str, bound: str) -> str:
    """SQL for every node under ``contents``: level by level until a level is empty; ``bound`` is at least the depth."""
    deeper = f"flatten(transform(a.front, p -> {_level("try_variant_get(p.node, '$.children', 'variant')", "p.path || '.'", 'p.path', 'd')}))"
    step = _let(deeper, "f", "if(size(f) = 0, named_struct('front', f, 'done', a.done), named_struct('front', f, 'done', concat(a.done, array(f))))")
    state = f"cast(named_struct('front', f0, 'done', array(f0)) as struct<front:{_NODES},done:array<{_NODES}>>)"
    typed = f"cast({step} as struct<front:{_NODES},done:array<{_NODES}>>)"
    fold = f"aggregate(sequence(1, {bound}), {state}, (a, k) -> if(size(a.front) = 0, a, {typed}), a -> flatten(a.done))"
    return _let(_level(contents, "''", "''", "r"), "f0", fold)


def parsed(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with ``_recordings``, the recordings of each body with their nodes; null or empty without any.

    Read are bodies of valid JSON, as a list of recordings, one recording, an object with ``lifelogs``
    or ``lifelog``, or an object with ``data`` that is any of these. Null, empty, cut off or other
    bodies give no rows.
    """
    get = lambda path: f"try_variant_get(_v, '{path}', 'variant')"
    lone = f"case when {_is_object(get('$.data'))} and try_variant_get(_v, '$.data.id', 'variant') is null and try_variant_get(_v, '$.data.contents', 'variant') is null then null else {_as_list(get('$.data'), 'c')} end"
    whole = "try_variant_get(_v, '$', 'array<variant>')"
    itself = f"if({_is_object('_v')} and coalesce(try_variant_get(_v, '$.id', 'variant'), try_variant_get(_v, '$.contents', 'variant')) is not null, array(_v), null)"
    records = f"coalesce({_as_list(get('$.data.lifelogs'), 'a')}, {_as_list(get('$.data.lifelog'), 'b')}, {lone}, {_as_list(get('$.lifelogs'), 'g')}, {_as_list(get('$.lifelog'), 'h')}, {whole}, {itself})"
    bound = F.size(F.split(F.col(body), "children", -1)).cast("int")
    # No filter on what is parsed, and inline_outer with the test behind it: Spark pushes a filter below the
    # projection, also the one it infers for a plain inline, and would parse again for each mention.
    with_records = df.withColumn("_v", F.try_parse_json(F.col(body))).withColumn("_bound", bound).withColumn("_r", F.expr(f"filter({records}, x -> {_is_object('x')})"))
    text = lambda path: f"try_variant_get(x, '{path}', 'string')"
    recordings = (
        f"transform(_r, (x, n) -> struct(n as recording_no, {text('$.id')} as lifelog_id, {text('$.title')} as title, {text('$.markdown')} as markdown,"
        f" {text('$.startTime')} as start_time, {text('$.endTime')} as end_time, {_all_nodes("try_variant_get(x, '$.contents', 'variant')", '_bound')} as nodes))"
    )
    return with_records.withColumn("_recordings", F.expr(recordings)).drop("_v", "_bound", "_r")


def recordings(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, recording_no, lifelog_id, title, markdown, start_time, end_time, n_nodes): a row per recording.

    ``recording_no`` counts from 0 over the objects of the body's list. Missing fields are null;
    times stay as written.
    """
    one = F.expr("transform(_recordings, r -> struct(r.recording_no, r.lifelog_id, r.title, r.markdown, r.start_time, r.end_time, size(r.nodes) as n_nodes))")
    return parsed(df.select(key, body), body).select(key, one.alias("_one")).selectExpr(f"`{key}`", "inline_outer(_one)").where("recording_no is not null")


def nodes(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, recording_no, lifelog_id, node_path, parent_path, depth, node_type, content, start_time,
    end_time, start_offset_ms, end_offset_ms, speaker_name, speaker_identifier): a row per node.

    ``node_path`` joins by dots the positions from the top down, counted from 0 over all entries of a
    list as it stands; null entries and bare values are no nodes; a lone object stands for a list of
    one, a list written as text for the list. ``parent_path`` is '' at the top. Fields that are
    missing or of an unfit type are null; numbers written as text count as numbers.
    """
    text = lambda name: f"try_variant_get(m.node, '$.{name}', 'string')"
    number = lambda name: f"try_cast({text(name)} as bigint)"
    rows = (
        "flatten(transform(_recordings, r -> transform(r.nodes, m -> struct(r.recording_no as recording_no, r.lifelog_id as lifelog_id, m.path as node_path, m.parent as parent_path,"
        f" size(split(m.path, '[.]')) as depth, {text('type')} as node_type, {text('content')} as content, {text('startTime')} as start_time, {text('endTime')} as end_time,"
        f" {number('startOffsetMs')} as start_offset_ms, {number('endOffsetMs')} as end_offset_ms, {text('speakerName')} as speaker_name, {text('speakerIdentifier')} as speaker_identifier))))"
    )
    return parsed(df.select(key, body), body).select(key, F.expr(rows).alias("_rows")).selectExpr(f"`{key}`", "inline_outer(_rows)").where("node_path is not null")


def paths(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, lifelog_id, node_path, parent_path): the links of :func:`nodes` alone, without the nodes' fields."""
    rows: Column = F.expr("flatten(transform(_recordings, r -> transform(r.nodes, m -> struct(r.lifelog_id as lifelog_id, m.path as node_path, m.parent as parent_path))))")
    return parsed(df.select(key, body), body).select(key, rows.alias("_rows")).selectExpr(f"`{key}`", "inline_outer(_rows)").where("node_path is not null")
