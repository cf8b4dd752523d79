"""Queries of the operators on recordings, and their SQL: retrieval, search recipes, rendering, addresses, rollups, vectors."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schema
from tidelog.functions import dates
from tidelog.operators import nested, render, resources, retrieval, rollups, textops, vectors
from tidelog.params import ByDate, ById, ByRange, Listing, Search
from tidelog.plans.problems import NODE_TREE
from tidelog.sources import envelopes, table
from tidelog.streaming import monitor

DAY, ZONE, PHRASE = "2023-01-09", "America/New_York", "the plan for"
NEWEST = 100


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lifelogs")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lifelog_contents")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.recordings(_logs(spark, sf_dir), ["start_time", "end_time"])


def _texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return retrieval.recordings(_logs(spark, sf_dir), ["title", "markdown", *more])


def _newest(spark: SparkSession, sf_dir: str, n: int = NEWEST) -> DataFrame:
    return retrieval.recent(_logs(spark, sf_dir), Listing(limit=n))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording in its latest delivery."""
    return retrieval.recordings(_logs(spark, sf_dir))


def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording whose id sorts first."""
    logs = _logs(spark, sf_dir)
    return retrieval.by_id(logs, ById(id=logs.agg(F.min("id")).first()[0] or "none"))


def get_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recordings that documents refer to."""
    return retrieval.by_ids(_logs(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("lifelog_id").alias("id")))


def list_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.by_date(_logs(spark, sf_dir), ByDate(date=DAY))


def list_by_date_zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.by_date(_logs(spark, sf_dir), ByDate(date=DAY, timezone=ZONE, include_markdown=False))


def list_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.by_range(_logs(spark, sf_dir), ByRange(start="2023-01-05 09:30:00", end="2023-01-08", direction="asc"))


def list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _newest(spark, sf_dir, 10)


def page_after_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten recordings after the tenth newest."""
    last = list_recent(spark, sf_dir).agg(F.min(F.struct("start_time", "id")).alias("x")).select("x.*").first()
    return retrieval.page_after(_logs(spark, sf_dir), str(last[0]), last[1], 10)


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(_logs(spark, sf_dir), _contents(spark, sf_dir), Search(term="Boiler", fetch_limit=100, limit=20))


def search_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_nodes(_contents(spark, sf_dir), "invoice")


def exclude_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textops.excluding(_texts(spark, sf_dir), ["insurance", "Battery"]).select("id", "title")


def filter_by_text_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = retrieval.by_range(_logs(spark, sf_dir), ByRange(start="2023-01-04", end="2023-01-11"))
    return ranged.where(retrieval.holds("survey", "title", "markdown")).select("id", "title", "start_time")


def multi_keyword_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three searches, one after another, each recording once: one pass with a flag a term."""
    found = retrieval.matches(_logs(spark, sf_dir), _contents(spark, sf_dir), ["roof leak", "insurance", "survey"], NEWEST, ["title"])
    places = found.select("id", "title", F.posexplode("hits").alias("place", "hit")).where("hit")
    return textops.keep_last(places, "id", "place", ["title"]).select("id", "title", "first_place")


def phrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textops.phrase_counts(_texts(spark, sf_dir), [PHRASE, "next point is", "50% off", "never said"])


def related_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = textops.numbered(_newest(spark, sf_dir, 30).where(retrieval.holds("plan", "title", "markdown")), [F.desc("start_time"), F.desc("id")], 30)
    return textops.related_words(placed, "plan")


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = retrieval.recordings(_logs(spark, sf_dir), ["markdown"])
    return df.select("id", textops.term_frequency(df, "the", "markdown").alias("n"))


def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textops.relevance(_texts(spark, sf_dir), PHRASE).select("id", "score")


def relevance_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _newest(spark, sf_dir).where(retrieval.holds(PHRASE, "title", "markdown"))
    return textops.most_relevant(hits, PHRASE).select("id", "title", "score")


def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's last delivered title, and when it was first delivered."""
    return textops.keep_last(_logs(spark, sf_dir), "id", "received_at", ["title"]).withColumnRenamed("first_place", "first_received_at")


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of over five letters in all markdown with the number of recordings that use them."""
    words = retrieval.recordings(_logs(spark, sf_dir), ["markdown"]).select("id", F.explode(F.array_distinct(F.split(F.lower("markdown"), "[^a-z]+"))).alias("word"))
    return words.where(F.length("word") > 5).groupBy("word").agg(F.count(F.lit(1)).alias("n_recordings"))


def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = dates.seconds_between(F.col("start_time"), F.col("end_time"))
    return _times(spark, sf_dir).select("id", seconds.alias("seconds"), dates.duration_text(seconds).alias("duration"))


def display_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("start_time")
    return retrieval.recordings(_logs(spark, sf_dir), ["start_time"]).select("id", dates.iso_date(at).alias("day"), dates.iso_millis(at).alias("iso"), dates.display(at).alias("shown"), dates.display(at, ZONE).alias("shown_local"))


def content_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at the top and at any level of every recording."""
    return retrieval.nodes(_contents(spark, sf_dir), ["parent_node_id"]).groupBy("lifelog_id").agg(F.count_if(F.col("parent_node_id").isNull()).alias("n_top"), F.count(F.lit(1)).alias("n_all"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nodes(_contents(spark, sf_dir), ["parent_node_id", "ordinal", "kind", "content"])


def headings_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.outline(_lines(spark, sf_dir)).select("lifelog_id", "headings")


def first_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three headings of every recording."""
    return render.first_headings(_lines(spark, sf_dir))


def nodes_without_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the twenty newest recordings without their headings."""
    p = Listing(limit=20, include_headings=False)
    return retrieval.contents_of(retrieval.newest(_logs(spark, sf_dir), 20), _contents(spark, sf_dir), p).select("node_id", "lifelog_id", "kind", "content")


def recordings_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of five minutes to an hour that mention a survey."""
    return retrieval.having(_texts(spark, sf_dir, "start_time", "end_time"), 300, 3600, ("survey",)).select("id", "title")


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.outline(_lines(spark, sf_dir)).select("lifelog_id", "body")


def whole_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording's nodes of all levels in reading order."""
    return render.transcript(_lines(spark, sf_dir))


def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.rendered(_texts(spark, sf_dir, "start_time", "end_time"), include_headings=False).select("id", "text")


def render_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = retrieval.recordings(_logs(spark, sf_dir), ["title", "start_time", "end_time"]).withColumn("markdown", F.lit(None).cast("string"))
    return render.rendered(timed, render.outline(_lines(spark, sf_dir)), include_markdown=False).select("id", "text")


def render_result_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.result_set(render.rendered(_newest(spark, sf_dir, 10), include_headings=False), most=10)


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = _logs(spark, sf_dir).withColumn("markdown", render.preview(F.col("markdown")))
    return retrieval.recordings(short, ["title", "markdown"]).select("id", render.shown_title(F.col("title")).alias("title"), F.coalesce("markdown", F.lit("")).alias("preview"))


def resource_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = retrieval.nodes(_contents(spark, sf_dir), ["parent_node_id"]).where("parent_node_id is null").groupBy("lifelog_id").agg(F.count(F.lit(1)).alias("content_count"))
    flagged = _logs(spark, sf_dir).withColumn("has_markdown", F.coalesce(F.col("markdown") != "", F.lit(False)))
    return resources.rows(retrieval.recordings(flagged, ["title", "start_time", "end_time", "has_markdown"]), counts)


def resource_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every recording's URI, and of what no recording's URI looks like."""
    logs = retrieval.recordings(_logs(spark, sf_dir), ["start_time"])
    forms = [F.concat(F.lit(resources.SCHEME), dates.iso_date(F.col("start_time")), F.lit("/"), F.col("id")), F.concat(F.lit(resources.SCHEME), dates.iso_date(F.col("start_time"))), F.concat(F.lit(resources.SCHEME), F.col("id")), F.lit(f"{resources.SCHEME}recent")]
    return logs.select(F.explode(F.array(*forms)).alias("uri")).distinct().select("uri", resources.parts(F.col("uri")).alias("p")).select("uri", "p.*")


def resource_read_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording whose id sorts first among those of a day, read by its URI."""
    first = dates.day_bounds(DAY)
    id = retrieval.beginning(_logs(spark, sf_dir), *first, ["start_time"]).agg(F.min("id")).first()[0]
    return resources.read(_logs(spark, sf_dir), f"{resources.SCHEME}{DAY}/{id}").select("id", "title", "start_time")


def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of every recording in the payloads as written, whether it is a day or a time, and the time it means."""
    at = F.col("start_time")
    found = nested.recordings(table(spark, sf_dir, "lifelog_payloads"), "payload_id")
    return found.select("payload_id", "recording_no", "start_time", dates.valid_date(at).alias("is_day"), dates.valid_date_time(at).alias("is_time"), dates.parsed(at).alias("parsed"))


def resource_list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.listed(_logs(spark, sf_dir), "lifelog://recent").select("id", "title", "start_time")


def resource_read_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.read(_logs(spark, sf_dir), f"lifelog://{DAY}").select("id", "title", "start_time")


def weekday_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.by_weekday(table(spark, sf_dir, "events"), "ts")


def sparse_weekday_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings on the last four Mondays before a day, with the ones that have none."""
    days = rollups.last_days(date(2023, 1, 20), 0, 4)
    between = dates.day_bounds(min(days).isoformat())[0], dates.day_bounds(max(days).isoformat())[1]
    return rollups.on_days(retrieval.beginning(_logs(spark, sf_dir), *between, ["start_time"]), "start_time", days)


def monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = _logs(spark, sf_dir).withColumn("titled", F.coalesce(F.trim("title") != "", F.lit(False)))
    return rollups.monthly(retrieval.recordings(titled, ["start_time", "end_time", "titled"]))


def speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _contents(spark, sf_dir).withColumn("chars", F.length("content"))
    return rollups.speakers(retrieval.nodes(counted, ["kind", "speaker_name", "chars"]))


def speaking_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.speaking_time(retrieval.nodes(_contents(spark, sf_dir), ["kind", "speaker_name", "start_time", "end_time"]))


def monthly_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.topics(retrieval.recordings(_logs(spark, sf_dir), ["title", "start_time"]))


def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.errors(table(spark, sf_dir, "lifelog_payloads"), "payload_id")


def payload_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.readable(table(spark, sf_dir, "lifelog_payloads"))


def payload_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.unknown(table(spark, sf_dir, "lifelog_payloads"), "payload_id")


def payload_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.paging(table(spark, sf_dir, "lifelog_payloads"), "payload_id")


def keyword_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries of recordings as a stream, watched for two terms to its end; files come in any order, so nothing counts as late."""
    stream = monitor.table_arriving(spark, sf_dir, "lifelogs", schema.RECORDING)
    return monitor.replayed(monitor.watched(stream, ["Survey", "insurance"], lateness="3650 days")).select("id", "term").distinct()


def arrivals_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of recordings by the hour they came, counted as a stream."""
    stream = monitor.table_arriving(spark, sf_dir, "lifelogs", schema.RECORDING)
    return monitor.replayed(monitor.by_window(stream, lateness="3650 days"), "complete").select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("hour"), "n")


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each whose id is divisible by 100."""
    all_vectors = table(spark, sf_dir, "embeddings")
    return vectors.nearest(all_vectors, all_vectors.where("vec_id % 100 = 0"), 10)


def hybrid_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings by the fused ranks of three searches, of which each gives its 100 best: relevance, recency, and likeness.

    Likeness: a vector belongs to the document of its id, a document to its recording; the recordings of
    the documents nearest to the first vector.
    """
    rows = textops.relevance(_texts(spark, sf_dir, "start_time"), PHRASE).where("score > 0 and start_time is not null")
    top = lambda df, *by: textops.numbered(df, list(by), NEWEST).select("id", F.col("place").alias("rank"))
    all_vectors = table(spark, sf_dir, "embeddings")
    near = vectors.nearest(all_vectors, all_vectors.orderBy("vec_id").limit(1), NEWEST)
    of = table(spark, sf_dir, "documents").where("lifelog_id is not null").select(F.col("doc_id").alias("vec_id"), F.col("lifelog_id").alias("id")).distinct()
    alike = near.join(of, "vec_id").groupBy("id").agg(F.min("rank").alias("rank"))
    return vectors.fused([top(rows, F.desc("score"), F.desc("start_time"), F.desc("id")), top(rows, F.desc("start_time"), F.desc("id")), alike])


_ALL = (
    recordings, get_by_id, get_by_ids, list_by_date, list_by_date_zoned, list_by_range, list_recent, page_after_key, keyword_search, search_nested, exclude_terms, filter_by_text_in_range, multi_keyword_distinct,
    phrase_counts, related_keywords, term_frequency, relevance_scores, relevance_top5, dedupe_keep_last, distinct_words, duration_text, display_times, content_count, headings_numbered, transcript, render_text,
    render_outline, render_result_set, previews, resource_rows, resource_list_recent, resource_read_day, weekday_counts, sparse_weekday_spine, monthly_rollup, speaker_stats, payload_errors, payload_states,
    payload_pages, vector_search, hybrid_ranking, first_headings, nodes_without_headings, recordings_having, resource_parts, resource_read_one, parsed_times, speaking_time, monthly_topics, payload_unknown, keyword_watch, arrivals_by_hour, whole_transcript,
)
QUERIES = {f.__name__: f for f in _ALL}

_REC = """
with rec as (select id, wearer_id, title, markdown, start_time, end_time from (
  select *, row_number() over (partition by id order by received_at desc nulls last) as rn from lifelogs) where rn = 1),
nodes as (select node_id, lifelog_id, parent_node_id, ordinal, lower(trim(node_type)) as kind, content, speaker_name, speaker_identifier, start_time, end_time from (
  select *, row_number() over (partition by node_id, lifelog_id order by received_at desc nulls last) as rn from lifelog_contents) where rn = 1),
newest as (select * from rec where start_time is not null order by start_time desc, id desc limit {n}),
scored as (select *, lower(coalesce(title, '') || ' ' || coalesce(markdown, '')) as txt from rec)
"""
_FIELDS = "id, wearer_id, title, markdown, start_time, end_time"


def _sql(body: str, n: int = NEWEST) -> str:
    return _REC.format(n=n) + body


def _holds(term: str, *columns: str) -> str:
    return "(" + " or ".join(f"coalesce(contains(lower({c}), '{term}'), false)" for c in columns) + ")"


def _seconds(a: str, b: str) -> str:
    return f"cast(floor((epoch_us({b}) - epoch_us({a})) / 1000000.0) as bigint)"


def _duration(s: str) -> str:
    parts = f"case when {s} // 3600 > 0 then cast({s} // 3600 as varchar) || 'h' end, case when {s} % 3600 // 60 > 0 then cast({s} % 3600 // 60 as varchar) || 'm' end, case when {s} % 60 > 0 then cast({s} % 60 as varchar) || 's' end"
    return f"case when {s} >= 0 then case when {s} = 0 then '0s' else concat_ws(' ', {parts}) end end"


_SHOWN = "strftime({0}, '%b %-d, %Y, %I:%M %p') || ' UTC'"
_LINES = (
    "'ID: ' || id, 'Title: ' || coalesce(nullif(title, ''), 'Untitled'), 'Start Time: ' || " + _SHOWN.format("start_time") + ", 'End Time: ' || " + _SHOWN.format("end_time") + ", 'Duration: ' || " + _duration(_seconds("start_time", "end_time"))
)
_OUTLINE = """
top_nodes as (select *, coalesce(content, '') as line from nodes where parent_node_id is null),
outlines as (select lifelog_id, string_agg(case kind when 'heading1' then chr(10) || '# ' || line when 'heading2' then chr(10) || '## ' || line when 'blockquote' then '> ' || line end, chr(10) order by ordinal, node_id) as body,
  (select string_agg('  ' || cast(k as varchar) || '. ' || line, chr(10) order by k) from (
    select row_number() over (order by ordinal, node_id) as k, line from top_nodes h where h.lifelog_id = o.lifelog_id and kind in ('heading1', 'heading2'))) as headings
  from top_nodes o group by lifelog_id)
"""
_SCORE = f"""(case when contains(txt, '{PHRASE}') then 10 else 0 end + case when contains(lower(coalesce(title, '')), '{PHRASE}') then 20 else 0 end
  + 2 * ({" + ".join(f"(len(txt) - len(replace(txt, '{w}', ''))) // {len(w)}" for w in PHRASE.split())}))"""


def _searched(term: str, n: int, more: str = "") -> str:
    hit = f"id in (select lifelog_id from nodes where parent_node_id is null and contains(lower(content), '{term}'))"
    return f"select {_FIELDS} from newest_{n} where {_holds(term, 'title', 'markdown')} or {hit} {more}"


SQL = {
    "recordings": _sql(f"select {_FIELDS} from rec"),
    "get_by_id": _sql(f"select {_FIELDS} from rec where id = (select min(id) from lifelogs)"),
    "get_by_ids": _sql(f"select {_FIELDS} from rec where id in (select lifelog_id from documents)"),
    "list_by_date": _sql(f"select {_FIELDS} from rec where cast(start_time as date) = date '{DAY}'"),
    "list_by_date_zoned": _sql(f"select id, wearer_id, title, cast(null as varchar) as markdown, start_time, end_time from rec where start_time >= timestamp '{DAY} 05:00:00' and start_time < timestamp '{DAY} 05:00:00' + interval 1 day"),
    "list_by_range": _sql(f"select {_FIELDS} from rec where start_time >= timestamp '2023-01-05 09:30:00' and start_time < timestamp '2023-01-08'"),
    "list_recent": _sql(f"select {_FIELDS} from newest", 10),
    "page_after_key": _sql(f"select {_FIELDS} from rec where start_time is not null order by start_time desc, id desc limit 10 offset 10"),
    "keyword_search": _sql(", newest_100 as (select * from newest) " + _searched("boiler", 100, "order by start_time desc, id desc limit 20"), 100),
    "search_nested": _sql("select lifelog_id, count(*) as n_hits from nodes where contains(lower(content), 'invoice') group by lifelog_id"),
    "exclude_terms": _sql("select id, title from scored where not contains(txt, 'insurance') and not contains(txt, 'battery')"),
    "filter_by_text_in_range": _sql(f"select id, title, start_time from rec where start_time >= timestamp '2023-01-04' and start_time < timestamp '2023-01-11' and {_holds('survey', 'title', 'markdown')}"),
    "multi_keyword_distinct": _sql(
        ", newest_100 as (select * from newest), found as ("
        + " union all ".join(f"select id, title, {i} as place from ({_searched(t, 100)})" for i, t in enumerate(["roof leak", "insurance", "survey"]))
        + ") select id, arg_max(title, place) as title, min(place) as first_place from found group by id"
    ),
    "phrase_counts": _sql("select phrase, (select count(*) from rec where coalesce(contains(lower(title), phrase), false) or coalesce(contains(lower(markdown), phrase), false)) as n from (values ('the plan for'), ('next point is'), ('50% off'), ('never said')) t(phrase)"),
    "related_keywords": _sql(
        f""", placed as (select *, row_number() over (order by start_time desc, id desc) as place from newest where {_holds("plan", "title", "markdown")}),
words as (select place, unnest(ws) as word, generate_subscripts(ws, 1) as pos from (select place, regexp_split_to_array(lower(coalesce(markdown, '')), '{textops.BLANKS}') as ws from placed))
select word, place from (select word, min(place) as place, min(place * 100000000 + pos) as first_use from words where length(word) > 5 and not contains(word, 'plan') group by word) order by first_use, word limit 10""",
        30,
    ),
    "term_frequency": _sql("select id, cast(coalesce((len(markdown) - len(replace(lower(markdown), 'the', ''))) // 3, 0) as bigint) as n from rec"),
    "relevance_scores": _sql(f"select id, cast({_SCORE} as bigint) as score from scored"),
    "relevance_top5": _sql(f"select id, title, cast({_SCORE} as bigint) as score from scored where id in (select id from newest where {_holds(PHRASE, 'title', 'markdown')}) order by score desc, start_time desc, id desc limit 5"),
    "dedupe_keep_last": "select id, last.title as title, first_received_at from (select id, max(struct_pack(received_at := received_at, title := title)) as last, min(received_at) as first_received_at from lifelogs group by id)",
    "distinct_words": _sql("select word, count(*) as n_recordings from (select id, unnest(list_distinct(regexp_split_to_array(lower(markdown), '[^a-z]+'))) as word from rec) where length(word) > 5 group by word"),
    "duration_text": _sql(f"select id, {_seconds('start_time', 'end_time')} as seconds, {_duration(_seconds('start_time', 'end_time'))} as duration from rec"),
    "display_times": _sql("select id, strftime(start_time, '%Y-%m-%d') as day, strftime(start_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as iso, " + _SHOWN.format("start_time") + " as shown, strftime(start_time - interval 5 hours, '%b %-d, %Y, %I:%M %p') || ' EST' as shown_local from rec"),
    "content_count": _sql("select lifelog_id, count(*) filter (parent_node_id is null) as n_top, count(*) as n_all from nodes group by lifelog_id"),
    "headings_numbered": _sql("," + _OUTLINE + "select lifelog_id, coalesce(headings, '') as headings from outlines"),
    "transcript": _sql("," + _OUTLINE + "select lifelog_id, coalesce(body, '') as body from outlines"),
    "whole_transcript": _sql("").replace("with rec", "with recursive rec", 1)
    + """, tree as (
  select lifelog_id, node_id, kind, content, [struct_pack(o := coalesce(ordinal, 0), i := node_id)] as path from nodes where parent_node_id is null
  union all
  select n.lifelog_id, n.node_id, n.kind, n.content, list_append(t.path, struct_pack(o := coalesce(n.ordinal, 0), i := n.node_id)) from tree t join nodes n on n.lifelog_id = t.lifelog_id and n.parent_node_id = t.node_id)
select lifelog_id, coalesce(string_agg(case kind when 'heading1' then chr(10) || '# ' || coalesce(content, '') when 'heading2' then chr(10) || '## ' || coalesce(content, '') when 'blockquote' then '> ' || coalesce(content, '') end, chr(10) order by path), '') as body
from tree group by lifelog_id""",
    "render_text": _sql(f"select id, concat_ws(chr(10), {_LINES}, chr(10) || 'Content:' || chr(10) || nullif(markdown, '')) as text from rec"),
    "render_outline": _sql(f",{_OUTLINE} select id, concat_ws(chr(10), {_LINES}, chr(10) || 'Headings:' || chr(10) || headings, chr(10) || 'Content:' || chr(10) || body) as text from rec left join outlines on lifelog_id = id"),
    "render_result_set": _sql(
        f"select 'Found ' || cast(count(*) as varchar) || case when count(*) = 1 then ' lifelog' else ' lifelogs' end || ':' || chr(10) || chr(10) || string_agg(text, chr(10) || '---' || chr(10) || chr(10) order by start_time desc, id desc) as text"
        f" from (select id, start_time, concat_ws(chr(10), {_LINES}, chr(10) || 'Content:' || chr(10) || nullif(markdown, '')) as text from newest)",
        10,
    ),
    "previews": _sql("select id, coalesce(nullif(title, ''), 'Untitled') as title, left(coalesce(markdown, ''), 100) as preview from rec"),
    "resource_rows": _sql(
        """select 'lifelog://' || strftime(start_time, '%Y-%m-%d') || '/' || id as uri, title as name,
'Lifelog from ' || strftime(start_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z to ' || coalesce(strftime(end_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', 'unknown') as description, 'application/json' as mime_type,
id, start_time, end_time, markdown is not null and markdown <> '' as has_markdown, (select count(*) from nodes where lifelog_id = rec.id and parent_node_id is null) as content_count from rec"""
    ),
    "resource_list_recent": _sql("select id, title, start_time from newest", 20),
    "resource_read_day": _sql(f"select id, title, start_time from rec where cast(start_time as date) = date '{DAY}'"),
    "weekday_counts": "select cast(date_trunc('week', ts) as date) as week, cast(isodow(ts) - 1 as int) as weekday, count(*) as n from events group by 1, 2",
    "sparse_weekday_spine": _sql("select day, (select count(*) from rec where cast(start_time as date) = day) as n from (values (date '2023-01-16'), (date '2023-01-09'), (date '2023-01-02'), (date '2022-12-26')) t(day)"),
    "monthly_rollup": _sql(f"select cast(date_trunc('month', start_time) as date) as month, count(*) as n, count(*) filter (trim(title) <> '') as n_titled, cast(coalesce(sum(case when {_seconds('start_time', 'end_time')} > 0 then {_seconds('start_time', 'end_time')} else 0 end), 0) as bigint) as total_seconds from rec where start_time is not null group by 1"),
    "speaker_stats": _sql("select speaker_name, count(*) as n_utterances, count(distinct lifelog_id) as n_recordings, cast(coalesce(sum(length(content)), 0) as bigint) as n_chars from nodes where kind = 'blockquote' and speaker_name is not null group by speaker_name"),
    "payload_errors": "select payload_id, j->>'$.error.message' as message, j->>'$.error.code' as code from (select payload_id, cast(body as json) as j from lifelog_payloads where body is not null and json_valid(body)) where json_exists(j, '$.error.message') or json_exists(j, '$.error.code')",
    "payload_states": "select case when body is null then 'null' when trim(body) = '' then 'empty' when not json_valid(body) then 'invalid' when json_type(body) = 'ARRAY' or json_exists(body, '$.data') or json_exists(body, '$.lifelogs') or json_exists(body, '$.lifelog') or json_exists(body, '$.contents') then 'data' when json_exists(body, '$.error') then 'error' else 'unknown' end as state, count(*) as n from lifelog_payloads group by 1",
    "payload_unknown": """select payload_id, array_to_string(list_sort(json_keys(body)), ',') as found from lifelog_payloads where body is not null and json_valid(body) and json_type(body) <> 'ARRAY'
and not (json_exists(body, '$.data') or json_exists(body, '$.lifelogs') or json_exists(body, '$.lifelog') or json_exists(body, '$.contents') or json_exists(body, '$.error'))""",
    "keyword_watch": "select distinct id, term from lifelogs, (values ('Survey'), ('insurance')) t(term) where coalesce(contains(lower(title), lower(term)), false) or coalesce(contains(lower(markdown), lower(term)), false)",
    "arrivals_by_hour": "select date_trunc('hour', received_at) as hour, count(*) as n from lifelogs where received_at is not null group by 1",
    "payload_pages": """select payload_id, c as next_cursor, coalesce(h, c is not null) as has_more from (
select payload_id, coalesce(body->>'$.pagination.nextCursor', body->>'$.meta.lifelogs.nextCursor') as c, try_cast(body->>'$.pagination.hasMore' as boolean) as h from lifelog_payloads where body is not null and json_valid(body))""",
    "vector_search": """select query_id, vec_id, score, rank from (
select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
  select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[])), 6) as score from embeddings v, embeddings q where q.vec_id % 100 = 0 and v.vec_id <> q.vec_id)) where rank <= 10""",
    "hybrid_ranking": _sql(
        f""", hits as (select *, {_SCORE} as score from scored where {_SCORE} > 0 and start_time is not null),
ranks as (select id, rank from (select id, row_number() over (order by score desc, start_time desc, id desc) as rank from hits) where rank <= {NEWEST}
  union all select id, rank from (select id, row_number() over (order by start_time desc, id desc) as rank from hits) where rank <= {NEWEST}
  union all select lifelog_id, min(rank) from (
    select v.vec_id, row_number() over (order by round(list_cosine_similarity(cast(v.embedding as double[]), cast(q.embedding as double[])), 6) desc, v.vec_id) as rank
    from embeddings v, (select * from embeddings order by vec_id limit 1) q where v.vec_id <> q.vec_id)
    join documents on doc_id = vec_id where rank <= {NEWEST} and lifelog_id is not null group by lifelog_id)
select id, round(sum(1.0 / cast(60 + rank as double)), 9) as score from ranks group by id"""
    ),
    "first_headings": _sql("select lifelog_id, string_agg(line, chr(10) order by k) as headings from (select lifelog_id, coalesce(content, '') as line, row_number() over (partition by lifelog_id order by ordinal, node_id) as k from nodes where parent_node_id is null and kind in ('heading1', 'heading2')) where k <= 3 group by lifelog_id"),
    "nodes_without_headings": _sql("select node_id, lifelog_id, kind, content from nodes where lifelog_id in (select id from newest) and (kind is null or not starts_with(kind, 'heading'))", 20),
    "recordings_having": _sql(f"select id, title from rec where {_seconds('start_time', 'end_time')} between 300 and 3600 and {_holds('survey', 'title', 'markdown')}"),
    "resource_parts": _sql(
        """, uris as (select distinct unnest(['lifelog://' || strftime(start_time, '%Y-%m-%d') || '/' || id, 'lifelog://' || strftime(start_time, '%Y-%m-%d'), 'lifelog://' || id, 'lifelog://recent']) as uri from rec),
cut as (select uri, nullif(regexp_extract(uri, '^lifelog://([0-9]{4}-[0-9]{2}-[0-9]{2})(/.+)?$', 1), '') as date, nullif(regexp_extract(uri, '^lifelog://[0-9]{4}-[0-9]{2}-[0-9]{2}/(.+)$', 1), '') as id from uris)
select uri, coalesce(uri in ('lifelog://', 'lifelog://recent'), false) or date is not null as valid, coalesce(uri = 'lifelog://recent', false) as recent, date, id from cut"""
    ),
    "resource_read_one": _sql(f"select id, title, start_time from rec where id = (select min(id) from rec where cast(start_time as date) = date '{DAY}')"),
    "parsed_times": NODE_TREE
    + r"""
, written as (select payload_id, cast(recording_no as int) as recording_no, r->>'$.startTime' as start_time from recordings)
select payload_id, recording_no, start_time, coalesce(regexp_full_match(start_time, '\d{4}-\d{2}-\d{2}') and try_cast(start_time as date) is not null, false) as is_day,
  coalesce(regexp_full_match(start_time, '\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}|T\d{2}:\d{2}:\d{2}([.]\d{1,3})?Z?)') and try_cast(replace(replace(start_time, 'T', ' '), 'Z', '') as timestamp) is not null, false) as is_time,
  case when regexp_full_match(start_time, '\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}([.]\d{1,6})?(Z|[+-]\d{2}:\d{2})?)?') then
    try_cast(replace(substr(start_time, 1, 10 + length(regexp_extract(start_time, '[ T][0-9:.]+'))), 'T', ' ') as timestamp)
    - to_minutes(coalesce(try_cast(nullif(regexp_extract(start_time, '([+-]\d{2}):\d{2}$', 1), '') as bigint) * 60
      + case when regexp_matches(start_time, '-\d{2}:\d{2}$') then -1 else 1 end * try_cast(nullif(regexp_extract(start_time, '[+-]\d{2}:(\d{2})$', 1), '') as bigint), 0)) end as parsed from written""",
    "speaking_time": _sql(
        f"""select cast(date_trunc('month', start_time) as date) as month, speaker, count(*) as n_utterances, cast(coalesce(sum(greatest({_seconds('start_time', 'end_time')}, 0)), 0) as bigint) as seconds
from (select *, nullif(lower(trim(speaker_name)), '') as speaker from nodes where kind = 'blockquote') where speaker is not null and start_time is not null group by 1, 2"""
    ),
    "monthly_topics": _sql("select month, word, count(*) as n from (select cast(date_trunc('month', start_time) as date) as month, unnest(list_distinct(regexp_split_to_array(lower(title), '[^a-z]+'))) as word from rec where start_time is not null) where length(word) >= 6 group by 1, 2"),
}
