"""Retrieval, search and rendering on small literal tables, one quirk at a time."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog import params
from tidelog.functions import dates
from tidelog.operators import render, resources, retrieval, rollups, textops
from tidelog.params import ByDate, ById, ByRange, InvalidParameter, Listing, Search
from tidelog.schema import NODE, RECORDING

T0 = datetime(2024, 1, 15, 12)


def logs(spark, rows):
    """(id, title, markdown, start, end[, received]) rows as recordings."""
    return spark.createDataFrame([(r[0], 1, r[1], r[2], r[3], r[4], r[5] if len(r) > 5 else T0) for r in rows], RECORDING)


def nodes(spark, rows):
    """(node_id, lifelog_id, kind, content[, parent, ordinal]) rows as nodes."""
    return spark.createDataFrame([(r[0], r[1], 1, r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else 0, r[2], r[3], None, None, None, None, None, None, T0) for r in rows], NODE)


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def day(spark):
    rows = [(f"r{i:02}", f"Item {i}", "even topic" if i % 2 == 0 else None, T0 - timedelta(hours=i), T0) for i in range(40)]
    return logs(spark, rows)


def test_latest_delivery_wins(spark):
    df = logs(spark, [("a", "first", None, T0, None, T0), ("a", "second", "m", T0 + timedelta(1), None, T0 + timedelta(2)), ("a", "lost", "m", T0, None, None)])
    assert [r.title for r in retrieval.recordings(df).collect()] == ["second"]
    assert ids(retrieval.by_date(df, ByDate(date="2024-01-15"))) == []
    assert ids(retrieval.by_date(df, ByDate(date="2024-01-16"))) == ["a"]


def test_order_limit_and_ties(spark):
    df = logs(spark, [("a", "", None, T0, None), ("c", "", None, T0, None), ("b", "", None, T0, None), ("d", "", None, None, None)])
    assert ids(retrieval.recent(df, Listing(limit=2))) == ["c", "b"]
    assert ids(retrieval.recent(df, Listing(limit=2, direction="asc"))) == ["b", "c"]
    assert len(ids(retrieval.recent(df, Listing()))) == 3


def test_by_id(day):
    assert ids(retrieval.by_id(day, ById(id="r03"))) == ["r03"]
    with pytest.raises(retrieval.NotFound):
        retrieval.required(retrieval.by_id(day, ById(id="none")))


def test_zone_days():
    hours = lambda d: (lambda a, b: (b - a) / timedelta(hours=1))(*dates.day_bounds(d, "America/New_York"))
    assert hours("2024-03-10") == 23 and hours("2024-11-03") == 25 and hours("2024-01-15") == 24


def test_range(day):
    keep = ids(retrieval.by_range(day, ByRange(start="2024-01-15 09:00:00", end="2024-01-15 11:00:00", direction="asc")))
    assert keep == ["r03", "r02"]  # the end is left out
    whole = ids(retrieval.by_range(day, ByRange(start="2024-01-15 09:00:00", end="2024-01-16 11:00:00"), date_only=True))
    assert len(whole) == 13
    assert ids(retrieval.by_range(day, ByRange(start="2024-01-15T04:00:00", end="2024-01-15T06:00:00", timezone="America/New_York"))) == ["r02", "r03"]


def test_search_scope_comes_first(spark, day):
    none = nodes(spark, [])
    assert ids(retrieval.search(day, none, Search(term="EVEN", fetch_limit=20, limit=5))) == ["r00", "r02", "r04", "r06", "r08"]
    assert ids(retrieval.search(day, none, Search(term="item 30", fetch_limit=20))) == []
    assert ids(retrieval.search(day, none, Search(term="item 30", fetch_limit=100))) == ["r30"]
    assert ids(retrieval.search(day, none, Search(term="even", fetch_limit=5, direction="asc"))) == ["r04", "r02", "r00"]


def test_search_nested_and_literal(spark):
    df = logs(spark, [("a", None, None, T0, None), ("b", "50% off", None, T0, None)])
    content = nodes(spark, [(1, "a", "text", "The Budget"), (2, "b", "text", "none"), (3, "zz", "text", "budget"), (4, "b", "text", "budget", 2)])
    assert ids(retrieval.search(df, content, Search(term="budget"))) == ["a"]
    assert ids(retrieval.search(df, content, Search(term="0% o"))) == ["b"]
    assert ids(retrieval.search(df, content, Search(term="_"))) == []
    hits = {r.id: r.hits for r in retrieval.matches(df, content, ["budget", "off"], 20, ["title"]).collect()}
    assert hits == {"a": [True, False], "b": [False, True]}


def test_pages(day):
    first = retrieval.recent(day, Listing(limit=7)).collect()
    after = ids(retrieval.page_after(day, str(first[-1].start_time), first[-1].id, 7))
    assert after == [f"r{i:02}" for i in range(7, 14)]


def test_excluding_keeps_missing_text(spark):
    df = logs(spark, [("a", None, None, T0, None), ("b", "Private", None, T0, None), ("c", "ok", "a private call", T0, None), ("d", "ok", None, T0, None)])
    assert sorted(ids(textops.excluding(df, ["private", "x"]))) == ["a", "d"]


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), ("a", 3, "z")], "id string, place int, title string")
    assert sorted(tuple(r) for r in textops.keep_last(df, "id", "place", ["title"]).collect()) == [("a", "z", 1), ("b", "y", 2)]


def test_counts_and_relevance(spark):
    df = logs(spark, [("a", "The C++ plan", "c++ c++ (and) The plan", T0, None), ("b", None, "other", T0, None), ("c", "c++", None, T0 - timedelta(1), None)])
    counts = {r.phrase: r.n for r in textops.phrase_counts(df, ["C++", "the plan", "none"], 1).collect()}
    assert counts == {"C++": 1, "the plan": 1, "none": 0}
    assert {r.id: r.n for r in df.select("id", textops.term_frequency(df, "c++", "markdown").alias("n")).collect()} == {"a": 2, "b": 0, "c": 0}
    assert {r.id: r.score for r in textops.relevance(df, "c++").collect()} == {"a": 10 + 20 + 2 * 3, "b": 0, "c": 10 + 20 + 2}
    assert ids(textops.most_relevant(df, "c++", 2)) == ["a", "c"]
    assert [r.word for r in textops.related_words(spark.createDataFrame([(1, "Launching the LAUNCHING platform, platform now"), (2, None), (3, "afterwards launching")], "place int, markdown string"), "now").collect()] == ["launching", "platform,", "platform", "afterwards"]


def test_durations(spark):
    seconds = [0, 26, 240, 3600, 3866, None, -5, 90061]
    df = spark.createDataFrame([(s,) for s in seconds], "s bigint")
    assert [r[0] for r in df.select(dates.duration_text(F.col("s"))).collect()] == ["0s", "26s", "4m", "1h", "1h 4m 26s", None, None, "25h 1m 1s"]


@pytest.mark.parametrize(("text", "day", "time"), [("2024-01-15", True, False), ("2024-02-30", False, False), ("01-15-2024", False, False), ("2024-01-15 10:30:00", False, True), ("2024-01-15T10:30:00.123Z", False, True), ("2024-01-15T25:00:00Z", False, False), ("", False, False)])
def test_date_forms(spark, text, day, time):
    assert dates.is_date(text) is day and dates.is_date_time(text) is time
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(dates.valid_date(F.col("t"))).first()[0] is day and df.select(dates.valid_date_time(F.col("t"))).first()[0] is time


def test_parsed(spark):
    want = {"2024-01-15": datetime(2024, 1, 15), "2024-01-15 10:30:00": datetime(2024, 1, 15, 10, 30), "2024-01-15T10:30:00.5Z": datetime(2024, 1, 15, 10, 30, 0, 500_000), "2024-01-15T10:30:00-05:30": datetime(2024, 1, 15, 16), "2024-13-01": None, "soon": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.p for r in df.select("t", dates.parsed(F.col("t")).alias("p")).collect()} == want


def test_parameters():
    assert params.count("limit", "50") == 50
    assert params.flag("x", "false") is False and params.flag("x", True) is True
    for bad in ({"limit": 0}, {"limit": 101}, {"limit": "x"}, {"limit": True}, {"direction": "up"}, {"timezone": "Mars/One"}, {"include_markdown": "maybe"}):
        with pytest.raises(InvalidParameter):
            Listing(**bad)
    for make in (lambda: Search(term=""), lambda: Search(term="x", fetch_limit=200), lambda: ByDate(date="01-15-2024"), lambda: ByRange(start="x", end="2024-01-01"), lambda: ById()):
        with pytest.raises(InvalidParameter):
            make()


def test_rendering(spark):
    df = logs(spark, [("a", "", None, T0, T0 + timedelta(hours=1)), ("b", "B", "# body", None, None)])
    content = nodes(spark, [(9, "a", "Heading1", "One", None, 0), (2, "a", "heading2 ", "Two", None, 1), (3, "a", "blockquote", "said", None, 2), (4, "a", "text", "left out", None, 3), (1, "a", "heading1", None, None, 4), (5, "a", "heading2", "nested", 9, 0)])
    outlines = render.outline(retrieval.nodes(content))
    text = {r.id: r.text for r in render.rendered(df, outlines).collect()}
    times = "Start Time: Jan 15, 2024, 12:00 PM UTC\nEnd Time: Jan 15, 2024, 01:00 PM UTC\nDuration: 1h\n"
    assert text["a"] == f"ID: a\nTitle: Untitled\n{times}\nHeadings:\n  1. One\n  2. Two\n  3. \n\nContent:\n\n# One\n\n## Two\n> said\n\n# "
    assert text["b"] == "ID: b\nTitle: B\n\nContent:\n# body"
    plain = {r.id: r.text for r in render.rendered(df, outlines, include_markdown=False, include_headings=False).collect()}
    assert plain["b"] == "ID: b\nTitle: B" and "Headings" not in plain["a"] and "> said" in plain["a"]


def test_zones(spark):
    df = logs(spark, [("a", "A", None, T0, datetime(2024, 7, 1, 3))])
    shown = lambda zone: render.rendered(df, zone=zone).first().text.split("\n")[2:4]
    assert shown("America/New_York") == ["Start Time: Jan 15, 2024, 07:00 AM EST", "End Time: Jun 30, 2024, 11:00 PM EDT"]
    assert shown("Asia/Tokyo")[0] == "Start Time: Jan 15, 2024, 09:00 PM JST" and shown("UTC")[0].endswith("12:00 PM UTC")


def test_headings(spark):
    content = nodes(spark, [(k, "a", "heading1", f"h{k}", None, 9 - k) for k in range(5)] + [(7, "a", "blockquote", "q", None, 20), (8, "b", "heading1", "deep", 3, 0)])
    assert [tuple(r) for r in render.first_headings(retrieval.nodes(content)).collect()] == [("a", "h4\nh3\nh2")]
    listing = logs(spark, [("a", None, None, T0, None)])
    count = lambda **p: retrieval.contents_of(listing, content, Listing(**p)).count()
    assert count() == 6 and count(include_headings=False) == 1


def test_reading_order(spark):
    """A deep tree in any order of rows; circles and nodes without their parent are left out."""
    deep = [(100 + k, "b", "blockquote", str(k), 99 + k if k else None, 0) for k in range(21)]
    rows = [(5, "a", "heading1", "one", None, 1), (9, "a", "heading1", "zero", None, 0), (2, "a", "blockquote", "said", 5, 1), (7, "a", "heading2", "two", 5, 0), (1, "a", "blockquote", "inner", 7, None), (3, "a", "text", "no line", 9, 0)]
    odd = [(50, "a", "blockquote", "lost", 49, 0), (60, "a", "blockquote", "x", 61, 0), (61, "a", "blockquote", "y", 60, 0)]
    got = {r.lifelog_id: r.body for r in render.transcript(retrieval.nodes(nodes(spark, [*deep[::-1], *rows, *odd]))).collect()}
    assert got == {"a": "\n# zero\n\n# one\n\n## two\n> inner\n> said", "b": "\n".join(f"> {k}" for k in range(21))}
    assert render.transcript(retrieval.nodes(nodes(spark, []))).count() == render.transcript(retrieval.nodes(nodes(spark, odd[1:]))).count() == 0


def test_having(spark):
    df = logs(spark, [("a", "Roof", "leak", T0, T0 + timedelta(minutes=5)), ("b", "roof LEAK", None, T0, None), ("c", "roof", None, T0, T0 + timedelta(hours=2))])
    assert ids(retrieval.having(df, words=("roof", "leak"))) == ["a", "b"]
    assert ids(retrieval.having(df, 300, 7199)) == ["a"] and ids(retrieval.having(df, 301)) == ["c"]


def test_speaking_time_and_topics(spark):
    T1 = T0 + timedelta(seconds=90)
    rows = [("blockquote", " Ana", T0, T1), ("blockquote", "ANA ", T0, None), ("blockquote", "ana", T1, T0), ("blockquote", None, T0, T1), ("heading1", "ana", T0, T1), ("blockquote", "bo", None, T1), ("blockquote", "bo", datetime(2024, 2, 1), datetime(2024, 2, 1, 1))]
    said = spark.createDataFrame(rows, "kind string, speaker_name string, start_time timestamp_ntz, end_time timestamp_ntz")
    assert sorted(tuple(r) for r in rollups.speaking_time(said).collect()) == [(date(2024, 1, 1), "ana", 3, 90), (date(2024, 2, 1), "bo", 1, 3600)]
    df = logs(spark, [("a", "Budget budget review", None, T0, None), ("b", "The BUDGET", None, T0, None), ("c", None, None, T0, None)])
    assert sorted(tuple(r)[1:] for r in rollups.topics(df).collect()) == [("budget", 2), ("review", 1)]


def test_narrow_plans(spark, sf):
    """What isn't asked for is not read, and a listing reads wide columns for its own rows alone."""
    from tidelog.plans import recordings as plans

    plan = lambda name: plans.QUERIES[name](spark, sf)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    for name in ("display_times", "duration_text", "monthly_rollup", "sparse_weekday_spine", "content_count", "speaking_time", "monthly_topics"):
        scans = [line for line in plan(name).split("\n") if "ReadSchema" in line]
        assert scans and not any("markdown" in x.split("ReadSchema")[1] for x in scans)
        assert name in ("monthly_topics",) or not any("content:" in x.split("ReadSchema")[1] or "title" in x.split("ReadSchema")[1] and name != "monthly_rollup" for x in scans)
    assert "GreaterThanOrEqual(start_time" in plan("sparse_weekday_spine")
    assert plan("list_recent").count("markdown:string") == 1 and plan("multi_keyword_distinct").count("FileScan") <= 5


def test_result_sets(spark):
    item = lambda *x: spark.createDataFrame(list(x), "start_time timestamp_ntz, id string, text string")
    assert render.result_set(item(), "test").first().text == 'No lifelogs found matching "test"'
    assert render.result_set(item()).first().text == "No lifelogs found"
    assert render.result_set(item((T0, "a", "A"))).first().text == "Found 1 lifelog:\n\nA"
    two = item((T0, "a", "A"), (T0 + timedelta(1), "b", "B"))
    assert render.result_set(two, "x").first().text == 'Found 2 lifelogs matching "x":\n\nB\n---\n\nA'
    assert render.result_set(two, most=1).first().text == "Found 1 lifelog:\n\nB"
    with pytest.raises(InvalidParameter):
        render.result_set(two, most=101)


def test_resources(spark, day):
    valid = ["lifelog://", "lifelog://recent", "lifelog://2024-01-15", "lifelog://2024-01-15/a/b"]
    assert all(resources.parse(u) for u in valid) and not any(resources.parse(u) for u in ["lifelog://x", "http://recent", "lifelog://2024-1-5", "lifelog://recent/1", ""])
    assert len(ids(resources.listed(day, "lifelog://recent"))) == 20 and len(ids(resources.read(day, "lifelog://recent"))) == 10
    assert {r.uri for r in resources.listed(day, "lifelog://").collect()} == set(resources.TEMPLATES) and resources.read(day, "lifelog://") is None
    uris = [*valid, "lifelog://x", "http://recent", "lifelog://2024-1-5", "lifelog://recent/1", "", None]
    for r in spark.createDataFrame([(u,) for u in uris], "uri string").select("uri", resources.parts(F.col("uri")).alias("p")).select("uri", "p.*").collect():
        a = resources.parse(r.uri) if r.uri is not None else None
        assert (r.valid, r.recent, r.date, r.id) == (a is not None, bool(a and a.recent), a and a.date, a and a.id), r
    assert ids(resources.read(day, "lifelog://2024-01-15/r03")) == ["r03"] and ids(resources.read(day, "lifelog://2024-01-14/r03")) == []
    counts = spark.createDataFrame([("r03", 2)], "lifelog_id string, content_count bigint")
    row = resources.rows(retrieval.recordings(day).selectExpr("*", "coalesce(markdown <> '', false) as has_markdown"), counts).where("id = 'r03'").first()
    assert row.uri == "lifelog://2024-01-15/r03" and row.content_count == 2 and row.has_markdown is False


def test_days(spark, day):
    assert rollups.last_days(date(2024, 1, 20), 0, 2) == [date(2024, 1, 15), date(2024, 1, 8)]
    assert rollups.last_days(date(2024, 1, 15), 0, 1) == [date(2024, 1, 8)]
    got = {r.day: r.n for r in rollups.on_days(day, "start_time", [date(2024, 1, 15), date(2023, 12, 25)]).collect()}
    assert got == {date(2024, 1, 15): 13, date(2023, 12, 25): 0}


def test_empty_tables(spark):
    none, no_nodes = logs(spark, []), nodes(spark, [])
    assert ids(retrieval.recent(none, Listing())) == ids(retrieval.search(none, no_nodes, Search(term="x"))) == []
    assert rollups.monthly(none.selectExpr("*", "true as titled")).count() == rollups.topics(none).count() == retrieval.having(none, 1, 2, ("x",)).count() == 0
    said = no_nodes.selectExpr("*", "lower(node_type) as kind", "1 as chars")
    assert rollups.speakers(said).count() == rollups.speaking_time(said).count() == render.outline(retrieval.nodes(no_nodes)).count() == render.first_headings(said).count() == 0
    assert {r.n for r in textops.phrase_counts(none, ["a", "b"]).collect()} == {0}


def test_plans_push_down(spark, sf):
    table = spark.read.parquet(f"{sf}/lifelogs.parquet")
    explain = lambda df: df._jdf.queryExecution().toString()
    assert "EqualTo(id,abc)" in explain(retrieval.by_id(table, ById(id="abc")))
    assert "GreaterThanOrEqual(start_time" in explain(retrieval.by_date(table, ByDate(date="2023-01-09", timezone="Asia/Tokyo")))
    assert "TakeOrderedAndProject" in explain(retrieval.recent(table, Listing()))
