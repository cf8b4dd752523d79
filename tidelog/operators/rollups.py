"""Counts and times by calendar and speaker."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.dates import seconds_between


def by_weekday(df: DataFrame, ts: str) -> DataFrame:
    """(week, weekday, n): rows by the Monday of their week and the weekday, 0 for Monday."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.to_date(F.date_trunc("week", ts)).alias("week"), F.weekday(ts).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


def last_days(before: date, weekday: int, k: int) -> list[date]:
    """The last ``k`` dates on ``weekday`` before a day, the latest first."""
    latest = before - timedelta(days=(before.weekday() - weekday - 1) % 7 + 1)
    return [latest - timedelta(weeks=i) for i in range(k)]


def on_days(df: DataFrame, ts: str, days: list[date]) -> DataFrame:
    """(day, n): rows on each of the days, 0 included. Of the rows of a table the days reach the scan as a filter."""
    spine = df.sparkSession.createDataFrame([(d,) for d in days], "day date")
    counts = df.where((F.col(ts) >= F.lit(min(days)).cast("timestamp_ntz")) & (F.col(ts) < F.lit(max(days) + timedelta(days=1)).cast("timestamp_ntz"))).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def _month(ts: str) -> Column:
    return F.to_date(F.date_trunc("month", ts)).alias("month")


def monthly(recordings: DataFrame) -> DataFrame:
    """(month, n, n_titled, total_seconds): recordings and their time by month of their start; ``titled`` says whether one has a title."""
    seconds = F.greatest(seconds_between(F.col("start_time"), F.col("end_time")), F.lit(0))
    rows = recordings.where("start_time is not null").withColumn("seconds", seconds)
    return rows.groupBy(_month("start_time")).agg(F.count(F.lit(1)).alias("n"), F.count_if("titled").alias("n_titled"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("total_seconds"))


def speakers(nodes: DataFrame) -> DataFrame:
    """(speaker_name, n_utterances, n_recordings, n_chars): utterances by speaker as labelled.

    ``nodes`` have ``chars``, the length of their content. Pre-aggregated by recording, so a speaker with a
    third of all rows shuffles a row per recording.
    """
    per = nodes.where("kind = 'blockquote' and speaker_name is not null").groupBy("speaker_name", "lifelog_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    return per.groupBy("speaker_name").agg(F.sum("n").alias("n_utterances"), F.count(F.lit(1)).alias("n_recordings"), F.coalesce(F.sum("chars"), F.lit(0)).alias("n_chars"))


def speaking_time(nodes: DataFrame) -> DataFrame:
    """(month, speaker, n_utterances, seconds): time spoken by month and speaker; labels count alike in any case and with any blanks around.

    An utterance without a start counts in no month, one without an end after its start has no time.
    """
    speaker = F.nullif(F.lower(F.trim("speaker_name")), F.lit(""))
    seconds = F.greatest(seconds_between(F.col("start_time"), F.col("end_time")), F.lit(0))
    rows = nodes.where("kind = 'blockquote' and start_time is not null").select(_month("start_time"), speaker.alias("speaker"), seconds.alias("seconds")).where("speaker is not null")
    return rows.groupBy("month", "speaker").agg(F.count(F.lit(1)).alias("n_utterances"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"))


def topics(recordings: DataFrame, shortest: int = 6) -> DataFrame:
    """(month, word, n): in how many recordings of a month each word of ``shortest`` letters or more stands in the title."""
    words = F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z]+"))).alias("word")
    rows = recordings.where("start_time is not null").select(_month("start_time"), words).where(F.length("word") >= shortest)
    return rows.groupBy("month", "word").agg(F.count(F.lit(1)).alias("n"))
