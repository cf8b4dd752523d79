"""Search recipes over listings: several terms, exclusion, counts, related words, relevance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.retrieval import holds

#: White space of any script, between words.
BLANKS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def full_text(title: str = "title", markdown: str = "markdown") -> Column:
    """Title and markdown in lower case with a blank between; a missing part counts as empty."""
    return F.lower(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(markdown), F.lit(""))))


def excluding(df: DataFrame, terms: list[str]) -> DataFrame:
    """Rows with none of the terms in title or markdown; rows without either stay."""
    text = full_text()
    for t in terms:
        df = df.where(~F.contains(text, F.lit(t.lower())))
    return df


def keep_last(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, columns, first_place): one row per key with the values of its last row and the place of its first.

    Aggregates, so a key with very many rows is combined before the shuffle; ties go to the greatest values.
    """
    last = F.max(F.struct(F.col(order), *[F.col(c) for c in columns])).alias("_last")
    return df.groupBy(key).agg(last, F.min(order).alias("first_place")).select(key, *[F.col("_last")[c].alias(c) for c in columns], "first_place")


def phrase_counts(df: DataFrame, phrases: list[str], most: int | None = None) -> DataFrame:
    """(phrase, n): how many rows have each phrase in title or markdown, 0 included, ``most`` at most.

    One pass with one counter a phrase instead of a join of rows and phrases.
    """
    counted = df.agg(*[F.count_if(holds(p, "title", "markdown")).alias(f"_{i}") for i, p in enumerate(phrases)])
    cap = (lambda c: F.least(c, F.lit(most))) if most else (lambda c: c)
    rows = F.array(*[F.struct(F.lit(p).alias("phrase"), cap(F.col(f"_{i}")).alias("n")) for i, p in enumerate(phrases)])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def related_words(df: DataFrame, topic: str, most: int = 10) -> DataFrame:
    """(word, place): the first ``most`` words of over five letters that don't contain the topic, in order of first use.

    ``df`` has ``place``, the order of its rows; words are cut at white space of any script, as they stand.
    """
    words = df.select("place", F.posexplode(F.split(F.lower(F.coalesce("markdown", F.lit(""))), BLANKS)).alias("at", "word"))
    kept = words.where((F.length("word") > 5) & ~F.contains(F.col("word"), F.lit(topic.lower())))
    first = kept.groupBy("word").agg(F.min(F.struct("place", "at")).alias("first"))
    return first.orderBy("first", "word").limit(most).select("word", F.col("first.place").alias("place"))


def term_frequency(df: DataFrame, term: str, text: str) -> Column:
    """How often the term stands in a text, letter case aside, signs in it taken as they are; 0 for null."""
    pattern = F.lit(r"(?i)\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E")
    return F.coalesce(F.regexp_count(F.col(text), pattern), F.lit(0)).cast("long")


def relevance(df: DataFrame, phrase: str) -> DataFrame:
    """``df`` with ``score``: 10 for the phrase in the text, 2 for each hit of each of its words, 20 for the phrase in the title."""
    text, title = full_text(), F.lower(F.coalesce(F.col("title"), F.lit("")))
    score = F.when(F.contains(text, F.lit(phrase.lower())), 10).otherwise(0) + F.when(F.contains(title, F.lit(phrase.lower())), 20).otherwise(0)
    scored = df.withColumn("_text", text)
    for w in re.split(r"\s+", phrase.lower().strip()):
        score = score + 2 * term_frequency(scored, w, "_text")
    return scored.withColumn("score", score.cast("long")).drop("_text")


def most_relevant(df: DataFrame, phrase: str, most: int = 5) -> DataFrame:
    """The ``most`` best rows; of equal scores the newer, then the greater id."""
    return relevance(df, phrase).orderBy(F.desc("score"), F.desc("start_time"), F.desc("id")).limit(most)


def numbered(df: DataFrame, by: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of ``df`` with ``place``, 1 for the first; each task gives that many, and one window has them."""
    return df.orderBy(*by).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*by)).cast("long"))
