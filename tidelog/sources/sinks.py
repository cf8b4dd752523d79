"""Recordings written out: by day, as lines of text, as CSV or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_day(recordings: DataFrame, path: str, ts: str = "start_time", rows_a_file: int = 1_000_000) -> None:
    """Parquet in folders year=/month=/day=; rows without a time go to Spark's folder of null.

    Days are counted first, and each is spread over as many tasks as its rows need, so a busy day is
    not one task. The counts, a row a day, are broadcast.
    """
    parts = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)}
    files = recordings.groupBy(F.to_date(ts).alias("_day")).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_a_file)).alias("_files"))
    rows = recordings.withColumns(parts).withColumn("_date", F.to_date(ts)).join(F.broadcast(files), F.col("_date").eqNullSafe(F.col("_day")), "left")
    spread = rows.withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files"))).repartition("year", "month", "day", "_file")
    spread.drop("_date", "_day", "_files", "_file").write.mode("overwrite").partitionBy(*parts).parquet(path)


def write_text(rendered: DataFrame, path: str, text: str = "text") -> None:
    """One file per task, an item and an empty line after another."""
    rendered.select(text).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes and line ends in texts survive."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    df.write.mode("overwrite").json(path)


def read_csv(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
