"""Parquet tables and the choice of each key's latest delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder: a Parquet file or a folder of Parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_delivery(df: DataFrame, keys: list[str], columns: list[str], at: str = "received_at") -> DataFrame:
    """One row per key with ``columns`` of the row with the greatest ``at``.

    An aggregate with map-side combine, so a key that is delivered very often never gathers in one
    task, as it would with a window. Rows with a null ``at`` lose to all others; rows that tie are
    taken to be identical; null keys form one key; an empty table gives an empty result. Columns of
    fixed width keep Spark's hash aggregate; others need its sort aggregate.
    """
    order = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**63)))
    if all(isinstance(df.schema[c].dataType, FIXED_WIDTH) for c in columns):
        return df.groupBy(*keys).agg(*[F.max_by(F.col(c), order).alias(c) for c in columns])
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in columns]), order).alias("_row"))
    return one.select(*keys, *[F.col("_row").getField(c).alias(c) for c in columns])
