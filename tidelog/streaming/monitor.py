"""New recordings as they arrive: each once, watched for keywords, counted by the hour."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidelog.operators.retrieval import holds
from tidelog.sources import shared_folder


def arriving(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into a folder, a bounded number in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def table_arriving(spark: SparkSession, sf_dir: str, name: str, schema: StructType) -> DataFrame:
    """One table of a data folder as a stream, a Parquet file or a folder of them as in :func:`tidelog.sources.table`."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 100)
    return reader.parquet(f"{sf_dir}/{{{name}.parquet,{name}.parquet/*}}")


def watched(stream: DataFrame, terms: list[str], key: str = "id", at: str = "received_at", lateness: str = "1 day") -> DataFrame:
    """(key, at, term): each term in title or markdown of a row, once a key inside the watermark.

    A term that only a later, more complete delivery has comes out with that. The state holds pairs of
    key and term for ``lateness`` only, so it doesn't grow with the stream.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    found = F.array_compact(F.array(*[F.when(holds(t, "title", "markdown"), F.lit(t)) for t in terms]))
    return timed.select(key, at, F.explode(found).alias("term")).dropDuplicatesWithinWatermark([key, "term"])


def by_window(stream: DataFrame, at: str = "received_at", width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """(start, n): rows by window of their time; a window comes out when the watermark has passed it."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return timed.groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def started(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs the stream with an action for each batch: on a schedule, or over what is there and then ends."""
    writer = stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def replayed(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream gives over what is there, run to its end.

    Batches go to the shared folder, each to a place of its own, so a batch that is tried again writes
    the same rows once; in complete mode each batch is the whole result, and the last one is returned.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    place = (lambda n: f"{folder}/rows/batch={n}") if mode == "append" else (lambda n: f"{folder}/rows")
    last = lambda df, n: df.write.mode("overwrite").parquet(place(n))
    query = stream.writeStream.outputMode(mode).foreachBatch(last).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    except AnalysisException:  # no batch came
        return spark.createDataFrame([], stream.schema)
