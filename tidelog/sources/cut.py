"""Cutting lineage with files that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the session names in ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a temporary one; on a cluster it is an error, since no
    machine's own folder serves.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder; a lost executor loses nothing.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the files of plans that are gone.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
