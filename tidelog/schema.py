"""Explicit schemas of recordings, nodes and the JSON that carries them."""

from pyspark.sql import types as T

RECORDING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("wearer_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("received_at", T.TimestampNTZType()),
    ]
)
NODE = T.StructType(
    [
        T.StructField("node_id", T.LongType()),
        T.StructField("lifelog_id", T.StringType()),
        T.StructField("wearer_id", T.LongType()),
        T.StructField("parent_node_id", T.LongType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("start_offset_ms", T.LongType()),
        T.StructField("end_offset_ms", T.LongType()),
        T.StructField("speaker_name", T.StringType()),
        T.StructField("speaker_identifier", T.StringType()),
        T.StructField("received_at", T.TimestampNTZType()),
    ]
)
