"""The canonical event row and the session settings that its semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("message", T.StringType(), False),
        T.StructField("level", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("raw", T.StringType()),
    ]
)
FILE_POSITION = T.StructType([T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("inode", T.LongType())])
WAL_ENTRY = T.StructType([T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType()), T.StructField("event", EVENT)])
DEAD_LETTER = T.StructType(
    [
        T.StructField("event", EVENT),
        T.StructField("error", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("retries", T.IntegerType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
COMPONENT_HEALTH = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("last_checked", T.TimestampType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that event semantics rely on: the last of duplicate map keys wins, times are UTC."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
