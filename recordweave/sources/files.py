"""Batch and streaming text files, generated lines, and the positions of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shapes of generated lines: time first, then numbers.
SHAPES = (
    '{"timestamp":"%s","level":"info","message":"order %d packed","shelf":%d}',
    '{"timestamp":"%s","level":"warn","message":"queue is getting long","waiting":%d}',
    '{"timestamp":"%s","level":"error","message":"payment refused","code":%d,"attempt":%d}',
    '{"timestamp":"%s","level":"debug","message":"price list reloaded","entries":%d,"took_ms":%d}',
    '{"timestamp":"%s","level":"info","message":"van %d at stop %d"}',
    '%s INFO parcel %d left gate %d',
)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line) of text files (globs and folders as Spark reads them)."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Like ``text_lines`` for files that arrive in a folder."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return rows.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))


def _generated(number: str, seed: int) -> Column:
    """A line of one of the shapes, drawn by the row's number and the seed; its time is the column ts."""
    draw = lambda i, most: F.pmod(F.xxhash64(number, F.lit(seed), F.lit(i)), F.lit(most)).cast("int")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    shapes = [F.format_string(t, stamp, *[draw(i, (1000, 250)[i]) for i in range(t.count("%d"))]) for t in SHAPES]
    return F.element_at(F.array(*shapes), draw(9, len(SHAPES)) + 1)


def generated_lines(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(seq, ts, line): n lines of the six shapes (five JSON, one plain), the same for the same seed."""
    rows = spark.range(n).select(F.col("id").alias("seq"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"))
    return rows.withColumn("line", _generated("seq", seed))


def generated_stream(spark: SparkSession, per_second: int, seed: int = 1) -> DataFrame:
    """(seq, ts, line): the same lines as a stream, at a rate; their times are when they were made."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("seq"), F.col("timestamp").alias("ts"))
    return rows.withColumn("line", _generated("seq", seed))
