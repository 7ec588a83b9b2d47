"""Registration, and the lines that both engines make out of ``events`` with the same expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import prepare

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: Text of a time in each engine.
_SPARK = {"iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "plain": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "syslog": "date_format(ts, 'MMM dd HH:mm:ss')", "http": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')", "slash": "date_format(ts, 'yyyy/MM/dd HH:mm:ss')", "words": "date_format(ts, 'MMM dd, yyyy HH:mm:ss')"}
_DUCK = {"iso": "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", "plain": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "syslog": "strftime(ts, '%b %d %H:%M:%S')", "http": "strftime(ts, '%d/%b/%Y:%H:%M:%S')", "slash": "strftime(ts, '%Y/%m/%d %H:%M:%S')", "words": "strftime(ts, '%b %d, %Y %H:%M:%S')"}

#: A level in mixed spellings, and the number in ``props``, the same in both dialects.
LEVEL = "CASE event_type WHEN 'click' THEN 'INFO' WHEN 'purchase' THEN 'information' WHEN 'error' THEN 'ERR' WHEN 'signup' THEN 'WARNING' ELSE 'TRACE' END"
NORMAL = "CASE event_type WHEN 'click' THEN 'info' WHEN 'purchase' THEN 'info' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'debug' END"
UPPER = "CASE event_type WHEN 'click' THEN 'INFO' WHEN 'purchase' THEN 'DEBUG' WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'FATAL' END"
NUMBER = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
#: Rows that one task parses at most; an event that is kept in memory takes about 300 bytes.
ROWS_PER_TASK = 1 << 18
ID, USER = "CAST(event_id AS STRING)", "CAST(user_id AS STRING)"


def register(name: str, sql: str | None = None):
    def add(run):
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(prepare(spark), sf_dir)

        QUERIES[name] = (prepared, sql)
        return run

    return add


def spark_line(expression: str) -> str:
    return expression.format(**_SPARK)


def duck_line(expression: str) -> str:
    return expression.format(**_DUCK)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the files make fewer partitions than that (parsing costs more than moving lines), and over
    more tasks where a partition has more than ROWS_PER_TASK, so a task doesn't grow with the table.
    Tables of many small partitions stay as they are."""
    cores, rows = df.sparkSession.sparkContext.defaultParallelism, df.count()  # counts read no column
    tasks = max(cores, -(-rows // ROWS_PER_TASK))
    enough = df.rdd.getNumPartitions() >= tasks
    if enough and rows > ROWS_PER_TASK:
        enough = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= ROWS_PER_TASK
    return df if enough else df.repartition(tasks)


def lines(spark: SparkSession, sf_dir: str, expression: str, *more: str) -> DataFrame:
    """(event_id, ts, source, line, ...) of the events."""
    return spread(events(spark, sf_dir)).selectExpr("event_id", "ts", f"concat('app', {USER}) AS source", f"{spark_line(expression)} AS line", *more)


def duck_lines(expression: str, *more: str) -> str:
    return "SELECT " + ", ".join(["event_id", "ts", f"'app' || {USER} AS source", f"{duck_line(expression)} AS line", *more]) + " FROM events"
