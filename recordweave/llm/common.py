"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch: text batches stay small, whatever a row holds.
BATCH_ROWS, BATCH_BYTES = 1000, 3 << 20


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches that Python workers get by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir where it isn't yet.

    Only a local master (tests) may leave that unset and gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="recordweave-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and cuts its lineage.

    A lost executor loses nothing: the files are in shared storage.
    """
    shared_folder(session_of(df))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, by: str) -> DataFrame:
    """Writes ``df`` as a table in the shared checkpoint folder, a part for each value of ``by``, and reads it again."""
    spark = session_of(df)
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8 bytes, nulls as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def shuffle_parts(spark: SparkSession, total_bytes: int, target: int = 64 << 20) -> int:
    """Number of partitions for ``total_bytes``, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // target), 1)
