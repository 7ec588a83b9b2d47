"""A sink that writes each batch of events as one object under an exact key, and can be repeated.

spark.dataSource.register(ObjectSink)

Tasks write whole objects: a file of another name first, then a move, so an object is there in full or not at all.  A
task's commit message lists its objects; the commit writes a manifest of the run with all of them and removes what an
earlier attempt of that run left under other keys.  A repeated run gives the same keys, so it replaces its objects.  When
the job fails, objects of its finished tasks are removed unless the run's manifest from before holds them.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.names import object_key
from ..operators.parsers import event_json

MANIFESTS = "_manifests"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (key, lines, bytes) of each object."""

    objects: list[tuple[str, int, int]]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ObjectSink(DataSource):
    """Options: path, run (repeating a run replaces it), compression (none or gzip).  Rows are (batch, key, value), batch by batch."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ObjectWriter(self.options["path"], self.options["run"], self.options.get("compression", "none"))


class ObjectWriter(DataSourceWriter):
    def __init__(self, path: str, run: str, compression: str):
        if compression not in ("none", "gzip"):
            raise ValueError(f"objects can't be compressed by {compression}")
        self.path, self.run, self.compression = path, run, compression

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = _file_system(self.path)
        out, batch, open_ = Written([]), None, None
        try:
            for row in iterator:
                if open_ is None or row[0] != batch:
                    if open_:
                        out.objects.append(open_.close())
                    batch, open_ = row[0], _Object(files, root, row[1], self.compression)
                open_.add(row[2])
            if open_:
                out.objects.append(open_.close())
        except BaseException:
            if open_:
                open_.drop()
            for key, _, _ in out.objects:  # this attempt's; another one writes them again
                _remove(files, f"{root}/{key}")
            raise
        return out

    def _manifest(self, files, root: str) -> list[str]:
        try:
            with files.open_input_stream(f"{root}/{MANIFESTS}/{self.run}.json") as f:
                return [x["key"] for x in json.loads(f.read())["objects"]]
        except FileNotFoundError:
            return []

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _file_system(self.path)
        objects = sorted(x for m in messages if m for x in m.objects)
        before = self._manifest(files, root)
        files.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        begun = f"{root}/{MANIFESTS}/.{self.run}.{uuid.uuid4().hex}"
        with files.open_output_stream(begun) as f:
            f.write(json.dumps({"run": self.run, "objects": [{"key": k, "lines": n, "bytes": b} for k, n, b in objects]}).encode())
        files.move(begun, f"{root}/{MANIFESTS}/{self.run}.json")
        for key in set(before) - {k for k, _, _ in objects}:
            _remove(files, f"{root}/{key}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _file_system(self.path)
        held = set(self._manifest(files, root))
        for key in {x[0] for m in messages if m for x in m.objects} - held:
            _remove(files, f"{root}/{key}")


def _remove(files, path: str) -> None:
    try:
        files.delete_file(path)
    except FileNotFoundError:
        pass


class _Object:
    """An object that is being written under another name."""

    def __init__(self, files, root: str, key: str, compression: str):
        self.files, self.key, self.path = files, key, f"{root}/{key}"
        folder, _, name = self.path.rpartition("/")
        files.create_dir(folder, recursive=True)
        self.begun = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.raw = files.open_output_stream(self.begun)
        # No time and no name in the header: a repeated batch gives the same bytes.
        self.out = gzip.GzipFile("", "wb", fileobj=self.raw, mtime=0) if compression == "gzip" else self.raw
        self.lines = 0

    def add(self, line: str) -> None:
        self.out.write(line.encode() + b"\n")
        self.lines += 1

    def close(self) -> tuple[str, int, int]:
        if self.out is not self.raw:
            self.out.close()
        self.raw.close()
        self.files.move(self.begun, self.path)
        return self.key, self.lines, self.files.get_file_info(self.path).size

    def drop(self) -> None:
        self.raw.close()
        _remove(self.files, self.begun)


def keyed_batches(events: DataFrame, template: str, prefix: str = "", compression: str = "none", batch: str = "batch", order: str = "seq", time: str = "timestamp") -> DataFrame:
    """(batch, key, value): the events' lines, batch by batch in order, with the object key of the batch's first event.

    Batches whose first events give one key get -1, -2 and so on before its extension, in the order of batches.
    """
    firsts = events.groupBy(F.col(batch).alias("of")).agg(F.min_by(time, order).alias("first")).withColumn("plain", object_key(F.col("first"), template, prefix, compression))
    again = F.row_number().over(Window.partitionBy("plain").orderBy("of")) - 1
    firsts = firsts.withColumn("again", again)
    ending = r"((?:\.[A-Za-z0-9]+)*)\z"
    key = F.when(F.col("again") == 0, F.col("plain")).otherwise(F.concat(F.regexp_replace("plain", ending, ""), F.lit("-"), F.col("again").cast("string"), F.regexp_extract("plain", ending, 1)))
    rows = events.select(F.col(batch).alias("batch"), F.col(order).alias("order"), event_json(events).alias("value")).join(firsts.select("of", key.alias("key")), F.col("batch") == F.col("of"))
    return rows.repartition("batch").sortWithinPartitions("batch", "order").select("batch", "key", "value")


def write_batches(events: DataFrame, path: str, run: str, template: str = "{{.Timestamp}}.json", prefix: str = "", compression: str = "none", batch: str = "batch", order: str = "seq", time: str = "timestamp") -> None:
    """Writes each batch of ``events`` as one object of JSON lines; see ``ObjectSink`` for what ``run`` does."""
    spark = events.sparkSession
    spark.createDataFrame([], "none int")  # makes the session this thread's, where the writer looks for its source
    spark.dataSource.register(ObjectSink)
    keyed_batches(events, template, prefix, compression, batch, order, time).write.format("objects").option("path", path).option("run", run).option("compression", compression).mode("append").save()


def read_manifest(path: str, run: str) -> list[dict]:
    """The objects of a committed run: key, lines and bytes of each."""
    files, root = _file_system(path)
    with files.open_input_stream(f"{root}/{MANIFESTS}/{run}.json") as f:
        return json.loads(f.read())["objects"]
