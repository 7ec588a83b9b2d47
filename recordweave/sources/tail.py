"""A streaming source that tails files: appended complete lines, by path, inode and byte offset.

spark.dataSource.register(TailSource)
spark.readStream.format("tail").option("paths", "/var/log/*.log").option("from", "end").load()
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source string, offset long, line string"


class TailSource(DataSource):
    """Options: paths (globs, comma-separated), from (``end``, the default, or ``start``), piece_bytes."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  the API's name
        return TailReader(self.options)


#: Bytes of a piece of a file; a longer backlog is read by several tasks.
PIECE = 64 << 20


class Piece(InputPartition):
    """The lines of a file that begin from ``begin`` on and before ``end``; ``first`` says that a line begins at ``begin``."""

    def __init__(self, path: str, begin: int, end: int, first: bool = True):
        self.path, self.begin, self.end, self.first = path, begin, end, first


def complete_end(path: str, begin: int, size: int) -> int:
    """The offset after the last newline from ``begin`` on: text without its newline yet is left for later."""
    with open(path, "rb") as f:
        at = size
        while at > begin:
            step = max(begin, at - 65536)
            f.seek(step)
            found = f.read(at - step).rfind(b"\n")
            if found >= 0:
                return step + found + 1
            at = step
    return begin


class TailReader(DataSourceStreamReader):
    """Offsets are {path: [inode, byte]}.  A changed inode or a shrunken file is a rotation: reading starts at 0.

    The driver only looks at sizes and last newlines; executors read the pieces: a long backlog of one file is cut at
    fixed places, and a piece begins with the first line that begins in it.
    """

    def __init__(self, options: dict):
        self.patterns = [p.strip() for p in options["paths"].split(",")]
        self.from_end = options.get("from", "end") == "end"
        self.piece = int(options.get("piece_bytes", PIECE))

    def files(self) -> list[str]:
        return sorted({p for pattern in self.patterns for p in glob.glob(pattern) if os.path.isfile(p)})

    def initialOffset(self) -> dict:  # noqa: N802
        out = {}
        for path in self.files():
            s = os.stat(path)
            out[path] = [s.st_ino, s.st_size if self.from_end else 0]
        return out

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for path in self.files():
            s = os.stat(path)
            out[path] = [s.st_ino, complete_end(path, 0, s.st_size)]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, (inode, to) in end.items():
            was, begin = start.get(path, [inode, 0])
            begin = begin if was == inode and begin <= to else 0
            out += [Piece(path, at, min(at + self.piece, to), at == begin) for at in range(begin, to, self.piece)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            at = partition.begin
            if not partition.first:  # a line that begins just here follows a line end
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                yield partition.path, at, line.rstrip(b"\n").decode("utf-8", "replace")
                at += len(line)
