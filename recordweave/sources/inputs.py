"""Inputs of a configuration: each kind gives a batch frame and a stream frame of the same canonical lines.

A kind is a class with ``batch`` and ``stream``; ``register_input`` adds one.  Files are read where they lie.  Inputs
that receive over the network (syslog, http, kubernetes) read the landing table that their receiver or collector fills:
a catalog table or view (option ``table``), or a folder of Parquet files (option ``landing``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import ClassVar, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inputs as network
from .tail import TailSource

#: The columns of every input: its name and kind, where a line comes from, its place there, time, text and input fields.
LINES = "input string, kind string, source string, seq long, ts timestamp, line string, input_fields map<string,string>"
_NAMES = ("input", "kind", "source", "seq", "ts", "line", "input_fields")


class Input(Protocol):
    """What a configured input is to a plan."""

    name: str
    kind: str

    def batch(self, spark: SparkSession) -> DataFrame: ...

    def stream(self, spark: SparkSession) -> DataFrame: ...


class InputError(ValueError):
    """What is wrong with an input's options."""


def _lines(rows: DataFrame, name: str, kind: str, source: Column, seq: Column, ts: Column, line: Column, fields: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("map<string,string>")
    return rows.select(
        F.lit(name).alias("input"), F.lit(kind).alias("kind"), source.cast("string").alias("source"), seq.cast("long").alias("seq"), ts.cast("timestamp").alias("ts"), line.cast("string").alias("line"),
        (none if fields is None else fields).alias("input_fields"),
    )


@dataclass(frozen=True)
class Files:
    """Text files by paths and globs.  A batch reads what is there; a stream tails: new complete lines, by offset.

    seq is a line's place: its offset in a stream, a number that grows along a file in a batch.
    """

    name: str
    options: dict = field(default_factory=dict)
    kind: str = "files"

    def __post_init__(self):
        if not self.options.get("paths"):
            raise InputError("a file input needs paths")

    def batch(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.text(list(self.options["paths"])).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"))
        return _lines(rows, self.name, self.kind, F.col("path"), F.monotonically_increasing_id(), F.col("at"), F.col("value"))

    def stream(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(TailSource)
        rows = spark.readStream.format("tail").option("paths", ",".join(self.options["paths"])).option("from", self.options.get("from", "end")).load()
        return _lines(rows, self.name, self.kind, F.col("source"), F.col("offset"), F.current_timestamp(), F.col("line"))


@dataclass(frozen=True)
class Landing:
    """Rows that a receiver landed.  Subclasses make lines of them; the source of their events is the input's name."""

    names_source: ClassVar[bool] = True
    name: str
    options: dict = field(default_factory=dict)
    kind: str = ""

    def __post_init__(self):
        if not self.name or not (self.options.get("address") or self.kind == "kubernetes"):
            raise InputError(f"a {self.kind} input needs name and address")

    def _place(self) -> tuple[str, str]:
        for option in ("table", "landing"):
            if self.options.get(option):
                return option, self.options[option]
        raise InputError(f"the {self.kind} input {self.name} has no landing table")

    def batch(self, spark: SparkSession) -> DataFrame:
        option, place = self._place()
        return self.made(spark.table(place) if option == "table" else spark.read.parquet(place))

    def stream(self, spark: SparkSession) -> DataFrame:
        option, place = self._place()
        if option == "table":
            return self.made(spark.readStream.table(place))
        return self.made(spark.readStream.schema(spark.read.parquet(place).schema).parquet(place))

    def made(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _order(self, rows: DataFrame) -> tuple[Column, Column]:
        has = rows.columns
        return F.col("seq") if "seq" in has else F.lit(None), F.col("ts") if "ts" in has else F.current_timestamp()


@dataclass(frozen=True)
class Syslog(Landing):
    """Landed messages (message, source_ip, perhaps seq and ts)."""

    kind: str = "syslog"

    def made(self, rows: DataFrame) -> DataFrame:
        e = network.syslog_events(rows, str(self.options.get("format", "3164")))
        return _lines(e, self.name, self.kind, F.col("source_ip"), *self._order(rows), F.col("message"), F.col("fields"))


@dataclass(frozen=True)
class Http(Landing):
    """Landed requests (method, path, body, remote_addr, user_agent, api_key, authorization, perhaps seq and ts).

    Requests to ``batch_path`` hold an array of events, others one; requests without a key are left out where keys are set.
    """

    kind: str = "http"

    def made(self, rows: DataFrame) -> DataFrame:
        keys, most = tuple(self.options.get("api_keys") or ()), int(self.options.get("max_body_size") or 10 << 20)
        ok = network.authenticated(rows, keys).where(~F.col("path").isin(*network.EXEMPT_PATHS))
        many = F.col("path") == self.options.get("batch_path", "/logs/batch")
        seq, ts = self._order(rows)
        one = network.http_events(ok.where(~many), most)
        each = network.http_batch_events(ok.where(many), most)
        made = lambda e: _lines(e, self.name, self.kind, F.col("remote_addr"), seq, ts, F.col("message"), F.col("fields"))
        return made(one).unionByName(made(each))


@dataclass(frozen=True)
class Pods(Landing):
    """Landed pod log lines (namespace, pod, container, phase, labels, annotations, message, perhaps seq, ts, restart, node).

    ``tail_lines`` counts from the end of a table, so a stream has none.
    """

    kind: str = "kubernetes"

    def made(self, rows: DataFrame) -> DataFrame:
        o = self.options
        tail = 0 if rows.isStreaming else int(o.get("tail_lines") or 0)
        if rows.isStreaming and "restart" in rows.columns:
            rows = rows.drop("restart")  # every run's lines arrive while it runs
        if tail and "seq" not in rows.columns:
            raise InputError("tail_lines needs a column seq")
        e = network.select_pods(rows, o.get("namespace", ""), o.get("label_selector", ""), o.get("field_selector", ""), o.get("container_pattern", ""), bool(o.get("include_previous", False)) and "restart" in rows.columns, tail)
        e = network.pod_events(e, "", bool(o.get("enrich_metadata", False)))
        place = F.concat_ws("/", "namespace", "pod", "container")
        return _lines(e, self.name, self.kind, place, *self._order(rows), F.col("message"), F.col("fields"))


_KINDS: dict[str, Callable[[str, dict], Input]] = {"files": Files, "syslog": Syslog, "http": Http, "kubernetes": Pods}


def register_input(kind: str, make: Callable[[str, dict], Input]) -> None:
    """Adds a kind of input: ``make`` gets its name and options."""
    _KINDS[kind] = make


def configured(inputs: dict) -> list[Input]:
    """The inputs of a configuration's section, in its order; names are made where none is given."""
    out = []
    for kind, given in inputs.items():
        if kind not in _KINDS:
            raise InputError(f"unknown input: {kind}")
        for i, options in enumerate(given if isinstance(given, list) else [given]):
            options = options or {}
            made = "" if kind in ("syslog", "http") else f"{kind}-{i}"
            out.append(_KINDS[kind](options.get("name") or made, options))
    names = [x.name for x in out]
    if len(set(names)) < len(names):
        raise InputError(f"names of inputs are used twice: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return out


_VARIABLE = re.compile(r"\$(?:\{(?P<braced>[^}]*)\}|(?P<plain>[A-Za-z_][A-Za-z0-9_]*|[0-9*#$@!?-])|(?P<broken>\{))")


def expanded(text: str, variables: dict[str, str]) -> str:
    """``text`` with $NAME and ${NAME} replaced; a variable that isn't set is empty, a lone $ stays."""
    return _VARIABLE.sub(lambda m: variables.get(m["braced"] or m["plain"] or "", ""), text)
