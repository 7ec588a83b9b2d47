"""Configuration files: YAML with environment variables, defaults, checks, and the DataFrame plan they stand for."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.selectors import SelectorError
from ..operators.metrics import MetricRule, extract
from ..operators.multiline import MultilineSpec, assemble
from ..operators.parsers import DEFAULT, ParserSpec, merge_input, parse
from ..operators.transforms import TransformSpec, transform
from ..sources.inputs import InputError, configured, expanded
from ..sources.objects import write_batches
from ..sources.sinks import Output, deliver_bulk, router, text_output, topic_rows
from ..storage import materialised
from ..streaming.stateful import multiline_stream

#: Columns of the events that inputs give.
EVENTS = ("input", "timestamp", "message", "level", "source", "fields", "raw", "is_error")
#: Key of an object where none is configured.
DEFAULT_KEY = "{{.Year}}/{{.Month}}/{{.Day}}/{{.Hour}}-{{.Minute}}-{{.Second}}-{{.Timestamp}}.json"
LEVELS, FORMATS = ("debug", "info", "warn", "error", "fatal"), ("json", "console")


class ConfigError(ValueError):
    """What is wrong with a configuration."""


@dataclass
class Config:
    inputs: dict = field(default_factory=dict)
    parser: ParserSpec | None = None
    transforms: tuple[TransformSpec, ...] = ()
    logging: dict = field(default_factory=dict)
    outputs: dict = field(default_factory=dict)
    multiline: MultilineSpec | None = None
    metrics: tuple[MetricRule, ...] = ()
    raw: dict = field(default_factory=dict)


def parser_spec(options: dict) -> ParserSpec:
    names = {"type": "kind"}
    known = ParserSpec.__dataclass_fields__
    return ParserSpec(**{names.get(k, k): v for k, v in options.items() if names.get(k, k) in known})


def seconds(text: str | float) -> float:
    """A duration such as 5s, 1m30s, 250ms; a bare number is seconds."""
    if isinstance(text, int | float):
        return float(text)
    unit = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
    parts = re.findall(r"([0-9.]+)(ns|us|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ConfigError(f"no duration: {text!r}")
    return sum(float(n) * unit[u] for n, u in parts)


def multiline_spec(options: dict) -> MultilineSpec:
    given = {k: options[k] for k in ("pattern", "negate", "match", "max_lines") if k in options}
    return MultilineSpec(**given, **({"timeout_seconds": seconds(options["timeout"])} if "timeout" in options else {}))


def metric_rule(options: dict) -> MetricRule:
    given = {("kind" if k == "type" else k): v for k, v in options.items() if k in ("name", "type", "field", "pattern", "labels", "label_fields", "buckets")}
    return MetricRule(**given | ({"buckets": tuple(map(float, given["buckets"]))} if given.get("buckets") else {}))


def output(definition: dict) -> Output:
    """A function that writes a batch of events as an output definition says.

    file: a folder a batch.  s3: an object for each batch of events, under the first one's key.  kafka: rows for the broker.
    elasticsearch: bulk requests with ids, refused items go to dead letters where a folder is given.  stdout: Spark's
    console.  Files, objects and documents of a repeated batch replace themselves.
    """
    kind, options = definition.get("type", "stdout"), dict(definition.get(definition.get("type", ""), {}) or {})
    if kind == "stdout":
        return lambda df, batch: df.write.format("console").option("truncate", "false").save()
    if kind == "file":
        return text_output(definition["path"])
    if kind == "s3":
        root, size = options.get("path") or f"{options.get('scheme', 's3')}://{options['bucket']}", int(options.get("batch_size") or 1000)
        prefix = options["prefix"].strip("/") + "/" if options.get("prefix") else ""
        template, compression = options.get("key_template") or DEFAULT_KEY, options.get("compression") or "none"

        def put(df: DataFrame, batch: int) -> None:
            # Batches are runs of a partition's rows, in their order; a repeated micro-batch deals them alike.
            placed = df.withColumn("__seq", F.monotonically_increasing_id())
            placed = materialised(placed.withColumn("__batch", F.shiftright("__seq", 33) * (1 << 33) + F.floor(F.col("__seq").bitwiseAND((1 << 33) - 1) / size)))
            write_batches(placed, root, f"batch-{batch}", template, prefix, compression, "__batch", "__seq")

        return put
    if kind == "kafka":
        given = {"kafka.bootstrap.servers": ",".join(options["brokers"])} | ({"kafka.compression.type": options["compression_codec"]} if options.get("compression_codec") else {})
        rows = lambda df: topic_rows(df, options["topic"], options.get("topic_field", ""), options.get("partition_key", ""), options.get("partition_strategy") or "hash", int(options.get("partitions", 0)), options.get("partition_field", ""))
        return lambda df, batch: rows(df).write.format("kafka").options(**given).save()
    if kind == "elasticsearch":

        def send(df: DataFrame, batch: int) -> None:
            identity = tuple(options.get("identity") or [c for c in ("input", "source", "timestamp", "raw") if c in df.columns])
            letters, tries = definition.get("dead_letters") or options.get("dead_letters", ""), int(options.get("max_retries") or 3)
            deliver_bulk(df, str(batch), options["addresses"], options["index"], options.get("index_rotation", "daily"), options.get("pipeline", ""), int(options.get("batch_size") or 1000), identity, letters, tries)

        return send
    raise ConfigError(f"unknown output type: {kind}")


def outputs(config: Config) -> Output:
    """One function for all outputs of the configuration, with its failure policy."""
    if config.outputs.get("type") != "multi":
        return output(config.outputs)
    multi = config.outputs.get("multi") or {}
    named = {d.get("name") or d["type"]: output(d) for d in multi.get("outputs") or ()}
    if not named:
        raise ConfigError("a multi output needs outputs")
    return router(named, bool(multi.get("parallel", False)), "stop" if multi.get("failure_strategy") in ("stop", "fail", "fail-fast") else "continue")


def transform_spec(options: dict) -> TransformSpec:
    names = {"type": "kind", "include_fields": "include", "exclude_fields": "exclude"}
    out = {}
    for k, v in options.items():
        k = names.get(k, k)
        if k in TransformSpec.__dataclass_fields__:
            out[k] = tuple(v) if isinstance(v, list) else v
    return TransformSpec(**out)


def loads(text: str) -> Config:
    """Expands $NAME and ${NAME} in the text (unset ones are empty), reads it, fills defaults and checks it."""
    import yaml

    raw = yaml.safe_load(expanded(text, dict(os.environ))) or {}
    config = Config(raw.get("inputs") or {}, None, (), {"level": "info", "format": "json"} | (raw.get("logging") or {}), raw.get("output") or raw.get("outputs") or {}, None, (), raw)
    if not config.inputs:
        raise ConfigError("at least one input is needed")
    try:
        for one in configured(config.inputs):
            for section in ("parser", "transforms"):
                if one.options.get(section):
                    (parser_spec if section == "parser" else lambda given: list(map(transform_spec, given)))(one.options[section])
    except (InputError, SelectorError) as e:
        raise ConfigError(str(e)) from e
    if config.logging["level"] not in LEVELS or config.logging["format"] not in FORMATS:
        raise ConfigError(f"logging: {config.logging}")
    if raw.get("parser"):
        config.parser = parser_spec(raw["parser"])
        if raw["parser"].get("multiline"):
            config.multiline = multiline_spec(raw["parser"]["multiline"])
    extraction = (raw.get("metrics") or {}).get("extraction") or {}
    if extraction.get("enabled", bool(extraction)):
        config.metrics = tuple(map(metric_rule, extraction.get("rules") or ()))
    config.transforms = tuple(map(transform_spec, raw.get("transforms") or ()))
    return config


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return loads(f.read())


def load_or_default(path: str) -> Config:
    """The file's configuration; the default one if it can't be read."""
    try:
        return load(path)
    except (OSError, ValueError):
        return Config(inputs={"files": [{"paths": ["/var/log/*.log"]}]}, parser=DEFAULT, logging={"level": "info", "format": "json"})


def pruned(parser: ParserSpec, transforms: tuple[TransformSpec, ...]) -> ParserSpec:
    """The parser with the first filter pushed into it: groups that it drops anyway are never extracted.

    Only a filter before which nothing else looks at fields moves; it also stays where it is, where it costs little.
    """
    first = transforms[0] if transforms else None
    if first is None or first.kind != "filter" or parser.keep or parser.drop:
        return parser
    return ParserSpec(**{**parser.__dict__, "keep": first.include} if first.include else {**parser.__dict__, "drop": first.exclude})


def plan(lines: DataFrame, config: Config) -> DataFrame:
    """Parsed and transformed events of (line, ts, source); with multi-line records, lines also have ``seq``, their order."""
    parser = config.parser or DEFAULT
    if config.multiline:
        lines = assemble(lines, config.multiline)
    return transform(parse(lines, pruned(parser, config.transforms)), *config.transforms)


def read(spark: SparkSession, config: Config, stream: bool = False) -> DataFrame:
    """Events (input, timestamp, message, level, source, fields, raw, is_error) of all inputs of the configuration, in one plan.

    Each input is read as a batch or a stream, parsed and transformed by its own section where it has one, else by the
    configuration's; fields that the input makes lie over the parsed ones.  Multi-line records of a stream are assembled
    with state, of a batch in blocks.
    """
    out = []
    for one in configured(config.inputs):
        options = one.options.get("parser") or config.raw.get("parser") or {}
        parser = parser_spec(options) if options else DEFAULT
        transforms = tuple(map(transform_spec, one.options["transforms"])) if one.options.get("transforms") is not None else config.transforms
        lines = one.stream(spark) if stream else one.batch(spark)
        fields = F.col("input_fields")
        if options.get("multiline"):
            # a record has one source and no fields of single lines
            spec = multiline_spec(options["multiline"])
            lines = multiline_stream(lines, spec).withColumn("ts", F.current_timestamp()) if stream else assemble(lines, spec)
            lines, fields = lines.withColumn("input", F.lit(one.name)), F.lit(None).cast("map<string,string>")
        parsed = parse(lines.withColumn("input_fields", fields), pruned(parser, transforms))
        parsed = parsed.withColumn("source", F.lit(one.name)) if getattr(one, "names_source", False) else parsed
        out.append(transform(merge_input(parsed), *transforms).select(*EVENTS))
    return reduce(DataFrame.unionByName, out)


def metrics(events: DataFrame, config: Config) -> DataFrame | None:
    """The long metric table of the configuration's rules; None without rules."""
    return extract(events, list(config.metrics)) if config.metrics else None
