"""Line parsers: regular expression, JSON and grok lines become event rows.

Each parser is one projection: text and ingest-time columns in, a struct (timestamp, message, level, fields, is_error)
out.  An empty line is an error.  A line that doesn't match becomes its own message, without custom fields.  On success
the fields are what is left after time, level and message were taken, plus the custom fields, which win.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grok import TEMPLATES, compile_grok
from ..functions.regexes import Pattern, capture, translate
from ..functions.times import ZERO_TIME, infer_time, parse_layout
from ..functions.values import value_texts

# Spellings of levels, and the keys that are tried when none is configured.
LEVELS: dict[str, tuple[str, ...]] = {
    "debug": ("DEBUG", "debug", "TRACE", "trace"),
    "info": ("INFO", "info", "information", "INFORMATION"),
    "warn": ("WARN", "warn", "WARNING", "warning"),
    "error": ("ERROR", "error", "ERR", "err"),
    "fatal": ("FATAL", "fatal", "CRITICAL", "critical", "PANIC", "panic"),
}
LEVEL_KEYS = ("level", "severity", "loglevel", "log_level")
MESSAGE_KEYS = ("msg", "message", "text", "log")
DEFAULT_PATTERN = r"^(?P<timestamp>\S+)\s+(?P<level>\S+)\s+(?P<message>.*)$"
# End of the fixed values.


@dataclass(frozen=True)
class ParserSpec:
    """What to parse and how; ``keep``/``drop`` are field names that a later transform keeps or drops anyway."""

    kind: str
    pattern: str = ""
    grok_pattern: str = ""
    time_field: str = ""
    time_format: str = ""
    level_field: str = ""
    message_field: str = ""
    custom_fields: dict[str, str] = field(default_factory=dict)
    custom_patterns: dict[str, str] = field(default_factory=dict)
    keep: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"grok({self.grok_pattern or self.pattern})" if self.kind == "grok" else self.kind


DEFAULT = ParserSpec("regex", pattern=DEFAULT_PATTERN, time_field="timestamp", time_format="2006-01-02T15:04:05Z07:00", level_field="level", message_field="message")
#: Adds event columns to rows with ``__line`` and ``__now``.
Parser = Callable[[DataFrame, ParserSpec], DataFrame]
_registered: dict[str, Parser] = {}
EVENT_COLUMNS = ("timestamp", "message", "level", "fields", "is_error")


def register_parser(name: str, parser: Parser) -> None:
    """Adds a parser kind: a function that gives rows with ``__line`` and ``__now`` the columns EVENT_COLUMNS."""
    _registered[name] = parser


def normal_level(level: Column) -> Column:
    """The normal form of a level; unknown spellings stay."""
    table = F.create_map(*[F.lit(x) for normal, forms in LEVELS.items() for form in forms for x in (form, normal)])
    return F.coalesce(F.try_element_at(table, level), level)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a costly column that is computed once a row, whatever later steps do with it.

    The optimiser copies a projection's expressions into filters that it pushes below (and into what an explode
    implies); it doesn't copy a generator's.  Filters on other columns still reach the scan.
    """
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def explode_fields(events: DataFrame, *columns: str) -> DataFrame:
    """(columns, key, value): a row for each field of each event.  The null row of an event without fields is dropped
    after the explode, so no filter on the fields' size makes the plan compute them twice."""
    return events.select(*columns, F.explode_outer("fields").alias("key", "value")).where("key is not null")


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]).cast("map<string,string>") if values else F.create_map().cast("map<string,string>")


def _with_event(rows: DataFrame, ok: Column, timestamp: Column, message: Column, level: Column, fields: Column) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    line, now = F.col("__line"), F.col("__now")
    return rows.withColumns(
        {
            "timestamp": F.when(ok, timestamp).otherwise(now),
            "message": F.when(ok, message).otherwise(line),
            "level": F.when(ok, level).otherwise(""),
            "fields": F.when(ok, fields).otherwise(none),
            "is_error": line == "",
        }
    )


def _from_groups(rows: DataFrame, spec: ParserSpec, pattern: Pattern, time: str, level: str, message: str, absent_message: Column) -> DataFrame:
    line, now = F.col("__line"), F.col("__now")
    special = {x for x in (time, level, message) if x}
    wanted = tuple(n for n in pattern.names if n in special or ((not spec.keep or n in spec.keep) and n not in spec.drop))
    rows = once(rows, "__groups", capture(line, pattern, wanted))
    groups = F.col("__groups")
    get = lambda name: F.try_element_at(groups, F.lit(name)) if name in pattern.names else F.lit(None).cast("string")
    rows = rows.withColumn("__time", (parse_layout(get(time), spec.time_format) if spec.time_format else infer_time(get(time))) if time else F.lit(None).cast("timestamp"))
    gone = F.array(*[F.lit(x) for x in (level, message) if x]).cast("array<string>")
    left = F.map_filter(groups, lambda k, v: ~F.array_contains(gone, k) & (F.lit(True) if not time else (k != time) | F.col("__time").isNull()))
    fields = F.map_concat(left, _literal_map(spec.custom_fields)) if spec.custom_fields else left
    return _with_event(
        rows, (line != "") & groups.isNotNull(), F.coalesce("__time", now), F.coalesce(get(message), absent_message) if message else line,
        F.coalesce(normal_level(get(level)), F.lit("")) if level else F.lit(""), fields,
    ).drop("__groups", "__time")


def _regex(rows: DataFrame, spec: ParserSpec) -> DataFrame:
    return _from_groups(rows, spec, translate(spec.pattern), spec.time_field, spec.level_field, spec.message_field, F.lit(""))


def _grok(rows: DataFrame, spec: ParserSpec) -> DataFrame:
    """Like the regular expression, but time, level and message have default names, and without a message the line stays."""
    if not (spec.grok_pattern or spec.pattern):
        raise ValueError("a grok parser needs grok_pattern or pattern")
    if spec.grok_pattern and spec.grok_pattern not in TEMPLATES:
        raise KeyError(f"unknown grok template: {spec.grok_pattern}")
    pattern = compile_grok(spec.grok_pattern or spec.pattern, spec.custom_patterns)
    return _from_groups(rows, spec, pattern, spec.time_field or "timestamp", spec.level_field or "level", spec.message_field or "message", F.col("__line"))


def _json(rows: DataFrame, spec: ParserSpec) -> DataFrame:
    """JSON objects; other lines fall back to themselves.  Values become text as in functions.values."""
    line, now, values, nothing = F.col("__line"), F.col("__now"), F.col("__values"), F.lit(None).cast("string")
    level_keys = (spec.level_field,) if spec.level_field else LEVEL_KEYS
    looked = list(dict.fromkeys([*level_keys, *MESSAGE_KEYS, *(x for x in (spec.message_field, spec.time_field) if x)]))
    name = {k: f"__s{i}" for i, k in enumerate(looked)}
    element = lambda k: F.try_element_at(values, F.lit(k))
    rows = once(rows, "__values", F.from_json(line, "map<string,variant>"))
    rows = rows.withColumns({name[k]: F.when(F.schema_of_variant(element(k)) == "STRING", element(k).cast("string")) for k in looked})
    string = lambda k: F.col(name[k])
    first_key = lambda keys, get: F.coalesce(*[F.when(get(k).isNotNull(), F.lit(k)) for k in keys])
    filled = lambda k: F.nullif(string(k), F.lit(""))
    own = spec.message_field
    time = string(spec.time_field) if spec.time_field else nothing
    rows = rows.withColumn("__time", parse_layout(time, spec.time_format) if spec.time_format else infer_time(time))
    probed_key = first_key(MESSAGE_KEYS, filled)
    taken = F.array(
        first_key(level_keys, string),
        F.when(string(own).isNotNull(), F.lit(own)) if own else nothing,
        F.when(filled(own).isNull(), probed_key) if own else probed_key,
        F.when(F.col("__time").isNotNull(), F.lit(spec.time_field)) if spec.time_field else nothing,
    )
    wanted = lambda k: (k.isin(*spec.keep) if spec.keep else F.lit(True)) & (~k.isin(*spec.drop) if spec.drop else F.lit(True))
    # Bound by a transform: a plain column would be copied into the lambda and computed for every key.
    rows = rows.withColumn("__left", F.get(F.transform(F.array(F.array_compact(taken)), lambda t: F.map_filter(values, lambda k, v: ~F.array_contains(t, k) & wanted(k))), 0))
    fields = value_texts("__left")
    fields = F.map_concat(fields, _literal_map(spec.custom_fields)) if spec.custom_fields else fields
    message = F.coalesce(*([filled(own)] if own else []), *[filled(k) for k in MESSAGE_KEYS], line)
    timestamp = F.when(time.isNull(), now).otherwise(F.coalesce("__time", F.lit(ZERO_TIME).cast("timestamp")))
    level = F.coalesce(normal_level(F.coalesce(*[string(k) for k in level_keys])), F.lit(""))
    out = _with_event(rows, (line != "") & values.isNotNull(), timestamp, message, level, fields)
    return out.drop("__values", "__time", "__left", *name.values())


_KINDS: dict[str, Parser] = {"regex": _regex, "json": _json, "grok": _grok}


def parse(lines: DataFrame, spec: ParserSpec = DEFAULT, line: str = "line", now: str = "ts", source: str = "source") -> DataFrame:
    """``lines`` with event columns timestamp, message, level, fields, raw and is_error; other columns stay.

    An error row keeps its line as message.  Null lines are errors with an empty message.
    """
    parser = _registered.get(spec.kind) or _KINDS.get(spec.kind)
    if parser is None:
        raise ValueError(f"unknown parser: {spec.kind}")
    text = F.coalesce(F.col(line), F.lit(""))
    kept = [c for c in lines.columns if c not in (*EVENT_COLUMNS, "raw")]
    rows = lines.select(*kept, text.alias("__line"), F.col(now).alias("__now"))
    return parser(rows, spec).select(*kept, *EVENT_COLUMNS, F.col("__line").alias("raw"))


def parser_stats(parsed: DataFrame) -> DataFrame:
    """(parsed, failed): rows that became events, and rows in error."""
    return parsed.agg(F.count_if(~F.col("is_error")).alias("parsed"), F.count_if("is_error").alias("failed"))


def merge_input(parsed: DataFrame, input_fields: str = "input_fields") -> DataFrame:
    """Network inputs: the fields that the input made are laid over the parsed ones."""
    none = F.create_map().cast("map<string,string>")
    return parsed.withColumn("fields", F.map_concat("fields", F.coalesce(input_fields, none)))


def event_json(event: DataFrame) -> Column:
    """One JSON line per event: keys timestamp, message, level, source, fields, raw; empty ones are left out, field names sorted."""
    has = event.columns
    ordered = F.map_from_entries(F.array_sort(F.map_entries("fields")))
    fields = F.when(F.size("fields") > 0, ordered)
    stamp = F.concat(F.regexp_replace(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))
    optional = lambda c: F.nullif(F.col(c), F.lit("")) if c in has else F.lit(None).cast("string")
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in has else F.lit("")
    return F.to_json(F.struct(stamp.alias("timestamp"), F.col("message"), optional("level").alias("level"), source.alias("source"), fields.alias("fields"), optional("raw").alias("raw")))
