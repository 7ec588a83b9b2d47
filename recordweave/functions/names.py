"""Names of objects and indexes that depend on an event's time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXTENSIONS = {"gzip": ".gz", "snappy": ".snappy", "lz4": ".lz4"}
#: Compressions of object sinks; lz4 is named but not available, as in the reference semantics.
AVAILABLE_COMPRESSION = ("none", "gzip", "snappy")


def writer_compression(name: str) -> str:
    """The Spark writer's option for a compression; ValueError for one that is not available."""
    if name not in AVAILABLE_COMPRESSION:
        raise ValueError(f"compression not available: {name}")
    return name


def object_key(time: Column, template: str = "{{.Timestamp}}.json", prefix: str = "", compression: str = "none") -> Column:
    """The object key of a batch from its first event's time."""
    parts = {
        "{{.Year}}": F.date_format(time, "yyyy"),
        "{{.Month}}": F.date_format(time, "MM"),
        "{{.Day}}": F.date_format(time, "dd"),
        "{{.Hour}}": F.date_format(time, "HH"),
        "{{.Minute}}": F.date_format(time, "mm"),
        "{{.Second}}": F.date_format(time, "ss"),
        "{{.Timestamp}}": F.unix_seconds(time).cast("string"),
        "{{.UnixNano}}": F.concat(F.unix_micros(time).cast("string"), F.lit("000")),
    }
    used = [(k, v) for k, v in parts.items() if k in template]
    key = reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), kv[1]), used, F.lit(template))
    return F.concat(F.lit(prefix), key, F.lit(_EXTENSIONS.get(compression, "")))


def index_name(index: str, rotation: str, time: Column) -> Column:
    """The index of an event: bare, with a dated suffix, or with its date marks replaced."""
    if rotation in ("", "none"):
        return F.lit(index)
    day, month, year = F.date_format(time, "yyyy.MM.dd"), F.date_format(time, "yyyy.MM"), F.date_format(time, "yyyy")
    if "%{" in index:
        marks = (("%{+YYYY.MM.dd}", day), ("%{+YYYY.MM}", month), ("%{+YYYY}", year))
        return reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), kv[1]), marks, F.lit(index))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), time).cast("string"), F.lit("."), F.lpad(F.weekofyear(time).cast("string"), 2, "0"))
    return F.concat(F.lit(index + "-"), {"weekly": week, "monthly": month, "yearly": year}.get(rotation, day))
