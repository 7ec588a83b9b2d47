"""Reshaping of the ``fields`` map: keep, drop, rename, add, key-value extraction, conversion, redaction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import capture, translate

Transform = Callable[[DataFrame], DataFrame]
# Words that make a field name sensitive, and what replaces the value.
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "credential", "auth", "authorization")
REDACTED = "***REDACTED***"
# End of the fixed values.


@dataclass(frozen=True)
class TransformSpec:
    kind: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)
    add: dict[str, str] = field(default_factory=dict)
    patterns: tuple[str, ...] = ()
    field_split: str = " "
    value_split: str = "="
    prefix: str = ""
    fields: tuple[str, ...] = ()


def _literal(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def trim_space(text: Column) -> Column:
    """Without white space at both ends (all of it, not only blanks)."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def keep_fields(fields: Column, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> Column:
    """Only the included names; without any, all but the excluded ones."""
    if include:
        return F.map_filter(fields, lambda k, v: k.isin(*include))
    return F.map_filter(fields, lambda k, v: ~k.isin(*exclude)) if exclude else fields


def rename_fields(fields: Column, names: dict[str, str]) -> Column:
    """Each old name in the given order: its value moves to the new name (over one that is there), the old one goes."""

    def one(m: Column, pair: tuple[str, str]) -> Column:
        old, new = pair
        moved = F.map_concat(F.map_filter(m, lambda k, v: k != old), F.create_map(F.lit(new), F.try_element_at(m, F.lit(old))))
        gone = F.map_filter(m, lambda k, v: k != old)
        return F.when(F.map_contains_key(m, old), gone if old == new else moved).otherwise(m)

    return reduce(one, names.items(), fields)


def add_fields(fields: Column, values: dict[str, str]) -> Column:
    return F.map_concat(fields, F.create_map(*[F.lit(x) for kv in values.items() for x in kv])) if values else fields


def key_values(message: Column, spec: TransformSpec) -> Column:
    """map of the pairs in a message: groups of the first matching pattern, else split pairs; the last duplicate wins."""
    first, rest = _literal(spec.field_split), _literal(spec.value_split)
    pairs = F.filter(F.transform(F.split(message, first, -1), lambda t: F.split(t, rest, 2)), lambda p: F.size(p) == 2)
    entries = F.transform(pairs, lambda p: F.struct(F.concat(F.lit(spec.prefix), trim_space(p[0])).alias("key"), trim_space(p[1]).alias("value")))
    found = F.map_from_entries(entries)
    if spec.patterns:
        groups = F.coalesce(*[capture(message, translate(p)) for p in spec.patterns])
        if spec.prefix:
            groups = F.transform_keys(groups, lambda k, v: F.concat(F.lit(spec.prefix), k))
        found = F.coalesce(groups, found)
    return F.when(message != "", found).otherwise(F.create_map().cast("map<string,string>"))


def redact_fields(fields: Column) -> Column:
    """Values of sensitive names are replaced."""
    return F.transform_values(fields, lambda k, v: F.when(is_sensitive(k), F.lit(REDACTED)).otherwise(v))


def is_sensitive(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SENSITIVE))


def sanitized(text: Column) -> Column:
    """Without NUL characters and surrounding white space."""
    return trim_space(F.translate(text, "\0", ""))


def typed_view(fields: Column, kinds: dict[str, str]) -> Column:
    """A struct of fields cast to types (extension; null where a value doesn't fit)."""
    return F.struct(*[F.try_element_at(fields, F.lit(n)).try_cast(t).alias(n) for n, t in kinds.items()])


_registered: dict[str, Callable[[TransformSpec], Transform]] = {}


def register_transform(name: str, make: Callable[[TransformSpec], Transform]) -> None:
    _registered[name] = make


def _column(spec: TransformSpec) -> Callable[[Column], Column]:
    """The map expression of a transform."""
    if spec.kind == "filter":
        return lambda m: keep_fields(m, spec.include, spec.exclude)
    if spec.kind == "rename":
        return lambda m: rename_fields(m, spec.rename)
    if spec.kind == "add":
        return lambda m: add_fields(m, spec.add)
    if spec.kind == "kv":
        return lambda m: F.map_concat(m, key_values(F.col("message"), spec))
    if spec.kind == "convert":
        return lambda m: m
    if spec.kind == "redact":
        return redact_fields
    raise ValueError(f"unknown transform: {spec.kind}")


def transform(events: DataFrame, *specs: TransformSpec) -> DataFrame:
    """Applies the transforms in order.  Built-in ones in a row become one map expression; an unknown kind raises."""
    run: list[Callable[[Column], Column]] = []

    def flush(df: DataFrame) -> DataFrame:
        if run:
            df = df.withColumn("fields", reduce(lambda m, f: f(m), run, F.coalesce("fields", F.create_map().cast("map<string,string>"))))
            run.clear()
        return df

    for spec in specs:
        if spec.kind in _registered:
            events = _registered[spec.kind](spec)(flush(events))
        else:
            run.append(_column(spec))
    return flush(events)
