"""Selectors over labels and fields: ``app=web, tier!=cache, env in (a, b), region notin (x), owner, !old``."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9_./-]*[A-Za-z0-9])?"
_VALUE = r"(?:[A-Za-z0-9](?:[A-Za-z0-9_.-]*[A-Za-z0-9])?)?"
_TERM = re.compile(
    rf"\s*(?:(?P<not>!)\s*(?P<gone>{_NAME})|(?P<set>{_NAME})\s+(?P<how>in|notin)\s*\((?P<values>[^()]*)\)|(?P<key>{_NAME})\s*(?P<op>==|=|!=)\s*(?P<value>{_VALUE})|(?P<has>{_NAME}))\s*(?:,|\Z)"
)


class SelectorError(ValueError):
    """What is no selector."""


def terms(selector: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """(name, operator, values) of each requirement: in, notin, exists or absent."""
    out, at = [], 0
    while selector[at:].strip():
        m = _TERM.match(selector, at)
        if m is None:
            raise SelectorError(f"no selector: {selector!r} at {selector[at:]!r}")
        if m["gone"]:
            out.append((m["gone"], "absent", ()))
        elif m["set"]:
            values = tuple(v.strip() for v in m["values"].split(","))
            if not all(re.fullmatch(_VALUE, v) for v in values):
                raise SelectorError(f"no values: {m['values']!r}")
            out.append((m["set"], m["how"], values))
        elif m["key"]:
            out.append((m["key"], "notin" if m["op"] == "!=" else "in", (m["value"],)))
        else:
            out.append((m["has"], "exists", ()))
        at = m.end()
    if selector.rstrip().endswith(","):
        raise SelectorError(f"a requirement is missing: {selector!r}")
    return out


def _matches(selector: str, value: Callable[[str], Column]) -> Column:
    def one(name: str, operator: str, values: tuple[str, ...]) -> Column:
        v = value(name)
        if operator in ("exists", "absent"):
            return v.isNotNull() if operator == "exists" else v.isNull()
        held = F.coalesce(v.isin(*values), F.lit(False))
        return held if operator == "in" else ~held  # what isn't there is in no set

    return reduce(lambda a, b: a & b, [one(*t) for t in terms(selector)], F.lit(True))


def label_selector(labels: Column, selector: str) -> Column:
    """Whether a map of labels meets all requirements; an empty selector takes everything, null labels are none."""
    return _matches(selector, lambda name: F.try_element_at(labels, F.lit(name)))


def field_selector(selector: str, fields: dict[str, Column]) -> Column:
    """The same over named fields of a row, which only know =, == and !=; a field that isn't known is an error."""
    for name, operator, values in terms(selector):
        if name not in fields or operator not in ("in", "notin") or len(values) != 1:
            raise SelectorError(f"no field requirement: {name} {operator}")
    return _matches(selector, lambda name: F.coalesce(fields[name].cast("string"), F.lit("")))
