"""The registered queries of the library's own operators, each with the SQL that it is compared with."""

from __future__ import annotations

from . import delivery, inputs, metrics, parsing, reshaping
from .common import QUERIES

__all__ = ["QUERIES", "delivery", "inputs", "metrics", "oracle_sql", "parsing", "queries", "reshaping"]


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
