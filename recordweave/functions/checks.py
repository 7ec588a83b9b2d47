"""Validation of addresses, paths and names; backoff, sizes and ratios."""

from __future__ import annotations

import os
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def valid_ip(text: Column) -> Column:
    """Dotted quad of numbers up to 255; leading zeros are fine."""
    return text.rlike(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z") & text.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")


def valid_host_port(text: Column) -> Column:
    """One colon, and after it a number from 1 to 65535 (what follows the leading digits doesn't matter)."""
    parts = F.split(text, ":", -1)
    port = F.regexp_extract(F.get(parts, F.lit(1)), r"\A\s*([+-]?[0-9]{1,9})", 1).try_cast("int")
    return (F.size(parts) == 2) & F.coalesce(port.between(1, 65535), F.lit(False))


def valid_path(text: Column) -> Column:
    return ~text.contains("..") & ~text.contains("\0")


def valid_field_name(text: Column) -> Column:
    return text.rlike(r"\A[a-zA-Z0-9_\-.]+\z")


def secret(value: str) -> str:
    """env:NAME, file:PATH (trimmed), else the value itself; KeyError for an unset variable."""
    if value.startswith("env:"):
        return os.environ[value[4:]]
    if value.startswith("file:"):
        with open(value[5:], encoding="utf-8") as f:
            return f.read().strip()
    return value


def exponential_backoff(attempt: Column, initial: float, factor: float, most: float) -> Column:
    return F.least(F.lit(initial) * F.pow(F.lit(factor), attempt), F.lit(most))


def linear_backoff(attempt: Column, step: float, most: float) -> Column:
    return F.least(attempt * F.lit(step), F.lit(most))


def constant_backoff(attempt: Column, wait: float) -> Column:
    return F.lit(float(wait)) + attempt * 0


def jittered(wait: float, draw: random.Random) -> float:
    """The wait, up to 10 % shorter or longer."""
    return wait + wait * 0.2 * (draw.random() - 0.5)


def next_power_of_two(n: Column, default: int = 1024) -> Column:
    """The smallest power of two that is not below n; the default for 0 and less."""
    bits = F.length(F.bin(n.cast("long") - 1))
    return F.when(n <= 0, F.lit(default)).when(n == 1, F.lit(1)).otherwise(F.pow(F.lit(2), bits)).cast("long")


def percentage(part: Column, total: Column, empty: float = 0.0) -> Column:
    return F.when(total == 0, F.lit(empty)).otherwise(part * 100.0 / total)


def success_rate(good: Column, total: Column) -> Column:
    return percentage(good, total, 100.0)
