"""Timestamps: inference over common layouts, and reference-time layouts as Java patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a JSON event's unreadable time becomes.
ZERO_TIME = "0001-01-01 00:00:00"

# Elements of a reference-time layout and the Java letters for them; longer elements first.
_ELEMENTS = {
    "2006": "yyyy", "January": "MMMM", "Jan": "MMM", "Monday": "EEEE", "Mon": "EEE", "MST": "z", "Z07:00": "XXX", "-07:00": "xxx", "Z0700": "XX", "-0700": "xx", "-07": "x",
    "01": "MM", "02": "dd", "03": "hh", "04": "mm", "05": "ss", "06": "yy", "15": "HH", "PM": "a",
}
#: The layouts that inference tries, in order.
LAYOUTS = (
    "2006-01-02T15:04:05Z07:00",
    "2006-01-02 15:04:05",
    "2006/01/02 15:04:05",
    "Jan 02 15:04:05",
    "Jan 02, 2006 15:04:05",
    "02/Jan/2006:15:04:05 -0700",
)
# End of the fixed values.

_ELEMENT = re.compile("|".join(map(re.escape, sorted(_ELEMENTS, key=len, reverse=True))) + r"|[.,](?:0+|9+)|[A-Za-z]+|'")


_ISO_LAYOUT = LAYOUTS[0]
_ISO = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})\z"


def java_layout(layout: str) -> str:
    """A reference-time layout in Java letters.  A fraction after the seconds is read whether or not the layout has it."""

    def one(m: re.Match) -> str:
        text = m[0]
        if text in _ELEMENTS:
            return _ELEMENTS[text]
        if text[0] in ".,":
            return ""
        return "''" if text == "'" else f"'{text}'"

    out = _ELEMENT.sub(one, layout)
    return out.replace("ss", "ss[.SSSSSSSSS][.SSSSSS][.SSS][,SSS]", 1)


def parse_layout(text: Column, layout: str) -> Column:
    """Timestamp by one layout, null where it doesn't fit.  Fractions beyond microseconds are cut."""
    if layout == _ISO_LAYOUT:  # what Spark's own cast reads, far faster than a formatter
        return F.when(text.rlike(_ISO), F.translate(text, ",", ".").try_cast("timestamp"))
    java = java_layout(layout)
    if "yyyy" not in java and "yy" not in java:  # the year is 0 then; such times only have their other parts
        return F.try_to_timestamp(F.concat(F.lit("0000 "), text), F.lit("yyyy " + java))
    return F.try_to_timestamp(_micros(text), F.lit(java.replace("[.SSSSSSSSS][.SSSSSS][.SSS][,SSS]", "[.SSSSSS]")))


def _micros(text: Column) -> Column:
    """Fractions of any length, after dot or comma, as six digits."""
    padded = F.regexp_replace(text, r"(:\d{2})[.,](\d{1,9})", "$1.$2000000")
    return F.when(text.rlike("[.,]"), F.regexp_replace(padded, r"(:\d{2}\.\d{6})\d+", "$1")).otherwise(text)


def infer_time(text: Column) -> Column:
    """The first layout that fits; null for none."""
    return F.coalesce(*[parse_layout(text, x) for x in LAYOUTS])
