"""JSON values and numbers as text, the way that event fields hold them, and strict number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal, infinite and not-a-number forms; no surrounding blanks, no type suffix.
_NUMBER = r"\A[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\z"
#: Hexadecimal forms need their binary exponent; digits may stand on either side of the point.
_HEX = r"\A([+-]?)0[xX](?=\.?[0-9a-fA-F])([0-9a-fA-F]*)(?:\.([0-9a-fA-F]*))?[pP]([+-]?[0-9]+)\z"


def _hex_float(text: Column) -> Column:
    """A hexadecimal number: fifteen significant digits (a double holds fourteen at most) times a power of two."""
    part = lambda i: F.regexp_extract(text, _HEX, i)
    read = F.struct(part(1).alias("sign"), F.ltrim(F.concat(part(2), part(3)), F.lit("0")).alias("digits"), (part(4).cast("double") - 4 * F.length(part(3))).alias("power"))

    def value(x: Column) -> Column:
        lead = F.rpad(F.substring(x["digits"], 1, 15), 15, "0")
        power = x["power"] + 4 * (F.length(x["digits"]) - 15)
        half = F.floor(power / 2)  # two steps: neither overflows where the result doesn't
        size = F.conv(lead, 16, 10).cast("double") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)
        return F.when(x["sign"] == "-", -size).otherwise(size)

    return F.get(F.transform(F.array(read), value), 0)


def parse_float(text: Column) -> Column:
    """Double, or null where the text is no number; stricter than a cast (blanks and suffixes are refused)."""
    plain = F.when(text.rlike(_NUMBER), F.regexp_replace(text, r"(?i)\A([+-]?)inf(?:inity)?\z", "$1Infinity").try_cast("double"))
    return F.when(text.rlike(_HEX), _hex_float(text)).otherwise(plain)


def _number_sql(double: str, n: int = 0) -> str:
    """SQL of ``number_text``.  Values that are looked at more than once are bound by one-element transforms."""
    p, q, r = f"p{n}", f"q{n}", f"r{n}"
    part = "regexp_extract({}, r'^-?(\\d+)\\.(\\d+)(?:E(-?\\d+))?$', {})".format
    first = f"named_struct('s', {p}, 'l', length({part(p, 1)}), 'w', concat({part(p, 1)}, {part(p, 2)}), 'e', coalesce(try_cast({part(p, 3)} AS int), 0))"
    bare = f"ltrim('0', {q}.w)"
    second = f"named_struct('s', {q}.s, 'd', rtrim('0', {bare}), 'p', {q}.l + {q}.e - length({q}.w) + length({bare}))"
    s, d, at = f"{r}.s", f"{r}.d", f"{r}.p"
    exponent = f"concat(substring({d}, 1, 1), IF(length({d}) > 1, concat('.', substring({d}, 2)), ''), IF({at} < 1, 'e-', 'e+'), IF(abs({at} - 1) < 10, '0', ''), string(abs({at} - 1)))"
    plain = f"CASE WHEN {at} <= 0 THEN concat('0.', repeat('0', -{at}), {d}) WHEN length({d}) <= {at} THEN concat({d}, repeat('0', {at} - length({d}))) ELSE concat(substring({d}, 1, {at}), '.', substring({d}, {at} + 1)) END"
    sign = f"IF(startswith({s}, '-'), '-', '')"
    third = f"CASE WHEN {s} = 'NaN' THEN 'NaN' WHEN {s} = 'Infinity' THEN '+Inf' WHEN {s} = '-Infinity' THEN '-Inf' WHEN {d} = '' THEN concat({sign}, '0') WHEN {at} < -3 OR {at} > 6 THEN concat({sign}, {exponent}) ELSE concat({sign}, {plain}) END"
    return f"transform(transform(transform(array(string({double})), {p} -> {first}), {q} -> {second}), {r} -> {third})[0]"


def number_text(column: str) -> Column:
    """Shortest text of a double column: an exponent (two digits at least) below 1e-04 and from 1e+06 on, no trailing zeros."""
    return F.expr(f"IF({column} IS NULL, NULL, {_number_sql(column)})")


#: Numbers whose text is already the shortest: below a million, not tiny, without trailing zeros.
_SHORT = r"^-?(?:0|[1-9][0-9]{0,5})(?:\.(?!0000)[0-9]{0,9}[1-9])?$"


#: Parts of a JSON text: strings, punctuation, and numbers or names.
_PART = r'"(?:[^"\\\\]++|\\\\.)*+"|[{}\\[\\],:]|[^"{}\\[\\],:\\s]++'


def _number_or_name(text: str, n: int) -> str:
    return f"IF(rlike({text}, r'{_SHORT}') OR {text} IN ('true', 'false'), {text}, coalesce({_number_sql(f'try_cast({text} AS double)', n)}, {text}))"


def _nested_sql(json: str) -> str:
    """SQL of a nested value's text.  Every part of the JSON text is rendered by itself, so any depth is."""
    shown = f"CASE x WHEN '{{' THEN 'map[' WHEN '}}' THEN ']' WHEN ',' THEN ' ' WHEN '[' THEN x WHEN ']' THEN x WHEN ':' THEN x WHEN 'null' THEN '<nil>' ELSE IF(startswith(x, '\"'), string(parse_json(x)), {_number_or_name('x', 1)}) END"
    return f"array_join(transform(regexp_extract_all({json}, '{_PART}', 0), x -> {shown}), '')"


def value_texts(column: str) -> Column:
    """A map<string,variant> column with its JSON values as text: strings as they are, numbers shortest, null as <nil>,
    objects as map[k:v ...] in key order, lists as [v ...], whatever their depth."""
    plain = "IF(contains(j, '\\\\'), string(v), substring(j, 2, length(j) - 2))"
    other = f"IF(j = 'null', '<nil>', IF(startswith(j, '{{') OR startswith(j, '['), {_nested_sql('j')}, {_number_or_name('j', 0)}))"
    text = f"IF(startswith(j, '\"'), {plain}, {other})"
    return F.expr(f"transform_values({column}, (k, v) -> transform(array(coalesce(to_json(v), 'null')), j -> {text})[0])")
