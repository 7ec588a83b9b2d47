"""Linear-time (RE2) regular expressions on Spark's Java engine.

``translate`` rewrites a pattern so that Java gives RE2's result: named groups become numbered ones, other groups don't
capture, ``$`` means the end of the text, ``.`` stops at newlines only.  What Java has and RE2 lacks is rejected.
``capture`` extracts all named groups in one pass over the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands between groups in the one-pass extraction; texts that hold it take the pass per group.
_SEPARATOR = "\u0001"
_SPACE = r"\t\n\f\r "
#: Edges of ASCII words; Java's own look at all letters.
_EDGE, _NO_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))", r"(?:(?<!\w)(?!\w)|(?<=\w)(?=\w))"
#: Groups from which one pass is cheaper than one pass for each.
ONE_PASS = 3


class PatternError(ValueError):
    """The pattern is not one that both engines understand alike."""


@dataclass(frozen=True)
class Pattern:
    """A translated pattern: Java text and the names of its capturing groups, in order."""

    java: str
    names: tuple[str, ...]


def _char_class(pattern: str, at: int) -> tuple[str, int]:
    """A bracket expression from ``at``; RE2 reads [ and && inside it as plain characters."""
    out, i = "[", at + 1
    if pattern.startswith("^", i):
        out, i = out + "^", i + 1
    first = True
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and not first:
            return out + "]", i + 1
        first = False
        if c == "[" and (m := re.match(r"\[:(\^?)([a-z]+):\]", pattern[i:])):
            name = {"word": "\\w", "ascii": "\\p{ASCII}", "xdigit": "\\p{XDigit}"}.get(m[2], f"\\p{{{m[2].capitalize()}}}")
            out, i = out + (f"[^{name}]" if m[1] else name), i + len(m[0])
        elif c == "\\":
            pair = pattern[i : i + 2]
            if pair == "\\s":
                out += _SPACE
            elif pair == "\\S":
                out += f"[^{_SPACE}]"
            else:
                out += pair
            i += 2
        else:
            out, i = out + ("\\" if c in "[]&" else "") + c, i + 1
    raise PatternError(f"missing ]: {pattern}")


def translate(pattern: str, capture_all: bool = False) -> Pattern:
    """The Java form of an RE2 pattern; with ``capture_all`` plain groups keep capturing."""
    out, names, i, multiline = [], [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            text, i = _char_class(pattern, i)
            out.append(text)
        elif c == "\\":
            pair = pattern[i : i + 2]
            if len(pair) < 2:
                raise PatternError("trailing backslash")
            if pair[1] in "123456789" or pair in ("\\C", "\\k", "\\G", "\\Z", "\\R", "\\X", "\\h", "\\H"):
                raise PatternError(f"{pair} is not supported")
            if pair == "\\Q":
                end = pattern.find("\\E", i)
                out.append(re.sub(r"([^\w\s])", r"\\\1", pattern[i + 2 : end if end >= 0 else len(pattern)]))
                i = end + 2 if end >= 0 else len(pattern)
                continue
            out.append({"\\s": f"[{_SPACE}]", "\\S": f"[^{_SPACE}]", "\\b": _EDGE, "\\B": _NO_EDGE}.get(pair, pair))
            i += 2
        elif c == "(":
            rest = pattern[i:]
            if m := re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", rest):
                if m[1] in names:
                    raise PatternError(f"duplicate group {m[1]}")
                names.append(m[1])
                out.append("(")
                i += len(m[0])
            elif m := re.match(r"\(\?([a-zA-Z-]*)([:)])", rest):
                if set(m[1]) - set("ims-"):
                    raise PatternError(f"flags {m[1]} are not supported")
                multiline = multiline or "m" in m[1].partition("-")[0]
                out.append(m[0])
                i += len(m[0])
            elif rest.startswith("(?"):
                raise PatternError("look-around is not supported")
            else:
                out.append("(" if capture_all else "(?:")
                i += 1
        elif c == "$":
            out.append("$" if multiline else "\\z")
            i += 1
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise PatternError("possessive repeats are not supported")
        else:
            out.append(c)
            i += 1
    return Pattern("(?d)" + "".join(out), tuple(names))


#: Java's names of ASCII classes, as ranges.
_ASCII_CLASSES = {
    "Alnum": "0-9A-Za-z", "Alpha": "A-Za-z", "ASCII": r"\x00-\x7f", "Blank": r"\t ", "Cntrl": r"\x00-\x1f\x7f", "Digit": "0-9", "Graph": "!-~", "Lower": "a-z", "Print": " -~",
    "Punct": r"!-/:-@\[-`{-~", "Space": r"\t-\r ", "Upper": "A-Z", "XDigit": "0-9A-Fa-f",
}


def compile_python(pattern: str) -> re.Pattern:
    """The same translation for the few places that match in Python (streams with state), so both give one result.

    Unicode classes and what Python's engine lacks are refused.
    """
    out, inside = [], False
    for token in re.findall(r"\\[pP]\{\w+\}|\\.|.", translate(pattern).java.removeprefix("(?d)"), re.S):
        if token == "\\z":
            token = r"\Z"
        elif m := re.fullmatch(r"\\([pP])\{(\w+)\}", token):
            if m[2] not in _ASCII_CLASSES or (inside and m[1] == "P"):
                raise PatternError(f"{token} is not supported in streams")
            token = _ASCII_CLASSES[m[2]] if inside else f"[{'^' if m[1] == 'P' else ''}{_ASCII_CLASSES[m[2]]}]"
        elif token == "[":
            if inside:
                raise PatternError("negated classes inside brackets are not supported in streams")
            inside = True
        elif token == "]":
            inside = False
        out.append(token)
    try:
        return re.compile("".join(out), re.ASCII)
    except re.error as e:
        raise PatternError(str(e)) from e


def matches(text: Column, pattern: Pattern) -> Column:
    return text.rlike(pattern.java)


def capture(text: Column, pattern: Pattern, names: tuple[str, ...] | None = None) -> Column:
    """map<string,string> of the named groups of the leftmost match; a group that took no part is ''.  Null: no match.

    ``names`` limits the result to some groups, so dropped ones are never extracted.
    """
    wanted = [(i + 1, n) for i, n in enumerate(pattern.names) if names is None or n in names]
    found = text.rlike(pattern.java)
    none = F.create_map().cast("map<string,string>")
    if not wanted:
        return F.when(found, none)
    single = F.create_map(*[x for i, n in wanted for x in (F.lit(n), F.regexp_extract(text, pattern.java, i))])
    if len(wanted) < ONE_PASS:
        return F.when(found, single)
    whole = f"(?s:\\A.*?)(?:{pattern.java})(?s:.*)\\z"
    joined = F.regexp_replace(text, F.lit(whole), F.lit(_SEPARATOR.join(f"${i}" for i, _ in wanted)))
    at_once = F.map_from_arrays(F.array(*[F.lit(n) for _, n in wanted]), F.split(joined, _SEPARATOR, -1))
    return F.when(found, F.when(text.contains(_SEPARATOR), single).otherwise(at_once))
