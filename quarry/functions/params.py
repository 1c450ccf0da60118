"""Parameter rules that run on the driver: no data passes through them."""

from __future__ import annotations

import json
import re
from re import _constants as ops, _parser

MAX_BATCH = 50


def string_or_list(value) -> list[str]:
    """A name, a list of names, or a JSON list in a string; text that only looks like JSON is one name.

    Raises ValueError if there is none or more than MAX_BATCH; an empty list is allowed and gives no results.
    """
    if value is None or value == "":
        raise ValueError("a name or a list of names is required")
    if isinstance(value, str):
        names = [value]
        if value.strip().startswith("["):
            try:
                parsed = json.loads(value)
                if isinstance(parsed, list) and all(isinstance(x, str) for x in parsed):
                    names = parsed
            except ValueError:
                pass
    elif isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value):
        names = list(value)
    else:
        raise ValueError("names must be strings")
    if len(names) > MAX_BATCH:
        raise ValueError(f"at most {MAX_BATCH} names at once")
    return names


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def in_range_or(value, low, high, otherwise):
    """The value if it lies in the range, else the default: it is not clamped."""
    return value if value is not None and low <= value <= high else otherwise


def limit_or(value: int | None, default: int, most: int) -> int:
    """A limit of 0 or less means the default; none goes beyond the most."""
    return default if value is None or value <= 0 else min(value, most)


def phrase(query: str) -> str:
    """A full-text query as one quoted phrase."""
    return '"' + query.replace('"', '""') + '"'


# Named character classes of the tools' dialect and what the engine calls them.
NAMED_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}",
    "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}
_PIECE = re.compile(
    r"(?P<quoted>\\Q.*?(?:\\E|\Z))|(?P<escape>\\.)|\(\?P<(?P<group>\w+)>|\(\?P=(?P<back>\w+)\)|(?P<open>\((?!\?)|\(\?<(?![=!]))"
    r"|(?P<start>\[\^?\]?)|(?P<rest>.)", re.S)
_IN_CLASS = re.compile(r"\[:(?P<neg>\^?)(?P<named>\w+):\]|(?P<escape>\\.)|(?P<end>\])|(?P<nested>\[)|(?P<both>&&)|(?P<rest>.)", re.S)


def engine_pattern(pattern: str) -> str:
    """The pattern in the dialect of the engine that runs it (java.util.regex), group numbers kept.

    `(?P<name>...)` and `(?P=name)` become numbered groups and references; inside a class `[:alpha:]` and its like are
    translated, and `[` and `&&`, which are plain characters there, are escaped. All else stays.
    """
    out, at, groups, names = [], 0, 0, {}
    while at < len(pattern):
        m = _PIECE.match(pattern, at)
        at = m.end()
        if m["group"]:
            groups += 1
            names[m["group"]] = groups
            out.append("(")
        elif m["back"]:
            if m["back"] not in names:
                raise ValueError(f"unknown group {m['back']!r}")
            out.append(rf"\{names[m['back']]}(?:)")
        elif m["start"]:
            out.append(m[0].replace("]", r"\]"))
            closed = False
            while not closed and at < len(pattern):
                k = _IN_CLASS.match(pattern, at)
                at = k.end()
                closed = bool(k["end"])
                if k["named"]:
                    if k["named"] not in NAMED_CLASSES:
                        raise ValueError(f"unknown character class {k[0]!r}")
                    out.append(("[^%s]" if k["neg"] else "%s") % NAMED_CLASSES[k["named"]])
                else:
                    out.append({"[": r"\[", "&&": r"&\&"}.get(k[0], k[0]))
        else:
            groups += bool(m["open"])
            out.append(m[0])
    return "".join(out)


def _held(parsed) -> list[str]:
    """The runs of literal characters that every match of a parsed pattern holds; a run ends where anything else comes."""
    runs = [""]
    for op, value in parsed:
        inner = []
        if op is ops.LITERAL:
            runs[-1] += chr(value)
            continue
        if op is ops.AT:  # a place, no character
            continue
        if op is ops.SUBPATTERN:
            inner = _held(value[-1])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _held(value[2])
        elif op is ops.ATOMIC_GROUP:
            inner = _held(value)
        runs += [*inner, ""]
    return runs


def required_literal(pattern: str) -> str:
    """Text that every match of the pattern holds, if case is set aside; empty if there is none of three characters.

    Taken from the parsed pattern: what stands in one branch of several, or may be absent, is not required. Of a pattern
    without operators all is required; of others the longest run of ASCII word characters.
    """
    try:
        runs = _held(_parser.parse(engine_pattern(pattern)))
    except (re.error, ValueError, OverflowError, RecursionError):  # another dialect: nothing is known
        return ""
    if len(runs) == 1 and "\\" not in pattern:
        return runs[0]
    words = [w for run in runs for w in re.findall(r"[A-Za-z0-9_]{3,}", run)]
    return max(words, key=len, default="")
