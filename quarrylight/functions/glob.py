"""The file pattern language, compiled on the driver to an anchored regular expression.

``*`` and ``?`` stay within a path component, ``**`` spans components, ``[...]`` is a class (``!``
negates), ``{a,b}`` gives alternatives before all else.  An alternative with a wildcard and no slash
matches at any depth; a literal one matches from the root.  Classes never match a slash.

A pattern is first spelt with one character for each of its symbols: wildcards, braces and classes get
characters of a private plane.  What an alternative may not hold is then a search of that spelling, and
its regular expression a substitution in it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.model import invalid

MOST_SCALARS, MOST_DEPTH, MOST_BRANCHES, MOST_SYMBOLS = 256, 4, 64, 8192

# one private character for each special symbol; escaped literals and classes follow
_STAR, _ANY, _OPEN, _CLOSE, _COMMA = map(chr, range(0xF0000, 0xF0005))
_ESCAPED, _CLASS = 0xF1000, 0x100000
_PLAIN = {"*": _STAR, "?": _ANY, "{": _OPEN, "}": _CLOSE, ",": _COMMA}
_SYMBOL = re.compile(r"\\([*?\[\]{}!,])|\[((!?+)(?:\\[*?\[\]{}!,-]|[^\[\]\\/])+)\]|([*?{},])|([^\\\[\]])", re.S)
_MEMBER = re.compile(r"(\\.|[^-\\])-(\\.|[^\\])|(\\.|.)", re.S)

#: Empty, "." and ".." components, negation, extended patterns, and "**" that is no component.
_FORBIDDEN = re.compile(rf"(?:^|/)\.{{0,2}}(?:/|$)|^!|[@+!{_STAR}{_ANY}]\(|[^/]{_STAR}{_STAR}|{_STAR}{_STAR}[^/]", re.S)
_WILD = re.compile(f"[{_STAR}{_ANY}{chr(_CLASS)}-{chr(0x10FFFF)}]")
_PART = re.compile(f"(?P<folders>{_STAR}{_STAR}/)|(?P<all>{_STAR}{_STAR})|(?P<some>{_STAR})|(?P<one>{_ANY})|(?P<class>[{chr(_CLASS)}-{chr(0x10FFFF)}])|(?P<char>.)", re.S)
_FIXED = {"folders": "(?:[^/]+/)*", "all": ".*", "some": "[^/]*", "one": "[^/]"}


def _point(c: int) -> str:
    return f"\\x{{{c:x}}}"


@dataclass(frozen=True)
class Glob:
    """``regex`` matches whole paths; every match starts with one of ``prefixes``."""

    pattern: str
    regex: str
    prefixes: tuple[str, ...]

    def matches(self, path: Column) -> Column:
        """Literal prefixes go in front as start-with tests, which a Parquet scan can use."""
        test = path.rlike(self.regex)
        if self.prefixes and all(self.prefixes):
            starts = [path.startswith(p) for p in self.prefixes[:8]]
            if len(self.prefixes) <= 8:
                any_ = starts[0]
                for s in starts[1:]:
                    any_ = any_ | s
                return any_ & test
        return test


def _class_regex(body: str) -> str:
    """A class as a regular expression without lookahead: no range of it, or of its complement, holds the slash."""
    negated = body.startswith("!")
    spans = []
    for low, high, single in _MEMBER.findall(body[negated:]):
        a, b = (ord(x[-1]) for x in ((low, high) if low else (single, single)))
        if a > b:
            raise invalid("descending range")
        spans += [(x, y) for x, y in ((a, min(b, 46)), (max(a, 48), b)) if x <= y] if a <= 47 <= b else [(a, b)]
    inside = "".join(_point(x) + (f"-{_point(y)}" if y > x else "") for x, y in spans)
    if negated:
        return f"[^{inside}{_point(47)}]"
    return f"[{inside}]" if inside else "[^\\x{0}-\\x{10ffff}]"


def _spelt(pattern: str) -> tuple[str, list[str]]:
    """The pattern with a character for each symbol, and the regular expressions of its classes."""
    out, classes, at = [], [], 0
    for m in _SYMBOL.finditer(pattern):
        if m.start() != at:
            break
        at = m.end()
        escaped, body, _, special, plain = m.groups()
        if body:
            out.append(chr(_CLASS + len(classes)))
            classes.append(_class_regex(body))
        else:
            out.append(chr(_ESCAPED + ord(escaped)) if escaped else _PLAIN[special] if special else plain)
    if at != len(pattern):
        raise invalid("escape or class")
    return "".join(out), classes


def _alternatives(spelt: str) -> Iterator[str]:
    """What the braces stand for, the first pair of them first."""
    start = spelt.find(_OPEN)
    if start < 0:
        if _CLOSE in spelt:
            raise invalid("brace")
        yield spelt.replace(_COMMA, ",")
        return
    levels = list(accumulate((c == _OPEN) - (c == _CLOSE) for c in spelt))
    if min(levels) < 0 or levels[-1]:
        raise invalid("brace")
    if max(levels) > MOST_DEPTH:
        raise invalid("braces too deep")
    stop = levels.index(0, start)
    cuts = [start, *(i for i in range(start, stop) if spelt[i] == _COMMA and levels[i] == 1), stop]
    choices = [spelt[a + 1 : b] for a, b in zip(cuts, cuts[1:])]
    if len(choices) < 2 or "" in choices:
        raise invalid("one alternative, or an empty one")
    for choice in choices:
        yield from _alternatives(spelt[:start] + choice + spelt[stop + 1 :])


def _literal(text: str) -> str:
    return "".join(chr(ord(c) - _ESCAPED) if _ESCAPED <= ord(c) < _CLASS else c for c in text)


def _regex(branch: str, classes: list[str]) -> str:
    def part(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "class":
            return classes[ord(m[0]) - _CLASS]
        if kind != "char":
            return _FIXED[kind]
        c = _literal(m[0])
        return c if c.isalnum() or ord(c) > 127 else _point(ord(c))

    return _PART.sub(part, branch)


def compile_glob(pattern: str) -> Glob:
    """Raises INVALID_ARGUMENT for what the language does not allow."""
    if not isinstance(pattern, str) or not pattern.strip() or len(pattern) > MOST_SCALARS or re.search(f"[\0-\x1f\x7f-\x9f\ud800-\udfff{chr(0xF0000)}-{chr(0x10FFFF)}]", pattern):
        raise invalid("pattern")
    spelt, classes = _spelt(pattern)
    branches = list(islice(_alternatives(spelt), MOST_BRANCHES + 1))
    if len(branches) > MOST_BRANCHES or sum(map(len, branches)) > MOST_SYMBOLS:
        raise invalid("too many alternatives")
    if ":" in pattern or any(_FORBIDDEN.search(b) for b in branches):
        raise invalid("alternative")
    parts, literals = [], []
    for b in branches:
        wild = _WILD.search(b)
        deep = wild and "/" not in b and b != _STAR + _STAR
        parts.append(("(?:[^/]+/)*" if deep else "") + _regex(b, classes))
        literals.append("" if deep else _literal(b[: wild.start()] if wild else b))
    regex = r"(?s)\A(?:" + "|".join(parts) + r")\z"
    prefixes = tuple(dict.fromkeys(literals)) if len(set(literals)) <= 8 else (os.path.commonprefix(literals),)
    return Glob(pattern, regex, prefixes)
