"""Globs, cursors, ranges and sections: no Spark session."""

import re

import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from quarrylight.functions.glob import compile_glob
from quarrylight.model import QueryError, checked_limit, closed_fields
from quarrylight.operators.documents import parse_sections
from quarrylight.operators.files import normal_ranges
from quarrylight.plans import cursor


def matched(pattern: str, paths: list[str]) -> list[str]:
    # Java's \x{..} and \z in Python's spelling
    regex = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), compile_glob(pattern).regex).replace(r"\z", r"\Z")
    return [p for p in paths if re.search(regex, p)]


# A pattern as a list of components: "**", or atoms that are a character, STAR, ANY, (negated, ranges) or alternatives.
STAR, ANY = object(), object()
LETTERS = "abcdé😀-^!,[x"


def spelt(atom) -> str:
    if atom is STAR or atom is ANY:
        return "*" if atom is STAR else "?"
    if isinstance(atom, str):
        return "\\" + atom if atom in "*?[]{}!," else atom
    if isinstance(atom, list):
        return "{" + ",".join("".join(map(spelt, a)) for a in atom) + "}"
    negated, ranges = atom
    inner = lambda c: "\\" + c if c in "*?[]{}!,-" else c
    return "[" + "!" * negated + "".join(inner(a) if a == b else f"{inner(a)}-{inner(b)}" for a, b in ranges) + "]"


def expanded(component) -> list[list]:
    """A component without alternatives, once for each choice among them."""
    out = [[]]
    for atom in component:
        out = [x + y for x in out for y in (atom if isinstance(atom, list) else [[atom]])]
    return out


def one_matches(atoms: list, text: str) -> bool:
    if not atoms:
        return not text
    head, rest = atoms[0], atoms[1:]
    if head is STAR:
        return any(one_matches(rest, text[i:]) for i in range(len(text) + 1))
    if not text:
        return False
    if head is ANY:
        fits = True
    elif isinstance(head, str):
        fits = head == text[0]
    else:
        fits = any(a <= text[0] <= b for a, b in head[1]) != head[0]
    return fits and one_matches(rest, text[1:])


def branch_matches(branch: list, path: list[str]) -> bool:
    if len(branch) == 1 and branch[0] != "**" and any(not isinstance(a, str) for a in branch[0]):
        return one_matches(branch[0], path[-1])
    if not branch:
        return not path
    if branch[0] == "**":
        return len(branch) == 1 or any(branch_matches_from(branch[1:], path[i:]) for i in range(len(path)))
    return branch_matches_from(branch, path)


def branch_matches_from(branch: list, path: list[str]) -> bool:
    """As ``branch_matches``, for a branch that goes on after a slash."""
    if not branch or not path:
        return not branch and not path
    if branch[0] == "**":
        return len(branch) == 1 or any(branch_matches_from(branch[1:], path[i:]) for i in range(len(path)))
    return one_matches(branch[0], path[0]) and branch_matches_from(branch[1:], path[1:])


letters = st.sampled_from(LETTERS)
classes = st.tuples(st.booleans(), st.lists(st.tuples(letters, letters).map(lambda x: tuple(sorted(x))), min_size=1, max_size=3))
simple = st.one_of(letters, letters, st.sampled_from([STAR, ANY]), classes)
alternatives = st.lists(st.lists(simple, min_size=1, max_size=2), min_size=2, max_size=3)
components = st.one_of(st.just("**"), st.lists(st.one_of(simple, simple, simple, alternatives), min_size=1, max_size=4))
names = st.text(LETTERS, min_size=1, max_size=3)


@settings(max_examples=400, deadline=None)
@given(st.lists(components, min_size=1, max_size=3), st.lists(st.lists(names, min_size=1, max_size=4), min_size=1, max_size=12))
def test_glob_equals_a_matcher(pattern, paths):
    branches = [[]]
    for c in pattern:
        branches = [x + [y] for x in branches for y in (["**"] if c == "**" else expanded(c))]
    # two stars side by side are no component, and a class must ascend to be one
    assume(len(branches) <= 64 and not any(a is STAR and b is STAR for x in branches for c in x if c != "**" for a, b in zip(c, c[1:])))
    text = "/".join("**" if c == "**" else "".join(map(spelt, c)) for c in pattern)
    paths = [*paths, *[["".join(a for a in c if isinstance(a, str)) or "a" for c in x if c != "**"] or ["a"] for x in branches[:4]]]
    expected = ["/".join(p) for p in paths if any(branch_matches(x, p) for x in branches)]
    assert matched(text, ["/".join(p) for p in paths]) == expected, text


PATHS = ["en/src1/000000007.md", "en/src1/000000012.md", "en/src2/000000007.md", "de/src1/000000007.md", "en/index.md", "index.md", "index.mdx"]


@pytest.mark.parametrize(
    "pattern, expected",
    [
        ("index.md", [5]),  # a literal stands for the path from the root
        ("*.md", [0, 1, 2, 3, 4, 5]),  # a wildcard without a slash, for any depth
        ("*/index.md", [4]),  # a slash binds the depth
        ("en/**", [0, 1, 2, 4]),
        ("en/**/*7.md", [0, 2]),
        ("**/src1/*", [0, 1, 3]),
        ("{en,de}/src1/*[2-7].md", [0, 1, 3]),
        ("*.md?", [6]),
        ("??/src[!1]/**", [2]),
    ],
)
def test_glob_over_logical_paths(pattern, expected):
    assert matched(pattern, PATHS) == [PATHS[i] for i in expected]


@pytest.mark.parametrize(
    "pattern",
    [
        "\t", "   ", "é" * 257, "en\x1f.md", "\udc80",  # text: blank, long, controls, surrogates
        "en/{a,b", "en/{a}", "{a,}.md", "{{{{{a,b},c},d},e},f}", "{a,b}" * 7,  # braces: unclosed, single, empty, deep, many
        "/en", "en/", "en//x", "en/./x", "en/..", "!en", "en:x", "{en,/x}",  # branches
        "en/a**", "**b/en", "en/***",  # two stars are a component or nothing
        "en/[", "en/]", "[]", "[!]", "[d-b]", "[a/b]", "[[a]",  # classes
        "en\\md", "en\\", "\\\\x",  # escapes
        "+(en)", "?(en)", "*(en)", "@(en)",  # extended patterns
    ],
)
def test_glob_refuses(pattern):
    with pytest.raises(QueryError):
        compile_glob(pattern)


def test_glob_prefixes():
    assert compile_glob("en/src1/*.md").prefixes == ("en/src1/",)
    assert compile_glob("{en,de}/**").prefixes == ("en/", "de/")
    assert compile_glob("*.md").prefixes == ("",)


def test_cursors_are_bound():
    bound = cursor.binding("search", query="x", limit=3)
    token = cursor.encode(bound, ["a", 3], b"key")
    assert cursor.decode(token, bound, b"key") == ["a", 3]
    for bad in (token[:-2], "", "%%", cursor.encode(bound, ["a", 3], b"other")):
        with pytest.raises(QueryError):
            cursor.decode(bad, bound, b"key")
    with pytest.raises(QueryError):
        cursor.decode(cursor.encode(bound, [1]), cursor.binding("search", query="y", limit=3))


def test_strict_binding():
    assert closed_fields({"limit": 3}, {"limit": int}) == {"limit": 3}
    for bad in ({"limit": "3"}, {"limit": None}, {"limit": True}, {"other": 1}):
        with pytest.raises(QueryError):
            closed_fields(bad, {"limit": int})
    for bad in (0, 101, "1", True):
        with pytest.raises(QueryError):
            checked_limit(bad)


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 9)), min_size=1, max_size=12))
def test_ranges_cover_the_same_lines(pairs):
    ranges = [(a, a + n) for a, n in pairs]
    merged = normal_ranges(ranges)
    assert {x for a, b in merged for x in range(a, b + 1)} == {x for a, b in ranges for x in range(a, b + 1)}
    assert all(b + 1 < c for (_, b), (c, _) in zip(merged, merged[1:]))


def sections_by_lines(text: str) -> list[tuple[int, str]]:
    """(start line, title) by one pass over the lines, with the open fence as state."""
    out, fence = [], None
    for i, line in enumerate(text.split("\n"), 1):
        body = line.removesuffix("\r")
        indent = len(body) - len(body.lstrip(" "))
        rest = body[indent:]
        mark = rest[:1]
        run = len(rest) - len(rest.lstrip(mark)) if mark in ("`", "~") and mark else 0
        if fence:
            if indent <= 3 and mark == fence[0] and run >= fence[1] and not rest[run:].strip(" \t"):
                fence = None
            continue
        if indent > 3:
            continue
        if run >= 3 and not (mark == "`" and "`" in rest[run:]):
            fence = mark, run
            continue
        level = len(rest) - len(rest.lstrip("#"))
        if 1 <= level <= 6 and (not rest[level:] or rest[level] in " \t"):
            title = rest[level:].strip(" \t")
            closed = title.rstrip("#")
            if closed == "" or closed[-1] in " \t":
                title = closed.rstrip(" \t")
            out.append((i, title))
    return out if out and out[0][0] == 1 else [(1, ""), *out]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["# ", "## b", "#", "###### x ##", "####### no", "#no", "   # in", "    # out", "```", "````", "``` lang", "```a`b", "~~~", "~~~~ x", " ~~~", "text", "", "\t# tab", "# end #", "#\tt", "  ```  "]), max_size=14), st.sampled_from(["\n", "\r\n"]))
def test_sections_equal_a_pass_over_lines(parts, end):
    text = end.join(parts)
    assert [(s[0], s[4]) for s in parse_sections(text, 1000)] == sections_by_lines(text)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("owner\n\n## user\n\nasks\n", [(1, ""), (3, "user")]),  # what comes before the first heading
        ("####### seven\n###### six\n", [(1, ""), (2, "six")]),
        ("    # code\n   # three blanks\n", [(1, ""), (2, "three blanks")]),
        ("#tag\n#\n", [(1, ""), (2, "")]),
        ("# a ## b ###\r\n", [(1, "a ## b")]),
        ("# a#\n", [(1, "a#")]),
        ("~~~~\n~~~\n# in\n~~~~~ \n# out", [(1, ""), (5, "out")]),  # a fence ends with as many marks or more
        ("```\n~~~\n# in\n", [(1, "")]),  # of the same kind, or never
        ("Title\n=====\n", [(1, "")]),  # underlined ones are none
    ],
)
def test_rules_of_sections(text, expected):
    assert [(s[0], s[4]) for s in parse_sections(text)] == expected


def test_bound_of_sections():
    assert len(parse_sections("# a\n" * 256)) == 256
    with pytest.raises(QueryError):
        parse_sections("# a\n" * 257)


@given(st.text(alphabet="# \n`~ab\t", max_size=80))
def test_sections_tile_the_text(text):
    found = parse_sections(text, 1000)
    assert "".join(text[s[2] : s[3]] for s in found) == text
    assert all(a[1] + 1 == b[0] for a, b in zip(found, found[1:]))
