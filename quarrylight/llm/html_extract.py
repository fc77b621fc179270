"""Main text of web pages: boosted trees over DOM nodes, then a choice that holds along every path.

A page becomes a tree of elements.  Gradient-boosted trees give each element the odds that it belongs
to the article, from its tag, the tokens of its attributes and its ancestors' ones, the density of text
and links in its subtree, its depth and its place among its siblings.  Of all choices in which no kept
element stands below a dropped one, the likeliest is taken, from the leaves up.  The text of what is
kept is given out block by block.

The trees are trained here, on pages of many layouts that ``training_pages`` makes up from a seed, with
known articles; no page of the corpus is used.  On some of them the names of elements mean nothing, so
that structure and density are learned without them.

Character references are decoded, white space inside a block becomes one space (a line break element
counts as white space), blocks are trimmed, and those with text are joined by line feeds in page order.

Defined results: null html is an empty page; a page without an article gives the empty text; text that
is cut short, unclosed tags and stray end tags are read as browsers do, roughly; pages of any length and
depth are read whole, in time that grows with their length; repeated rows give repeated results; an empty
table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import read, small_batches
from quarrylight.llm.gbt import Trees

_KINDS = {
    "p": "p", "article": "article", "main": "article", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside",
    "form": "form", "button": "form", "input": "form", "select": "form", "label": "form", "fieldset": "form", "option": "form",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "a": "a", "div": "div", "section": "div", "center": "div",
    "table": "table", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "caption": "table",
    "pre": "quote", "code": "quote", "blockquote": "quote", "figure": "quote", "figcaption": "quote", "body": "root", "html": "root", "#page": "root",
} | {f"h{i}": "heading" for i in range(1, 7)}
KIND_NAMES = sorted({*_KINDS.values(), "inline"})
_KIND = {tag: KIND_NAMES.index(k) for tag, k in _KINDS.items()}
_TEXT_KINDS = [KIND_NAMES.index(k) for k in ("p", "heading", "item", "quote", "inline")]
_INLINE = KIND_NAMES.index("inline")
BLOCKS = frozenset(_KINDS) - {"a", "button", "input", "select", "label", "option", "code"} | {"hr", "address", "details", "summary", "tfoot", "title"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no page text.
RAW = frozenset("script style noscript textarea template iframe svg select head title xmp".split())
#: Tags that end a drawing which was not closed, as browsers have it.
_BREAKOUT = "b big blockquote body br center code dd div dl dt em embed h[1-6] head hr i img li listing main article section aside nav header footer form figure menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var"
_IN_SVG = re.compile(rf"<(?:(/svg)|(svg)|(foreignobject)|({'|'.join(_BREAKOUT.split())}))(?=[\s/>])([^>]*)>?", re.I)
_END_FOREIGN = re.compile(r"</foreignobject\b[^>]*>", re.I)
#: A start tag on the right ends an open element on the left.
_CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "caption", "body", "html"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label|data-role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_STOP = re.compile(r"[.!?;:…]")

#: Attribute tokens by what they speak for; each group is a feature.
LEXICON = {
    "article": "article articlebody content main post entry body story text blog prose maincontent page".split(),
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toolbar pagination pager toc skip sitemap".split(),
    "frame": "header masthead footer topbar foot bottom copyright legal colophon branding logo".split(),
    "side": "sidebar side aside rail widget widgets related recommended recommend popular trending more teaser secondary complementary".split(),
    "ad": "ad ads adv advert advertisement adsbox adslot banner sponsor sponsored promo promoted promotion dfp doubleclick outbrain taboola".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog toast message warning disclaimer paywall".split(),
    "form": "form search login signin signup subscribe newsletter register contact input feedback".split(),
    "comment": "comment comments commentlist respond reply replies discussion disqus thread reader readers".split(),
    "share": "share sharing social follow tags tag meta byline author date timestamp print rating vote hidden".split(),
}
_GROUPS = list(LEXICON)
#: Elements whose features are held at once.
ELEMENTS = 1 << 14
#: Places that all attribute tokens are hashed to.
HASHES = 24
_GROUP_OF = {t: i for i, (_, words) in enumerate(LEXICON.items()) for t in words}
_OWN_FLAGS = {"nav": 1, "header": 2, "footer": 4, "aside": 8, "form": 16, "article": 32, "a": 64}
_FLAG = np.array([_OWN_FLAGS.get(k, 0) for k in KIND_NAMES])
_BITS = len(_OWN_FLAGS)


@lru_cache(maxsize=20_000)
def _groups(attributes: str) -> tuple[int, int]:
    """Which lexicon groups the attributes' tokens belong to, and which of HASHES places they fall on, as bits."""
    bits = hashed = 0
    for value in _ATTR.findall(attributes):
        words = _TOKEN.findall(value)
        for w in [*words, "".join(words)]:
            g = _GROUP_OF.get(w.lower())
            if g is not None:
                bits |= 1 << g
        for w in words:
            hashed |= 1 << (zlib.crc32(w.lower().encode()) % HASHES)
    return bits, hashed


class Tree:
    """Elements in document order, as lists; chunks: (element, block, text)."""

    __slots__ = ("parent", "end", "kind", "own", "flags", "above", "tokens", "under", "named", "depth", "chars", "stops", "words", "chunks")

    def __init__(self) -> None:
        for name in self.__slots__:
            setattr(self, name, [])


def tags(source: str) -> Iterator[tuple[int, int, str, str, str] | None]:
    """(start, end, slash, name, attributes) of each tag and, with an empty name, of each comment; a single pass.

    The caller may send the place to go on from.  Where quotes are never closed, they count as plain
    characters from there on, so no place is read twice.
    """
    at, n, quotes = 0, len(source), True
    while (m := _MARKUP.search(source, at)) is not None:
        if m[2] is None:
            mark = "-->" if m[0] == "<!--" else ">"
            found = source.find(mark, m.end())
            end = found + len(mark) if found >= 0 else n
            tag = (m.start(), end, "", "", "")
        else:
            stop = _QUOTED.match(source, m.end()).end() if quotes else source.find(">", m.end())
            if quotes and source[stop : stop + 1] != ">":
                quotes = False
                stop = source.find(">", m.end())
            if stop < 0:  # no tag ends after this
                return
            end = stop + 1
            tag = (m.start(), end, m[1], m[2].lower(), source[m.end() : stop])
        to = yield tag
        at = end
        if to is not None:
            at = to
            yield None


class _Open:
    """The stack of open elements; where each name was opened last is known at once."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def pop(self) -> None:
        self.at[self.names.pop()].pop()

    def height(self, *names: str) -> int:
        """Of the innermost open element with one of the names; -1 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)


def _end_of_svg(source: str, at: int) -> int:
    """Where a drawing ends whose start tag ends at ``at``: after its end tag, or before a tag that no drawing holds."""
    depth = 1
    while (m := _IN_SVG.search(source, at)) is not None:
        at = m.end()
        if m[1]:
            depth -= 1
            if not depth:
                return at
        elif m[2]:
            depth += not m[5].endswith("/")
        elif m[3]:  # pages within drawings
            end = _END_FOREIGN.search(source, at)
            if end is None:
                return m.start()
            at = end.end()
        else:
            return m.start()
    return len(source)


_IN_SELECT = re.compile(rf"</select\b[^>]*>|(?=<(?:/?(?:{'|'.join(sorted(BLOCKS - {'hr'}))})|select|input|textarea)(?=[\s/>]))", re.I)


def _end_of_select(source: str, at: int) -> int:
    """After the end tag of a list of choices, or before the next block or field: a list that was not closed ends there."""
    m = _IN_SELECT.search(source, at)
    return m.end() if m else len(source)


def parse(source: str) -> Tree:
    t = Tree()
    parent, end, kind, own, flags, above, chars, stops, words, chunks = t.parent, t.end, t.kind, t.own, t.flags, t.above, t.chars, t.stops, t.words, t.chunks
    open_ = _Open()
    stack: list[int] = []
    unclosed: set[str] = set()

    def push(name: str, attributes: str) -> None:
        up = stack[-1] if stack else -1
        k = _KIND.get(name, _INLINE)
        bits, hashed = (_groups if len(attributes) < 1000 else _groups.__wrapped__)(attributes) if attributes else (0, 0)
        parent.append(up)
        end.append(0)
        kind.append(k)
        own.append(bits)
        t.tokens.append(hashed)
        t.named.append(hashed != 0)
        flags.append((flags[up] if up >= 0 else 0) | int(_FLAG[k]))
        above.append((above[up] | own[up]) if up >= 0 else 0)
        t.under.append((t.under[up] | t.tokens[up]) if up >= 0 else 0)
        t.depth.append(len(stack))
        chars.append(0)
        stops.append(0)
        words.append(0)
        stack.append(len(parent) - 1)
        open_.push(name)

    def pop_to(height: int) -> None:
        while len(stack) > height:
            end[stack.pop()] = len(parent)
            open_.pop()

    def add(text: str) -> None:
        if text.strip():
            text = entities.unescape(text) if "&" in text else text
            i = stack[-1]
            chars[i] += len(text)
            words[i] += text.count(" ") + 1
            stops[i] += len(_STOP.findall(text))
            chunks.append((i, block, text))
        elif text:
            chunks.append((stack[-1], block, " "))

    block = 0
    push("#page", "")
    at, n = 0, len(source)
    found = tags(source)
    for start, after, slash, name, attributes in found:
        add(source[at:start])
        at = after
        if not name:
            continue
        if name == "br":
            chunks.append((stack[-1], block, " "))
            continue
        if name in BLOCKS:
            block += 1
        if slash:
            height = open_.height(name)
            if height >= 0:
                pop_to(max(height, 1))
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                if name in ("svg", "select"):
                    at = (_end_of_svg if name == "svg" else _end_of_select)(source, at)
                    found.send(at)
                    continue
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                if not close and name == "head":
                    unclosed.add(name)
                    continue
                at = close.end() if close else n
                found.send(at)
            continue
        if name in VOID:
            continue
        if name in _CLOSES_P:
            height = open_.height("p")
            if height >= 0 and open_.height("button", "table", "td", "th") < height:
                pop_to(height)
        if name in _SAME:
            height = open_.height(*_SAME[name])
            if height > max(0, open_.height(*_LIMITS[name] - _SAME[name])):
                pop_to(height)
        push(name, attributes if "=" in attributes else "")
        if attributes.endswith("/") and name not in BLOCKS and name != "a":
            pop_to(len(stack) - 1)
    add(source[at:])
    pop_to(0)
    return t


FEATURES = [f"is_{k}" for k in KIND_NAMES] + [f"has_{g}" for g in _GROUPS] + [f"under_{g}" for g in _GROUPS] + [f"within_{k}" for k in _OWN_FLAGS] + [f"token_{i}" for i in range(HASHES)] + [f"token_above_{i}" for i in range(HASHES)] + [
    "depth", "log_chars", "link_share", "log_elements", "chars_by_element", "stops_by_word", "words_by_part", "siblings", "place", "parent_share", "page_share", "begin", "parent_links", "parent_stops", "parent_parts", "in_text", "named", "alike", "alike_share", "parent_chars", "parent_page_share", "parent_headings", "parent_named", "grand_page_share"]


def features(trees: list[Tree]) -> np.ndarray:
    """A row of FEATURES for every element of all trees, in order."""
    return np.concatenate(list(feature_blocks(trees)))


def feature_blocks(trees: list[Tree], size: int = ELEMENTS) -> Iterator[np.ndarray]:
    """The rows of ``features``, ``size`` elements at a time."""
    sizes = np.array([len(t.parent) for t in trees])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    cat = lambda name: np.concatenate([np.array(getattr(t, name), np.int64) for t in trees])
    n = int(sizes.sum())
    parent, end, kind = cat("parent"), cat("end") + base, cat("kind")
    own, flags, above, chars, stops, words, tokens, under, named = (cat(x) for x in ("own", "flags", "above", "chars", "stops", "words", "tokens", "under", "named"))
    top = parent < 0
    parent = np.where(top, np.arange(n), parent + base)
    here = np.arange(n)

    def below(x: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(x)]
        return sums[end] - sums[here]

    links = np.where(flags & _OWN_FLAGS["a"], chars, 0)
    all_chars, all_stops, all_words, all_links, parts = below(chars), below(stops), below(words), below(links), below((chars > 0).astype(np.int64))
    headings = below((kind == KIND_NAMES.index("heading")).astype(np.int64))
    inside = end - here
    depth = cat("depth")
    order = np.argsort(parent * 2 + (~top), kind="stable")
    order = order[~top[order]]
    first = np.r_[True, parent[order][1:] != parent[order][:-1]] if len(order) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    count = np.bincount(group) if len(order) else np.zeros(0, np.int64)
    siblings, place = np.ones(n), np.zeros(n)
    if len(order):
        begins = np.flatnonzero(first)
        siblings[order] = count[group]
        place[order] = (np.arange(len(order)) - begins[group]) / count[group]
    # siblings of the same kind, with or without names like it
    _, like, alike = np.unique((parent * 2 + top) * (2 * len(KIND_NAMES)) + 2 * kind + named, return_inverse=True, return_counts=True)
    alike = alike[like]
    page = np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.maximum(all_chars[page], 1)
    upto = np.r_[0, np.cumsum(chars)]
    share, stop_rate = all_links / np.maximum(all_chars, 1), all_stops / np.maximum(all_words, 1)
    rest = (depth, np.log1p(all_chars), share, np.log1p(inside), np.log1p(all_chars / inside), stop_rate,
            np.log1p(all_words / np.maximum(parts, 1)), np.log1p(siblings), place, all_chars / np.maximum(all_chars[parent], 1), all_chars / whole, (upto[here] - upto[page]) / whole,
            share[parent], stop_rate[parent], np.log1p(parts[parent]), np.isin(kind[parent], _TEXT_KINDS), named, np.log1p(alike), alike / siblings,
            np.log1p(all_chars[parent]), all_chars[parent] / whole, headings[parent], named[parent], all_chars[parent[parent]] / whole)
    for a in range(0, n, size):
        own_rows = slice(a, min(a + size, n))
        x = np.zeros((own_rows.stop - a, len(FEATURES)), np.float32)
        k = len(KIND_NAMES)
        x[np.arange(len(x)), kind[own_rows]] = 1
        for g in range(len(_GROUPS)):
            x[:, k + g] = own[own_rows] >> g & 1
            x[:, k + len(_GROUPS) + g] = above[own_rows] >> g & 1
        for b in range(_BITS):
            x[:, k + 2 * len(_GROUPS) + b] = flags[own_rows] >> b & 1
        k += 2 * len(_GROUPS) + _BITS
        for i in range(HASHES):
            x[:, k + i] = tokens[own_rows] >> i & 1
            x[:, k + HASHES + i] = under[own_rows] >> i & 1
        for i, column in enumerate(rest):
            x[:, len(FEATURES) - len(rest) + i] = column[own_rows]
        yield x


def decode(t: Tree, odds: list[float]) -> list[bool]:
    """The likeliest choice in which whatever is kept has a kept parent."""
    n = len(odds)
    # gain of keeping an element with the best choice below it, over dropping its whole subtree
    gain = list(odds)
    parent = t.parent
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[parent[i]] and gain[i] > 0
    return keep


def text_of(t: Tree, keep: list[bool]) -> str:
    """Kept text by blocks; what is dropped between two texts of a block leaves nothing behind."""
    out: list[str] = []
    held: list[str] = []
    block = -1
    for i, b, text in t.chunks:
        if keep[i]:
            if b != block and held:
                out.append(" ".join("".join(held).split()))
                held = []
            block = b
            held.append(text)
    if held:
        out.append(" ".join("".join(held).split()))
    return "\n".join(x for x in out if x)


def extract(pages: Iterable[str | None], model: Trees) -> list[str]:
    """The text of each page; pages are read together until they have ELEMENTS elements, so memory follows the largest page."""
    out: list[str] = []
    trees: list[Tree] = []

    def judge() -> None:
        odds = np.clip(np.concatenate([model.log_odds(x) for x in feature_blocks(trees)]), -12, 12)
        at = 0
        for t in trees:
            own = odds[at : at + len(t.parent)].tolist()
            at += len(own)
            out.append(text_of(t, decode(t, own)))
        trees.clear()

    held = 0
    for p in pages:
        trees.append(parse(p or ""))
        held += len(trees[-1].parent)
        if held >= ELEMENTS:
            judge()
            held = 0
    if trees:
        judge()
    return out


# --- training pages -------------------------------------------------------------------------------

NAMELESS = 0.2
_SYLLABLES = "an ber che den er fa go hin is ka lo men nor or pra que ri sa ti un ver wo xe ya zu éa ñi ü".split()


def _phrase(r: _Maker, low: int, high: int) -> str:
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3)))) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + r.choice((".", ".", ".", "!", "", "?"))


class _Maker(random.Random):
    """Makes pages; ``nameless`` tells whether the names of a page's elements mean nothing."""

    nameless = False


def _names(r: _Maker, group: str) -> str:
    word = "".join(r.choice(_SYLLABLES) for _ in range(3)) if r.nameless else r.choice(LEXICON[group])
    word = r.choice((word, word, f"{word}-{r.choice(('box', 'wrap', 'block', 'area', 'list', '1', 'inner'))}", f"site-{word}", f"{word}{r.randint(1, 9)}" if len(word) > 3 else word, f"js-{word} {word}"))
    return r.choice((f' class="{word}"', f' id="{word}"', f" class='{word}'", f' class={word.split()[0]}', f' class="{word}" role="{r.choice(("group", "region", "complementary"))}"'))


def _links(r: _Maker, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_phrase(r, 1, 3)}</a></li>' for i in range(n))


def _junk(r: _Maker) -> str:
    """A piece of page that is no article."""
    kind = r.choice(("nav", "nav", "header", "footer", "side", "ad", "ad", "notice", "form", "comment", "share", "crumbs", "plain", "table"))
    text = lambda low=1, high=30: _phrase(r, low, high)
    ps = lambda a, b, low=2, high=30: "".join(f"<p>{text(low, high)}</p>" for _ in range(r.randint(a, b)))
    if kind == "nav":
        body = r.choice((f"<ul>{_links(r, r.randint(2, 9))}</ul>", " | ".join(f'<a href="#">{text(1, 2)}</a>' for _ in range(r.randint(2, 6)))))
        return r.choice((f"<nav>{body}</nav>", f"<nav{_names(r, 'nav')}>{body}</nav>", f"<div{_names(r, 'nav')}>{body}</div>", f"<ul{_names(r, 'nav')}>{_links(r, r.randint(2, 8))}</ul>"))
    if kind in ("header", "footer"):
        body = r.choice((text(1, 8), f"<p>{text(2, 14)}</p>", f"<h2>{text(1, 3)}</h2><a href='/'>{text(1, 2)}</a>", f"&copy; 2024 {text(1, 9)}", f"<ul>{_links(r, r.randint(1, 4))}</ul>{text(1, 6)}"))
        return r.choice((f"<{kind}>{body}</{kind}>", f"<{kind}{_names(r, 'frame')}>{body}</{kind}>", f"<div{_names(r, 'frame')}>{body}</div>"))
    if kind == "side":
        body = r.choice((f"<h3>{text(1, 3)}</h3><ul>{_links(r, r.randint(2, 7))}</ul>", ps(1, 3), text(3, 30), f"<h4>{text(1, 4)}</h4>{ps(1, 2)}"))
        return r.choice((f"<aside>{body}</aside>", f"<aside{_names(r, 'side')}>{body}</aside>", f"<div{_names(r, 'side')}>{body}</div>", f"<section{_names(r, 'side')}>{body}</section>"))
    if kind in ("ad", "notice"):
        body = r.choice((text(2, 40), text(2, 40), ps(1, 2, 2, 40), f'<a href="//x">{text(1, 10)}</a>', f"<p>{text(3, 20)}</p><button>{text(1, 2)}</button>", f"<span>{text(2, 12)}</span>"))
        tag = r.choice(("div", "div", "section", "p", "aside", "span"))
        return f"<{tag}{_names(r, kind)}>{body}</{tag}>"
    if kind == "form":
        body = f"<label>{text(1, 3)}</label><input name=q><button>{text(1, 2)}</button>" + r.choice(("", f"<p>{text(2, 12)}</p>"))
        return r.choice((f"<form>{body}</form>", f"<form{_names(r, 'form')}>{body}</form>", f"<div{_names(r, 'form')}><form>{body}</form></div>", f"<div{_names(r, 'form')}><p>{text(2, 15)}</p>{body}</div>"))
    if kind == "comment":
        one = lambda: r.choice((f"<p>{text(2, 40)}</p>", f"<b>{text(1, 2)}</b> {text(2, 40)}", f'<a href="#">{text(1, 1)}</a><p>{text(2, 40)}</p><p>{text(1, 20)}</p>'))
        tag = r.choice(("div", "li", "article", "section"))
        body = "".join(f"<{tag}{_names(r, 'comment') if r.random() < 0.7 else ''}>{one()}</{tag}>" for _ in range(r.randint(1, 6)))
        if tag == "li":
            body = f"<{r.choice(('ul', 'ol'))}>{body}"
        outer = r.choice(("div", "section", "aside"))
        return f"<{outer}{_names(r, 'comment')}><h3>{text(1, 3)}</h3>{body}</{outer}>"
    if kind == "share":
        return f"<div{_names(r, 'share')}>{r.choice((text(1, 6), f'<ul>{_links(r, r.randint(1, 4))}</ul>'))}</div>"
    if kind == "crumbs":
        return f"<div{_names(r, 'nav')}>" + " &gt; ".join(f'<a href="#">{text(1, 2)}</a>' for _ in range(3)) + "</div>"
    if kind == "table":
        return f"<table{_names(r, 'nav')}><tr>" + "".join(f'<td><a href="#">{text(1, 2)}</a></td>' for _ in range(4)) + "</tr></table>"
    return f"<div><ul>{_links(r, r.randint(4, 10))}</ul></div>"


def _article(r: _Maker) -> str:
    """Blocks of an article; marked by the attribute data-keep on its elements that hold text."""
    k = " data-keep"
    out = [f"<h1{k}>{_phrase(r, 1, 12)}</h1>"] if r.random() < 0.8 else []
    if out and r.random() < 0.15:
        out = [f"<header{k}>{out[0]}</header>"]
    for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
        x = r.random()
        text = _phrase(r, 1, r.choice((2, 4, 8, 30, 120)))
        if x < 0.62:
            out.append(f"<p{k}>{text}</p>")
        elif x < 0.7:
            out.append(f"<p{k}><b{k}>{text}<br>")
        elif x < 0.76:
            out.append(f"<p{k}>{text} <a{k} href='#'>{_phrase(r, 1, 4)}</a> {text[:40]}</p>")
        elif x < 0.82:
            out.append(f"<h{(n := r.randint(2, 4))}{k}>{_phrase(r, 1, 6)}</h{n}>")
        elif x < 0.87:
            out.append(f"<ul{k}>" + "".join(f"<li{k}>{_phrase(r, 1, 14)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif x < 0.9:
            out.append(f"<blockquote{k}>{r.choice((text, f'<p{k}>{text}</p>'))}</blockquote>")
        elif x < 0.93:
            out.append(f"<div{k}>{text}</div>")
        elif x < 0.95:
            out.append(f"<table{k}>" + "".join(f"<tr{k}>" + "".join(f"<td{k}>{_phrase(r, 1, 4)}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
        elif x < 0.97:
            out.append(f"<pre{k}>{text}</pre>")
        else:
            out.append(_junk(r))
    return "".join(out)


def training_pages(n: int, seed: int = 11) -> list[str]:
    """Made-up pages; the elements with the attribute data-keep hold the article."""
    r, out = _Maker(seed), []
    for _ in range(n):
        # on some pages nothing but the structure tells what is what
        r.nameless = r.random() < NAMELESS
        around = lambda a, b: "".join(_junk(r) for _ in range(r.randint(a, b)))
        body = _article(r)
        x = r.random()
        if x < 0.4:
            body = f"<article data-keep{_names(r, 'article') if r.random() < 0.4 else ''}>{body}{_junk(r) if r.random() < 0.2 else ''}</article>"
        elif x < 0.55:
            body = f"<main data-keep>{around(0, 1)}{body}{around(0, 1)}</main>"
        elif x < 0.9:
            body = f"<{(tag := r.choice(('div', 'div', 'section')))} data-keep{_names(r, 'article')}>{body}{_junk(r) if r.random() < 0.2 else ''}</{tag}>"
        else:
            body = f"<div data-keep>{body}</div>"
        for _ in range(r.choice((0, 0, 1, 2))):
            tag, name = r.choice(("div", "main", "section")), r.choice(("", ' class="wrapper"', ' id="page"', ' class="container row"', ' class="layout-2"'))
            body = f"<{tag} data-keep{name}>{around(0, 2)}{body}{around(0, 2)}</{tag}>"
        out.append(f"<html data-keep><head><title>{_phrase(r, 1, 5)}</title><style>p{{}}</style></head><body data-keep>{around(0, 4)}{body}{around(0, 4)}</body></html>")
    return out


def labels_of(page: str) -> tuple[Tree, np.ndarray]:
    """The tree of a training page without its marks, and which elements are marked."""
    # the marks are read as a lexicon-free attribute: same tree, so elements correspond
    marked = [" data-keep" in a for _, _, slash, name, a in tags(page) if name and not slash and name not in RAW | VOID]
    t = parse(page.replace(" data-keep", ""))
    keep = np.array([True, *marked])
    if len(keep) != len(t.parent):
        raise ValueError("marks and elements differ")
    return t, keep


@lru_cache(maxsize=1)
def trained(n: int = 1200) -> Trees:
    pairs = [labels_of(p) for p in training_pages(n)]
    x = features([t for t, _ in pairs])
    return Trees(depth=5, rounds=60).fit(x, np.concatenate([k for _, k in pairs]).astype(float))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to (page_id, url, text, n_chars), a row for each row."""
    small_batches(pages.sparkSession)
    # 60 trees of 31 splits: a size that does not grow
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract((x.as_py() for x in batch.column(2)), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
