"""Main-text extraction from HTML by tag-path ratios.

A page's text falls into blocks, each under a path of tags from the root. Per path, text length and punctuation of all
its blocks are added up and divided by their number; both ratios are fused, smoothed over the blocks in page order and
held against a threshold taken from the page itself. Blocks that pass it are content; the container of the best path is
a prior that lowers it for the blocks inside, where an unbroken list counts as one text.

Elements that look like no part of an article, by tag or by the words in their class and id, are left out of the score.
Such a mark is evidence and no verdict: an element that holds nearly all of the page's text that is not marked otherwise
is a wrapper, and its mark is dropped (``unmarked``). A header's headings come back if they are in or on the way to the
container. Paths are numbers in a trie and all look-ups of open elements are by tag, so time is linear in the page,
however deep it is nested.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relstream.llm.common import steps, table

#: Tags whose content is no markup, void tags, tags that do not break a block, tags that are never article text.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br ruby rb rt rp".split()
)
NEVER = frozenset("head nav aside footer form button select option menu dialog object audio video canvas map fieldset".split())
#: Words in a class, id or role that mark an element as no part of the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner billboard breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus "
    "cookie cookies consent gdpr notice notices alert disclaimer nav navbar navigation menu menubar sidebar side aside widget widgets footer foot header masthead topbar "
    "toolbar promo promotion promoted sponsor sponsored share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal "
    "overlay pagination pager copyright legal skip search searchbox form contentinfo complementary discussion feedback reader-comments".split()
)
#: Marks of an element that may hold headings of the article, and first words of names that say what an element has, not what it is.
HEADERS = frozenset("header head masthead".split())
STATES = frozenset("has with without no".split())
#: Tags that never are wrappers, and marks that only are if an article, a main element or a first heading lies inside.
NO_WRAPPER = frozenset("head nav aside footer button select option menu dialog object audio video canvas map".split())
FIRM = frozenset("ad ads adv advert adverts advertisement comment comments commentlist reply replies disqus cookie cookies consent gdpr nav navbar menu footer reader-comments".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd".split())
#: An element is a wrapper if the text outside it, relative to that inside, is less than this.
OUTSIDE = 0.2
#: Share of the best path's ratio that a block inside its container needs; more than one neighbour's weight in smoothing.
INSIDE = 0.3
#: Elements that an opening block tag ends, as a paragraph's end tag may be left out.
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_START = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
_QUOTE_OR_END = re.compile("[\"'>]")
_COMMENT_END = re.compile("--!?>")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、¿¡'\"“”«»()-]")


class Block(NamedTuple):
    path: int
    text: str
    linked: int
    #: The innermost element around it.
    element: int = 0


@dataclass
class Page:
    """Blocks in page order; a trie of paths and a tree of elements, both as lists by number, parents before children."""

    blocks: list[Block] = field(default_factory=list)
    #: Of each path: its parent, its last tag, its depth, the nearest path of an article or main element it is in (-1: none).
    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    depth: list[int] = field(default_factory=lambda: [0])
    content: list[int] = field(default_factory=lambda: [-1])
    #: Of each element: its parent, its tag, and what marks it: words, "" for its tag alone, "!" for hidden; None if nothing does.
    above: list[int] = field(default_factory=lambda: [0])
    kind: list[str] = field(default_factory=lambda: [""])
    marks: list[frozenset[str] | None] = field(default_factory=lambda: [None])


def _marks(tag: str, attributes: str) -> frozenset[str] | None:
    """What says that an element is no part of the article."""
    found = {""} if tag in NEVER or tag == "header" else set()
    if attributes and tag not in ("html", "body"):
        for m in _NAMES.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").split():
                words = [w.lower() for w in _WORD.findall(name)]
                if words and words[0] not in STATES and (tag not in CONTENT or words[0] in ("comment", "comments", "reply")):
                    found.update(MARKS.intersection(words))
        if tag not in CONTENT and _HIDDEN.search(attributes):
            found.add("!")
    return frozenset(found) if found else None


def _tag_end(page: str, at: int) -> int:
    """The ``>`` that ends the tag at ``at``, not one in a quoted value; where quotes do not pair, the first one; -1 if none."""
    i = at
    while m := _QUOTE_OR_END.search(page, i):
        if m[0] == ">":
            return m.start()
        i = page.find(m[0], m.end()) + 1
        if not i:
            break
    return page.find(">", at)


def parse(page: str) -> Page:
    """Blocks of text with their paths, the length of their linked text and the elements they are in."""
    out = Page()
    paths: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, int]] = []  # tag, path, element; of inline elements only marked ones, always on top
    where: dict[str, list[int]] = {}  # places in the stack by tag
    held: list[str] = []
    linked = at = 0
    link: int | None = None  # height of the stack at an open link

    def last(tag: str) -> int:
        return where[tag][-1] if where.get(tag) else -1

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.blocks.append(Block(stack[-1][1] if stack else 0, text, linked, stack[-1][2] if stack else 0))
        linked = 0

    def push(tag: str, path: int, element: int) -> None:
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, path, element))

    def pop(k: int) -> None:
        nonlocal link
        while len(stack) > k:
            where[stack.pop()[0]].pop()
        if link is not None and link > k:
            link = None

    def close(k: int) -> None:
        flush()
        pop(k)

    while True:
        m = _START.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and not (stack and stack[-1][0] in INLINE):
            piece = html.unescape(piece)
            held.append(piece)
            if link is not None:
                linked += len(piece)
        if not m:
            break
        if m[2] is None:
            if m[0] == "<!--" and not page.startswith((">", "->"), m.end()):
                stop = _COMMENT_END.search(page, m.end())
                at = stop.end() if stop else len(page)
            else:
                at = page.find(">", m.end()) + 1 or len(page)
            continue
        stop = _tag_end(page, m.end())
        if stop < 0:
            break
        at, tag, attributes = stop + 1, m[2].lower(), page[m.end() : stop]
        if m[1]:
            if tag == "a":
                link = None
            k = last(tag)
            if tag in INLINE:
                if k >= 0:
                    pop(k)
            else:
                flush()
                if k >= 0:
                    close(k)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                stop = re.compile(rf"</{tag}(?![^\s/>])", re.I).search(page, at)
                at = (page.find(">", stop.end()) + 1 or len(page)) if stop else len(page)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag == "a":
            link = len(stack)
        if tag in INLINE:
            if attributes and _marks(tag, attributes):  # left out up to its end, or to the next block
                push(tag, *(stack[-1][1:] if stack else (0, 0)))
            continue
        while stack and stack[-1][0] in INLINE:
            pop(len(stack) - 1)
        if last("p") >= 0:
            close(last("p"))
        if tag in CLOSED_BY_SAME and last(tag) > max(map(last, CLOSED_BY_SAME[tag])):
            close(last(tag))
        flush()
        if tag in VOID:
            continue
        if tag == "body" and last("head") >= 0:  # a body ends whatever of the head is open
            close(last("head"))
        name = _NAMES.search(attributes) if attributes else None
        step = tag + ("." + (name[1] or name[2] or name[3] or "") if name else "")
        up = stack[-1][1] if stack else 0
        path = paths.get((up, step))
        if path is None:
            path = paths[up, step] = len(out.parent)
            out.parent.append(up)
            out.tag.append(tag)
            out.depth.append(out.depth[up] + 1)
            out.content.append(path if tag in CONTENT else out.content[up])
        out.above.append(stack[-1][2] if stack else 0)
        out.kind.append(tag)
        out.marks.append(_marks(tag, attributes))
        push(tag, path, len(out.kind) - 1)
    flush()
    return out


def unmarked(page: Page) -> list[bool]:
    """Of each element: whether it counts, that is, neither it nor an element around it is marked.

    A marked element that is no other one's inside is a wrapper if the text outside all such elements is less than
    OUTSIDE of the text in it, no article or main element that counts lies outside, and its tag and marks allow it; then
    it counts after all and those inside it are looked at. Elements with more text come first. Linked text is no text.
    """
    n = len(page.above)
    own, heads = [0] * n, [False] * n
    for b in page.blocks:
        own[b.element] += max(0, len(b.text) - b.linked)
    outer = [-1] * n  # the outermost marked element around each, itself included
    inner: list[list[int]] = [[] for _ in range(n)]  # marked elements with no other marked one between
    near = [-1] * n  # the innermost marked element around each, itself included
    mass = list(own)  # text in the element that is under no other marked one
    for e in range(1, n):
        up = page.above[e]
        near[e] = e if page.marks[e] is not None else near[up]
        outer[e] = outer[up] if outer[up] >= 0 else (e if page.marks[e] is not None else -1)
    for e in range(n - 1, 0, -1):
        up = page.above[e]
        heads[e] |= page.kind[e] in CONTENT or page.kind[e] == "h1"
        heads[up] |= heads[e]
        if page.marks[e] is None:
            mass[up] += mass[e]
    for e in range(1, n):
        if page.marks[e] is not None and outer[e] != e:
            inner[near[page.above[e]]].append(e)
    counts = [outer[e] < 0 for e in range(n)]
    article = any(counts[b.element] and page.content[b.path] >= 0 and len(b.text) > b.linked for b in page.blocks)
    outside = mass[0]
    todo = [(-mass[e], e) for e in range(1, n) if outer[e] == e]
    heapify(todo)
    wrappers = set()
    while todo and not article:
        size, e = heappop(todo)
        marks = page.marks[e]
        if -size <= 0 or outside >= OUTSIDE * -size:
            break
        if page.kind[e] in NO_WRAPPER or "!" in marks or marks & FIRM and not heads[e]:
            continue
        wrappers.add(e)
        outside -= size
        for x in inner[e]:
            heappush(todo, (-mass[x], x))
    for e in range(1, n):
        counts[e] = counts[page.above[e]] and (page.marks[e] is None or e in wrappers)
    return counts


def path_ratios(found: list[Block]) -> dict[int, float]:
    """Fused text and punctuation ratio of every path; linked text does not count."""
    sums: dict[int, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0] += max(0, len(b.text) - b.linked)
        s[1] += len(_PUNCTUATION.findall(b.text)) if b.linked < len(b.text) / 2 else 0
        s[2] += 1
    return {p: math.sqrt(n / c * (1 + marks / c)) for p, (n, marks, c) in sums.items()}


def smoothed(found: list[Block], ratio: dict[int, float]) -> np.ndarray:
    """The ratios of the blocks' paths in page order, each with a quarter of both neighbours'; the ends repeat themselves."""
    raw = np.array([ratio[b.path] for b in found])
    return np.convolve(np.r_[raw[:1], raw, raw[-1:]], [0.25, 0.5, 0.25], "valid")


def _container(page: Page, path: int) -> int:
    """The innermost article or main of a path, else the parent of its last step; of a list or table the parent of that."""
    if page.content[path] >= 0:
        return page.content[path]
    own = path
    while page.depth[own] > 1 and page.tag[own] in ("li", "ul", "ol", "td", "th", "tr", "tbody", "table", "blockquote", "dd", "dt", "dl"):
        own = page.parent[own]
    return page.parent[own] if page.depth[own] > 1 else path


def _list_ratios(page: Page, found: list[Block]) -> list[float]:
    """Per block: the ratio of the unbroken run of list items it is in, taken as one text; 0 for others."""
    out: list[float] = []
    for path, run in groupby(found, key=lambda b: b.path):
        own = list(run)
        item = page.tag[path] in ITEMS
        whole = Block(path, " ".join(b.text for b in own), sum(b.linked for b in own))
        out += [path_ratios([whole])[path] if item else 0.0] * len(own)
    return out


def extract(html_text: str | None) -> str:
    """The main text, blocks joined by newlines; empty for null, for pages without text and where all of it is marked."""
    page = parse(html_text) if html_text else Page()
    counts = unmarked(page)
    headers = _headers(page, counts)
    every = [b for b in page.blocks if counts[b.element] or headers[b.element] and page.tag[b.path] in HEADINGS]
    found = [b for b in every if counts[b.element]]
    if not found:
        return ""
    ratio = path_ratios(found)
    smooth = smoothed(found, ratio)
    mass: dict[int, float] = {}
    for b in found:
        mass[b.path] = mass.get(b.path, 0.0) + ratio[b.path] ** 2
    inside = {b.path for b in found if page.content[b.path] >= 0}
    best = max(inside or mass, key=lambda p: (mass[p], ratio[p], -p))
    home = _container(page, best)
    under, over, at = [False] * len(page.parent), set(), home
    for p in range(len(under)):
        under[p] = p == home or p > 0 and under[page.parent[p]]
    while at:
        over.add(at)
        at = page.parent[at]
    top = next((page.depth[p] for p in sorted(over) if page.tag[p] == "body"), 0)
    limit, low = max(0.5 * ratio[best], float(smooth.mean() + smooth.std())), INSIDE * ratio[best]
    keep = {}
    for b, s, u in zip(found, smooth, _list_ratios(page, found), strict=True):
        heading = page.tag[b.path] in HEADINGS
        if under[b.path]:
            keep[id(b)] = s >= low or u >= low or heading
        elif b.linked < len(b.text) / 2:
            far = page.parent[b.path] != page.parent[home]
            keep[id(b)] = s >= 0.5 * ratio[best] if page.content[b.path] >= 0 else s >= limit and far
    # headings on the way to the container belong to it, and those of headers in it
    for b in every:
        if page.tag[b.path] in HEADINGS and not keep.get(id(b)):
            way = page.parent[b.path]
            keep[id(b)] = under[b.path] if headers[b.element] else not inside and way in over and page.depth[way] > top
    return "\n".join(b.text for b in every if keep.get(id(b)))


def _headers(page: Page, counts: list[bool]) -> list[int]:
    """Of each element: 1 if it is not counted for nothing but a header around it, else 0."""
    out = [0] * len(counts)
    for e in range(1, len(counts)):
        up = page.above[e]
        if counts[e]:
            continue
        marks = page.marks[e]
        fine = marks is None or page.kind[e] == "header" and marks <= HEADERS | {""} or page.kind[e] != "header" and "" not in marks and marks <= HEADERS
        out[e] = int(fine and (counts[up] or out[up] > 0))
    return out


def main_text(page: Column) -> Column:
    """The main text of an HTML column, as ``extract`` gives it. Null, empty and textless pages give the empty text; pages of
    any length are read whole; equal pages give equal texts.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array([extract(p) for own in steps(x) for p in own], pa.string())

    return run(page)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text(F.col("html")).alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
