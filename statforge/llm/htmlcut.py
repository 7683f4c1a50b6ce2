"""Main text of web pages by minimum cut.

A page becomes a row of text blocks. A linear classifier over block features gives each block a cost
for being called content and one for being called boilerplate; they are capacities to the two
terminals. Neighbouring blocks are tied by capacities that fall with their distance in the DOM, and so
are blocks of one parent with others between them. The minimum cut, from blocking flows, labels the
blocks with the least total cost: what tells of itself what it is decides about what doesn't.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|<(script|style|iframe|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_HINT = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements that go with all they hold, if they are closed; markup inside is like any other.
_SKIPPED = {t: re.compile(rf"</{t}\s*>", re.I) for t in "template svg select button annotation annotation-xml".split()}
#: Tags that leave a block as it is, tags without an end, and tags that close an open one.
INLINE = frozenset("a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Tags and names in class, id, role or itemprop that speak for boilerplate or for content. A doubtful
#: name may as well be what an article is about. A name of several words speaks if all its other words are plain.
BOILER_TAGS = frozenset("nav footer aside form menu dialog head fieldset".split())
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal newsletter subscribe sidebar breadcrumb breadcrumbs pagination pager menu navbar nav navigation topbar footer masthead comment comments commentlist disqus complementary contentinfo".split())
DOUBTFUL_WORDS = frozenset("banner promotion promoted notification notifications alert overlay subscription signup login widget widgets related recommended recommendations share sharing social toolbar respond reply replies discussion form search skip copyright legal tags tagcloud".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_WORDS = frozenset("article articlebody content post entry story main body".split())
PLAIN_WORDS = frozenset("page site global primary secondary top bottom left right list box bar wrap wrapper container inner outer block area section item items link links icon icons unit slot row col column columns text posts stories articles panel module group button buttons btn count header title js".split())
#: Weights of the classifier, in capacity units: bias, then the features of a block.
BIAS, BOILER, CONTENT, PAGE_HEADER, LINKS, LONG, SHORT, PARAGRAPH, HEADING = -4, -60, 24, -40, -30, 12, -4, 8, 4
#: A doubtful name, inside an article and elsewhere: within one it doesn't outweigh a paragraph.
DOUBTFUL, DOUBTFUL_OUTSIDE = -30, -60
#: Capacity between neighbours at DOM distance 0, and what each step takes from it.
TIE, STEP = 9, 3
#: Capacity between blocks next to each other among their parent's, if other blocks come between.
SIBLINGS = 4


class Block:
    """depth: open elements around it; shared: how many of them, from the root, the block before has as well;
    home: the numbers of the element that holds its own element, and of the one that holds that."""

    __slots__ = ("boiler", "content", "depth", "doubtful", "header", "home", "links", "shared", "size", "tag", "text")

    def __init__(self, text, links, depth, shared, home, kinds, tag):
        self.text, self.links, self.depth, self.shared, self.home, self.tag = text, links, depth, shared, home, tag
        self.boiler, self.doubtful, self.content, self.header = kinds
        self.size = len(text)


def _names(attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether a name speaks for boilerplate, doubtfully so, for content, or for a header."""
    boiler = doubtful = content = header = False
    for m in _HINT.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").split():
            words = {w.lower() for w in _WORDS.findall(name)} | {name.lower()}
            parts = {w for w in words if not w.isdigit()} - ({name.lower()} if len(words) > 1 else set())
            whole = name.lower()
            spoken = lambda known, among: whole in known or bool(parts & known) and parts <= among  # noqa: B023, E731
            if spoken(BOILER_WORDS, BOILER_WORDS | DOUBTFUL_WORDS | CONTENT_WORDS | PLAIN_WORDS):
                boiler = True
            elif spoken(DOUBTFUL_WORDS, DOUBTFUL_WORDS | CONTENT_WORDS | PLAIN_WORDS):
                doubtful = True
            elif spoken(CONTENT_WORDS, CONTENT_WORDS | PLAIN_WORDS):
                content = True
            elif whole == "header" or "header" in parts and parts <= PLAIN_WORDS:
                header = True
    return boiler, doubtful, content, header


def _kind(tag: str, attrs: str) -> tuple[int, int, int, int]:
    """(boilerplate, doubtful, content, page header) of a container. A heading's names are its anchors, and those of
    the whole page say nothing."""
    if tag in BOILER_TAGS:
        return 1, 0, 0, 0
    if tag in CONTENT_TAGS:
        return 0, 0, 1, 0
    if tag in ("body", "html") or tag[0] == "h" and tag[1:].isdigit() or "=" not in attrs:
        return 0, 0, 0, int(tag == "header")
    boiler, doubtful, content, header = _names(attrs)
    return int(boiler), int(doubtful), int(content and not boiler and not doubtful), int(header or tag == "header")


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; scripts, styles, comments and markup are gone."""
    out: list[Block] = []
    none = ("", 0, 0, 0, 0, 0)
    stack: list[tuple[str, int, int, int, int, int]] = []  # tag, the sums of the kinds so far, and the element's number
    parts: list[str] = []
    link = linked = shared = opened = 0
    unclosed: set[str] = set()

    def flush():
        nonlocal linked, shared
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                top = stack[-1] if stack else none
                home = stack[-2][5] if len(stack) > 1 else 0, stack[-3][5] if len(stack) > 2 else 0
                out.append(Block(text, min(linked, len(text)), len(stack), shared, home, top[1:5], top[0]))
                shared = len(stack)
        linked = 0

    def add(text):
        nonlocal linked
        parts.append(text)
        if link:
            linked += len(text.strip())

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            if m[1]:
                flush()
            continue
        tag = name.lower()
        if tag in _SKIPPED and not m[2]:
            if tag in ("template", "select"):
                flush()
            empty = tag == "svg" and m[4].endswith("/")
            end = None if empty or tag in unclosed else _SKIPPED[tag].search(page, at)
            if end:
                at = end.end()
            elif not empty:
                unclosed.add(tag)  # no later one is closed either
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if m[2] else 1
            elif tag in ("br", "img", "wbr"):
                parts.append("" if tag == "wbr" else " ")
            continue
        flush()
        link = 0
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    shared = min(shared, i)
                    break
            continue
        if tag in VOID or m[4].endswith("/"):
            continue
        closes = SELF_CLOSING.get(tag, ("p",) if tag not in ("html", "body") else ())
        while stack and stack[-1][0] in closes:
            stack.pop()
        shared = min(shared, len(stack))
        if tag in ("body", "article", "main") and any(x[0] == "head" for x in stack):
            shared = min(shared, next(i for i, x in enumerate([*stack, none]) if x[0] != "html"))
            stack = [x for x in stack if x[0] == "html"]
        b, d, c, h = _kind(tag, m[4])
        top = stack[-1] if stack else none
        opened += 1
        if c and tag in CONTENT_TAGS:
            h = -top[4]  # a header inside an article is the article's own
        stack.append((tag, top[1] + b, top[2] + d, top[3] + c, top[4] + (h if not (h > 0 and top[3]) else 0), opened))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def capacity(b: Block) -> int:
    """Above 0: a cost for calling the block boilerplate. Below: for calling it content."""
    out = BIAS + (BOILER if b.boiler else 0) + (CONTENT if b.content else 0) + (PAGE_HEADER if b.header > 0 else 0)
    out += (DOUBTFUL if b.content else DOUBTFUL_OUTSIDE) if b.doubtful else 0
    out += LINKS if b.links * 2 > b.size else 0
    out += LONG if b.size >= 120 else SHORT if b.size < 25 else 0
    out += PARAGRAPH if b.tag in ("p", "blockquote", "pre") else HEADING if b.tag in ("h1", "h2", "h3", "h4") else 0
    return out


def distance(a: Block, b: Block) -> int:
    """Steps in the DOM from the deeper of two neighbours to what is around both."""
    return max(a.depth, b.depth) - b.shared


def ties_of(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, capacity): neighbours by their distance; and over what lies between, blocks of one
    home, and blocks of one tag at one depth whose homes are siblings."""
    out = [(i, i + 1, TIE - STEP * distance(found[i], found[i + 1])) for i in range(len(found) - 1)]
    last: dict[tuple, int] = {}
    for i, b in enumerate(found):
        keys = (b.home[0],), (b.tag, b.depth, b.home[1])
        before = {j for k in keys if (j := last.get(k)) is not None and j < i - 1}
        out += [(j, i, SIBLINGS) for j in before]
        last.update(dict.fromkeys(keys, i))
    return [t for t in out if t[2] > 0]


def minimum_cut(costs: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut. costs > 0: capacity from the source;
    < 0: to the sink. ties: (i, j, capacity), both ways.

    In each phase the nodes get their distances from the source, and paths that lengthen by one step at a
    time fill until none is left; a node's edges are looked at once in a phase."""
    n = len(costs)
    left = [max(c, 0) for c in costs]
    room = [max(-c, 0) for c in costs]
    near: list[list[int]] = [[] for _ in range(n)]  # edge e leads to ends[e]; e ^ 1 leads back
    ends: list[int] = []
    free: list[int] = []
    for i, j, c in ties:
        if c > 0:
            near[i].append(len(ends))
            near[j].append(len(ends) + 1)
            ends += [j, i]
            free += [c, c]
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if left[i]]
        for i in queue:
            level[i] = 0
        reached = False
        for i in queue:
            reached = reached or room[i] > 0
            for e in near[i]:
                if free[e] and level[ends[e]] < 0:
                    level[ends[e]] = level[i] + 1
                    queue.append(ends[e])
        if not reached:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in queue:
            if level[start]:
                break
            path: list[int] = []
            i = start
            while left[start]:
                if room[i]:
                    flow = min(left[start], room[i], *(free[e] for e in path)) if path else min(left[start], room[i])
                    left[start] -= flow
                    room[i] -= flow
                    for e in path:
                        free[e] -= flow
                        free[e ^ 1] += flow
                    path, i = [], start
                    continue
                while at[i] < len(near[i]):
                    e = near[i][at[i]]
                    if free[e] and level[ends[e]] == level[i] + 1:
                        break
                    at[i] += 1
                else:
                    if not path:
                        break
                    i = ends[path.pop() ^ 1]
                    at[i] += 1
                    continue
                path.append(e)
                i = ends[e]


def labels(found: list[Block]) -> list[bool]:
    """True for content, by the minimum cut."""
    costs = [capacity(b) for b in found]
    if not any(c > 0 for c in costs):
        return [False] * len(found)
    return minimum_cut(costs, ties_of(found)) if any(c < 0 for c in costs) else [True] * len(found)


def main_text(page: str | None) -> str:
    """The main text: content blocks joined by two line ends; empty if there are none."""
    found = blocks_of(page) if page else []
    return "\n\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row.

    A null or empty page, or one without content, has an empty text. Formulas, objects, canvases and what stands for
    scripts are text like any other. Malformed markup is read as far as it
    goes: what isn't closed ends with the page, and elements that go with what they hold do so only if they
    are closed. Very long pages are taken whole. Repeated rows and null ids are treated like any other; an
    empty table gives no rows. Other columns are ignored."""

    def extract(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
