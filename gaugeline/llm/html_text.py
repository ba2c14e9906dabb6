"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into text blocks at block-level tags.  Each block gets a cost for being called
content and one for being called boilerplate (its place in the document, names of its
ancestors, links, length); these are capacities to the two terminals.  Neighbouring blocks
and blocks near each other in the tree are joined by smoothness edges.  The minimum cut,
found by blocking flows over level graphs, gives the labels.  Navigation, footers and the
like are certain; names of elements have finite costs, which neighbours can outweigh.  Pages
are independent: one Spark task labels its rows.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template svg iframe head title textarea select".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr math mi mn mo mrow ms msqrt mstyle msub msubsup msup mtext".split()
)
BOILER_TAGS = frozenset("nav footer aside button menu dialog".split())
FORM_TAGS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
#: Names in class, id and role that speak against or for an element.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social follow related recommended recommendations sidebar aside widget widgets nav navbar navigation "
    "menu breadcrumb breadcrumbs footer header masthead topbar toolbar pagination pager comment comments disqus "
    "respond reply replies copyright legal disclaimer search complementary contentinfo skip tags".split()
)
GOOD_NAMES = frozenset("article content entry post story main body text maintext articlebody".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
#: Names that tell what else is on the page, such as has-sidebar.
_ABOUT = re.compile(r"(?:has|with|no|without|is|js)[-_][\w-]*", re.I)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_OPEN = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?][^>]*", re.S)
_HIDDEN_ATTRIBUTE = re.compile(r"""\bhidden(?=[\s=>/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPACE = re.compile(r"\s+")
#: Nearness in the tree looks at this many open elements from the root.
LEVELS = 64


@dataclass
class Block:
    path: tuple[int, ...]
    sure: bool
    against: int
    form: int
    inside: bool
    good: bool
    kind: str
    text: list[str] = field(default_factory=list)
    linked: int = 0

    @functools.cached_property
    def joined(self) -> str:
        """The block's text; only asked for when the block is complete."""
        return _SPACE.sub(" ", html.unescape("".join(self.text))).strip()


def _named(attributes: str, tag: str, inside: bool) -> tuple[bool, bool]:
    """Whether names of an element speak against and for it.

    The id of a heading or section inside an article comes from its words and says nothing.
    """
    bad = good = False
    for kind, *found in _NAMES.findall(attributes):
        if kind.lower() == "id" and (tag in HEADINGS or (inside and tag in ("section", "p", "li", "a", "span"))):
            continue
        value = _ABOUT.sub(" ", "".join(found)) if kind.lower() == "class" else "".join(found)
        names = {x for x in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if x}
        bad |= bool(names & BAD_NAMES)
        good |= bool(names & GOOD_NAMES)
    return bad, good


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; markup may be unclosed or wrongly nested."""
    out: list[Block] = []
    # element: tag, its number, hidden, surely boilerplate, cost of names, outermost form, in article
    # or main, named as content, place of the nearest element that is not inline
    stack: list[tuple] = [("", 0, False, False, 0, 0, False, False, 0)]
    opened: Counter[str] = Counter()
    serial, at, current, size = 0, 0, None, len(page)
    links = 0

    def say(text: str) -> None:
        nonlocal current
        top = stack[-1]
        if top[2] or not text:
            return
        if current is None:
            outer = stack[top[8]]
            path = tuple(e[1] for e in stack[:LEVELS] if e[0] not in INLINE)
            current = Block(path, *outer[3:8], outer[0])
            out.append(current)
        current.text.append(text)
        if links:
            current.linked += len(text.strip())

    def cut(depth: int) -> None:
        nonlocal links
        for e in stack[depth:]:
            opened[e[0]] -= 1
            links -= e[0] == "a"
        del stack[depth:]

    last = page.rfind(">")
    while at < size:
        # without an end of a tag to come, only comments and declarations are left to find
        found = (_TOKEN if at <= last else _OPEN).search(page, at)
        if found is None:
            say(page[at:])
            break
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        if found.re is _OPEN or not found[2]:
            continue
        tag, closing, attributes = found[2].lower(), bool(found[1]), found[3]
        if tag not in INLINE:
            current = None
        if closing:
            if not opened[tag]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    cut(depth)
                    break
                if stack[depth][0] not in INLINE and tag in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in CLOSES_P or tag == "li":
            close = "li" if tag == "li" else "p"
            for depth in range(len(stack) - 1, 0, -1) if opened[close] else ():
                if stack[depth][0] == close:
                    cut(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        serial += 1
        _, _, hidden, sure, against, form, inside, good, outer = stack[-1]
        bad_name, good_name = _named(attributes, tag, inside) if "=" in attributes else (False, False)
        root = tag in ("article", "main")
        main = root or (good_name and not bad_name)
        sure = sure or tag in BOILER_TAGS or (tag == "header" and not inside)
        hidden = hidden or tag in HIDDEN or bool(attributes and _HIDDEN_ATTRIBUTE.search(attributes))
        if root and not inside:  # wrappers above say little about an article
            against, form = min(against, NAMED_ABOVE), 0
        if bad_name and not good_name and tag not in ("html", "body") and not (root and not inside):
            against += NAMED
        if tag in FORM_TAGS and not form:
            form = serial
        stack.append(
            (
                tag, serial, hidden, sure, against, form, inside or root, good or main,
                outer if tag in INLINE else len(stack),
            )
        )
        opened[tag] += 1
        links += tag == "a"
    return [b for b in out if b.joined]


#: Capacity that no sum of edges reaches.
CERTAIN = 10_000
#: Costs of an element's name, of such names above an article, and of a form.
NAMED, NAMED_ABOVE, FORM = 180, 40, 180
ADJACENT, NEARNESS = 12, 24


@dataclass
class Page:
    """What the blocks of a page have in common: whether it has a main part, and page-wide forms."""

    main: bool
    wide: frozenset[int]

    @staticmethod
    def of(found: list[Block]) -> Page:
        inside = outside = 0
        forms: Counter[int] = Counter()
        for b in found:
            if not b.sure:
                forms[b.form] += len(b.joined)
                if b.against < NAMED:
                    inside += len(b.joined) * (b.inside or b.good)
                    outside += len(b.joined) * (not (b.inside or b.good))
        # a form with most of the text is a wrapper, and a main part with little text is none
        total = sum(forms.values())
        return Page(4 * inside >= max(outside, 1), frozenset(f for f, n in forms.items() if f and 2 * n > total))


def costs(block: Block, page: Page) -> int:
    """Cost of calling a block boilerplate minus that of calling it content."""
    text = block.joined
    if block.sure:
        return -CERTAIN
    score = -block.against
    if block.form and block.form not in page.wide:
        score -= FORM
    if page.main:
        score += 60 if block.inside or block.good else -60
    elif block.good:
        score += 40
    linked = block.linked / max(len(text), 1)
    score += min(len(text), 200) // 8 - 8
    score += 10 if re.search(r"[.!?…。]", text) else -4
    score -= round(50 * linked)
    if block.kind in ("p", "h1", "h2", "h3", "blockquote", "pre"):
        score += 10
    elif not block.kind:  # text outside of any element
        score += 20
    if re.match(r"(?:©|\(c\)|copyright)", text, re.I):
        score -= 60
    return score


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, capacity): next blocks, stronger the more ancestors they share."""
    out = []
    for gap in (1, 2):
        for i in range(len(found) - gap):
            a, b = found[i].path, found[i + gap].path
            shared = sum(x == y for x, y in zip(a, b, strict=False))
            near = shared / max(len(a), len(b), 1)
            weight = round((ADJACENT * (gap == 1) + NEARNESS * near * near) / gap)
            if weight:
                out.append((i, i + gap, weight))
    return out


def minimum_cut(unary: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Labels (True: content) of a minimum cut; among several the one with least content.

    ``unary[i]`` is the capacity from the content terminal when positive and to the
    boilerplate terminal when negative.  Blocking flows over level graphs: each round raises
    the distance of the terminals, so rounds are few where edges reach only to the next blocks.
    """
    n = len(unary)
    source, sink = n, n + 1
    ends: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(ends))
        out[b].append(len(ends) + 1)
        ends.extend((b, a))
        room.extend((there, back))

    for i, u in enumerate(unary):
        if u:
            join(source if u > 0 else i, i if u > 0 else sink, abs(u), 0)
    for i, j, w in links:
        join(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in out[a]:
                if room[e] and level[ends[e]] < 0:
                    level[ends[e]] = level[a] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not room[e])
                at = ends[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[at] < len(out[at]):
                e = out[at][tried[at]]
                if room[e] and level[ends[e]] == level[at] + 1:
                    path.append(e)
                    at = ends[e]
                    break
                tried[at] += 1
            else:
                if not path:
                    break
                at = ends[path.pop() ^ 1]
                tried[at] += 1


def labels(unary: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of the minimum cut; certain blocks are terminals of their own and leave the graph."""
    place, free = {}, []
    for i, u in enumerate(unary):
        if abs(u) < CERTAIN:
            place[i] = len(free)
            free.append(u)
    inner = []
    for i, j, w in links:
        if i in place and j in place:
            inner.append((place[i], place[j], w))
        elif i in place or j in place:
            known, other = (j, i) if i in place else (i, j)
            free[place[other]] += w if unary[known] > 0 else -w
    found = minimum_cut(free, inner)
    return [found[place[i]] if i in place else u > 0 for i, u in enumerate(unary)]


def main_text(page: str | None) -> str:
    """Text of the blocks labelled content, in page order, joined by one space."""
    found = blocks(page or "")
    whole = Page.of(found)
    chosen = labels([costs(b, whole) for b in found], edges(found))
    return " ".join(b.joined for b, content in zip(found, chosen, strict=True) if content)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null, empty and text-free pages give an empty text; html without tags is one block.
    Ids and urls are passed on as they are, null or repeated; other columns are not read.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(work, rows.drop("html").schema.add("text", "string").add("n_chars", "long"))
