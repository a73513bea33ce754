"""Main text of web pages by a minimum cut: what each block looks like, against what its neighbours are.

A page becomes a line of text blocks. Evidence for content is the capacity of an edge from the source to a block, evidence for
boilerplate that of an edge to the sink: a block on the wrong side of the cut costs its evidence. Edges between neighbouring
blocks, stronger the closer they are in the tree, cost what it takes to label them apart. A maximal flow gives
the cheapest labelling of the whole page; the blocks that the source still reaches are its main text.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import map_texts

#: Elements whose text is never part of a page's text.
SKIPPED = frozenset("script style template noscript svg math title select option textarea button iframe object canvas".split())
#: Elements that end the block before them and begin one.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html head legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold boilerplate.
OUTER = frozenset("nav footer aside form menu dialog fieldset".split())
INNER = frozenset("article main".split())
#: Parts of class, id and role names that mark boilerplate or content.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead topbar footer sidebar aside cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup signin login register social share sharing related recommended recommendations "
    "trending comment comments disqus reply replies respond discussion widget toolbar copyright legal disclaimer form search tags "
    "pagination pager skip contentinfo complementary outbrain taboola paywall feedback".split()
)
GOOD_NAMES = frozenset("article content post entry story main body text prose".split())
#: Parts of names that say what a frame around other things has, as in `layout with-sidebar` or `content has-comments`.
FRAME_NAMES = frozenset("with without has no layout wrapper wrap container frame page site".split())
STRONG, PLACE, WEAK = 12.0, 4.0, 1.0
NEAR, SIBLING, FAR = 1.0, 0.5, 0.25
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


class Block:
    __slots__ = ("parts", "linked", "tag", "place", "bad", "good", "text")

    def __init__(self, tag: str, place: tuple[int, int, int], bad: float, good: float):
        self.parts, self.linked, self.tag, self.place, self.bad, self.good, self.text = [], 0, tag, place, bad, good, ""


class Page(HTMLParser):
    """Collects the blocks of a page; forgives tags that are not closed or closed twice."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        #: tag, number, own evidence against and for, the greatest of those of it and all around it
        self.open: list[tuple[str, int, float, float, float, float]] = []
        self.around: list[tuple[int, str]] = [(0, "")] * 3  # number and tag of the open elements that make blocks
        self.opened: Counter[str] = Counter()
        self.count = self.skipping = self.links = 0
        self.block: Block | None = None
        self.inner = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.block = None
            self._close_implied(tag)
        elif tag in ("br", "td", "th", "img") and self.block:
            self.block.parts.append(" ")
        if tag in VOID:
            return
        self.count += 1
        if tag in INNER and self.opened["form"]:  # a form around an article is the page's frame, no form to fill in
            held, self.open = self.open, []
            for name, number, bad, good, *_ in held:
                self._push(name, number, 0.0 if name == "form" else bad, good)
        bad, good = self._evidence(tag, dict(attrs))
        self._push(tag, self.count, bad, good)
        self.opened[tag] += 1
        if tag in BLOCKS:
            self.around.append((self.count, tag))
        self.skipping += tag in SKIPPED
        self.links += tag == "a"
        self.inner = self.inner or tag in INNER

    def _push(self, tag: str, number: int, bad: float, good: float) -> None:
        most = self.open[-1][4:] if self.open else (0.0, 0.0)
        self.open.append((tag, number, bad, good, max(bad, most[0]), max(good, most[1])))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block = None
        if self.opened[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.skipping or (self.block is None and not data.strip()):
            return
        if self.block is None:
            most = self.open[-1][4:] if self.open else (0.0, 0.0)
            place = tuple(number for number, _ in self.around[:-4:-1])
            self.block = Block(self.around[-1][1], place, *most)
            self.blocks.append(self.block)
        self.block.parts.append(data)
        self.block.linked += len(data.strip()) if self.links else 0

    def _close_implied(self, tag: str) -> None:
        if tag == "body":
            while self.opened["head"]:
                self._pop()
        closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",)}.get(tag, ()) + ("p",)
        for n in range(len(self.open) - 1, -1, -1):
            name = self.open[n][0]
            if name in closes:
                while len(self.open) > n:
                    self._pop()
            elif name in BLOCKS:
                break

    def _pop(self) -> str:
        tag = self.open.pop()[0]
        self.opened[tag] -= 1
        if tag in BLOCKS:
            self.around.pop()
        self.skipping -= tag in SKIPPED
        self.links -= tag == "a"
        return tag

    def _evidence(self, tag: str, attrs: dict[str, str | None]) -> tuple[float, float]:
        bad = good = 0.0
        if tag in OUTER or (tag == "header" and not any(self.opened[t] for t in INNER)):
            bad = STRONG
        if tag in INNER:
            good = PLACE
        if tag in ("html", "body"):
            return bad, good
        names = " ".join(filter(None, (attrs.get("class"), attrs.get("id"), attrs.get("role"))))
        if names:
            parts = {p.lower() for p in NAME.findall(names)}
            if parts & BAD_NAMES and tag not in INNER:
                bad = max(bad, WEAK if parts & FRAME_NAMES else STRONG)
            elif parts & GOOD_NAMES:
                good = max(good, PLACE / 2)
        style = (attrs.get("style") or "").replace(" ", "").lower()
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            bad = STRONG
        return bad, good


def evidence(block: Block, has_inner: bool) -> tuple[float, float]:
    """(for content, for boilerplate) of a block."""
    size = len(block.text)
    good, bad = block.good, block.bad
    if has_inner and block.good < PLACE:
        bad += PLACE
    good += WEAK * (block.tag in ("p", "blockquote", "pre")) + 2 * WEAK * (block.tag == "h1")
    good += WEAK * (size > 80) + 0.5 * WEAK * (block.text[-1:] in ".!?")
    bad += 0.5 * WEAK * (size < 25) + 3 * WEAK * (block.linked > 0.6 * size)
    return good, bad


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow each other or are close in the tree, with what it costs to part them.

    A block's place is its element, the one around that and the next; two steps in the tree are as far as these tell.
    """
    edges = []
    for i in range(1, len(blocks)):
        a, b = blocks[i - 1].place, blocks[i].place
        near = a[0] in b or b[0] in a or a[1] == b[1]
        edges.append((i - 1, i, NEAR if near else FAR))
        if i > 1 and blocks[i - 2].place[1] == b[1]:
            edges.append((i - 2, i, SIBLING))
    return edges


def source_side(terminals: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut. Flow goes along shortest paths, a level graph at a time."""
    n = len(terminals)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, (good, bad) in enumerate(terminals):
        even = min(good, bad)  # flows straight through
        if good > even:
            edge(source, i, good - even, 0.0)
        if bad > even:
            edge(i, sink, bad - even, 0.0)
    for a, b, cost in edges:
        edge(a, b, cost, cost)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn, path, at = [0] * (n + 2), [], source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, at = [], source
                continue
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                turn[at] += 1
            else:
                if at == source:
                    break
                at = to[path.pop() ^ 1]
                turn[at] += 1
                continue
            path.append(e)
            at = to[e]


def main_text(html: str) -> str:
    """Text of the content blocks in page order, white space in a block as one space, blocks apart by an empty line."""
    page = Page()
    page.feed(html)
    page.close()
    for block in page.blocks:
        block.text = " ".join("".join(block.parts).split())
    blocks = [b for b in page.blocks if b.text]
    kept = source_side([evidence(b, page.inner) for b in blocks], smoothness(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``keep``, text and n_chars of every page.

    Null and empty pages, and pages without content, have an empty text. Blocks of equal evidence count as boilerplate.
    Repeated rows stay; an empty table gives an empty result.
    """

    def work(found: list[str]) -> list[dict]:
        return [{"text": t, "n_chars": len(t)} for t in map(main_text, found)]

    return map_texts(pages, keep, html, work, "text string, n_chars long")
