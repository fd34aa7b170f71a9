"""HTML main text by tag-path ratios.

A page is read as a sequence of text blocks, each with the path of block-level tags from
the root to it.  For every distinct path, text length and punctuation are summed over its
blocks and divided by their number.  Both ratios are smoothed over the paths in page
order with a short weighted mean, fused as length ratio * (1 + punctuation ratio), and
paths at or above a share of the page's weighted mean are content.  The container with
most content (the deepest path that holds over half of it) is the article, and all its
blocks belong to the text, so headings and short paragraphs aren't lost.

Before that, what cannot be article text is left out: scripts, styles, menus, footers and
hidden parts by tag or attribute, forms, headers and sidebars unless they hold the page's
main element or article, and parts whose class, id or role has one of the words MARKS
(adverts, notices, reader comments ...) unless they hold those elements or, on a page
without them, half of the text that stays.  The other words, HINTS, leave nothing out: a path through such an
element is a path of its own, its score is lowered, and it's no part of the article by
its place alone.  A class that speaks for the text makes a word of MARKS one of HINTS and
takes away a word of HINTS.  Blocks that consist of marked inline elements only are lowered
too; a marked inline element within a sentence is read with it.

Paths are numbered (a number for each pair of parent and tag), and open elements are found
by their name's own stack, so the time is linear in the page however deep its tags nest.

Defined results: null or empty html gives empty text and n_chars 0; unclosed, stray and
crossed tags close at their container's end; a self-closing element ends where it stands;
an element of raw content that is never closed ends at once, but for scripts and styles,
which run to the page's end; equal rows give equal results, and equal scores are treated
alike; a text of any length is read whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from nocturne.llm.textvec import pieces

_TOKEN = re.compile(
    r"<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>"
    r"|<[!?][^>]*+>|[^<]++|<",
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")

#: Block-level tags, tags that hold no article text, and words of class, id or role that mark such parts.
BLOCKS = frozenset(
    "html body div p article main section header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption form fieldset address details summary dialog hr center menu".split()
)
RAW = frozenset("script style noscript template textarea svg iframe object select title".split())
LEFT_OUT = frozenset("nav footer dialog button input label menu".split())
HOLDERS = frozenset("header aside".split())
MARKS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert comment "
    "comments respond reply replies disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "related recommended popup modal overlay newsletter subscribe signup login search pagination complementary contentinfo".split()
)
HINTS = frozenset("share sharing social widget pager toolbar copyright disclaimer legal skip subscription".split())
SPEAKS_FOR = frozenset("article body content entry intro lead main news paragraph post story text".split())
LAYOUT = ("has-", "no-", "not-", "with-", "without-", "tag-", "category-")
VOID = frozenset("hr br img input meta link wbr col area base embed source track".split())
CLOSES_P = BLOCKS - frozenset("html body tr td th thead tbody tfoot caption dt dd li".split())
#: An element that ends an open one of the named kinds, unless the container came after it.
ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？¿¡]")
SHARE = 0.5
LOWERED = 0.4
_PLAIN, _HINT, _MARK, _GONE = range(4)


def _kind(attributes: str) -> int:
    """What the attributes say: _GONE (hidden), _MARK, _HINT or _PLAIN."""
    if not attributes:
        return _PLAIN
    if _HIDDEN.search(attributes):
        return _GONE
    out, spoken = _PLAIN, False
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for token in (a or b or c).lower().split():
            if token.startswith(LAYOUT):
                continue
            own = _WORD.findall(token)
            if not MARKS.isdisjoint(own):
                out = _MARK
            elif not HINTS.isdisjoint(own):
                out = max(out, _HINT)
            elif own and SPEAKS_FOR.issuperset(own):
                spoken = True
    return out - 1 if out and spoken else out


class Page:
    """Elements and blocks of a page.

    For element i: up[i], kind[i] and path[i]; for path j: parent[j] and tag[j].  blocks has
    (element, path, text), the path being apart if all of the text is marked inline.
    """

    def __init__(self, html: str) -> None:
        self.up, self.kind, self.path, self.holds = [-1], [_PLAIN], [0], [0]
        self.parent, self.tag, self._number = [-1], [""], {}
        self.blocks: list[tuple[int, int, str]] = []
        self._read(html)

    def step(self, path: int, tag: str) -> int:
        key = (path, tag)
        if key not in self._number:
            self._number[key] = len(self.tag)
            self.parent.append(path)
            self.tag.append(tag)
        return self._number[key]

    def _read(self, html: str) -> None:
        names: list[str] = []  # open elements, block-level and inline
        nodes = [0]  # element of each open one, the page first; an inline one has that of the block about it
        where: dict[str, list[int]] = {}  # depths of the open elements of each name
        solid = [-1]  # depths of the open block-level elements
        text: list[tuple[bool, str]] = []
        hidden, marked = -1, -1  # depth of the inline element that hides or marks the text
        closed_for_good: set[str] = set()  # raw elements without another end tag

        def flush() -> None:
            if not text:
                return
            whole = " ".join(unescape("".join(t for _, t in text)).split())
            if whole:
                path = self.path[nodes[-1]]
                if all(m or not t.strip() for m, t in text):
                    path = self.step(path, "*")
                self.blocks.append((nodes[-1], path, whole))
            text.clear()

        def pop(to: int) -> None:
            nonlocal hidden, marked
            while len(names) > to:
                where[names.pop()].pop()
                nodes.pop()
            while solid[-1] >= to:
                solid.pop()
            hidden, marked = (-1 if hidden >= to else hidden), (-1 if marked >= to else marked)

        def latest(kinds) -> int:
            return max((where[k][-1] for k in kinds if where.get(k)), default=-1)

        def push(name: str, node: int) -> None:
            where.setdefault(name, []).append(len(names))
            names.append(name)
            nodes.append(node)

        at, last = 0, html.rfind(">")
        while at < len(html):
            if at > last:  # no tag ends any more
                if hidden < 0 and not html.startswith("<!--", at):
                    text.append((marked >= 0, html[at:]))
                break
            m = _TOKEN.match(html, at)
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                token = m.group()
                if (token[0] != "<" or len(token) == 1) and hidden < 0:
                    text.append((marked >= 0, token))
                continue
            name, ends, rest = name.lower(), m.group(1) or m.group(4), m.group(3) if m.group(2) else m.group(6)
            alone = rest.endswith("/") or name in VOID
            if name in RAW:
                if not ends and not alone and name not in closed_for_good:
                    end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                    if end:
                        at = end.end()
                    elif name in ("script", "style"):
                        at = len(html)
                    else:
                        closed_for_good.add(name)
                continue
            if name == "head":
                continue
            if name not in BLOCKS and name not in LEFT_OUT:
                if name == "br":
                    text.append((False, "\n"))
                elif not alone and not ends:
                    push(name, nodes[-1])
                    kind = _kind(rest)
                    if kind == _GONE and hidden < 0:
                        hidden = len(names) - 1
                    elif kind == _MARK and marked < 0:
                        marked = len(names) - 1
                elif ends and where.get(name):
                    depth = where[name][-1]
                    if depth > solid[-1]:
                        pop(depth)
                    else:  # crossed: the element ends, what it holds stays open
                        hidden, marked = (-1 if hidden == depth else hidden), (-1 if marked == depth else marked)
                continue
            flush()
            if ends:
                if where.get(name):
                    pop(where[name][-1])
                continue
            if name in CLOSES_P and where.get("p"):
                pop(where["p"][-1])
            elif name in ENDS:
                depth = latest(ENDS[name][0])
                if depth >= 0 and depth > latest(ENDS[name][1]):
                    pop(depth)
            if alone:
                continue
            inside = where.get("article") or where.get("main")
            kind = _kind(rest) if name not in ("html", "body", "main") else _GONE if _HIDDEN.search(rest) else _PLAIN
            if name in LEFT_OUT:
                kind = _GONE
            elif name == "form":
                kind = max(kind, _MARK)
            elif name in HOLDERS and not (name == "header" and inside):
                kind = max(kind, _MARK)
            self.holds.append(1 if name in ("article", "main") and kind < _MARK else 2 if name in HOLDERS else 0)
            node = len(self.up)
            self.up.append(nodes[-1])
            self.kind.append(kind)
            self.path.append(self.step(self.path[nodes[-1]], name + "*" * (kind == _HINT)))
            solid.append(len(names))
            push(name, node)
        flush()

    def left_out(self) -> list[bool]:
        """Whether each element is left out; inner ones are judged before outer ones."""
        n = len(self.up)
        gone = [k == _GONE for k in self.kind]
        within = [k == _MARK for k in self.kind]  # in an element that may be left out
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.up[i]]
            within[i] = within[i] or within[self.up[i]]
        size = [0] * n
        for node, _, text in self.blocks:
            if not gone[node]:
                size[node] += len(text) - text.count(" ")
        total = sum(size)
        held = [int(h == 1 and not g) for h, g in zip(self.holds, gone)]
        apart = any(h and not w for h, w in zip(held, within))  # the page has articles elsewhere: these are others
        main = [self.tag[p].startswith("main") and h for p, h in zip(self.path, held)]
        for i in range(n - 1, 0, -1):
            if gone[i]:
                continue
            if self.kind[i] == _MARK:
                half = self.holds[i] != 2 and not apart and size[i] and 2 * size[i] >= total
                if not (main[i] or held[i] and not apart or half):
                    gone[i] = True
                    total -= size[i]
                    continue
            up = self.up[i]
            size[up] += size[i]
            held[up] += held[i]
            main[up] = main[up] or main[i]
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.up[i]]
        return gone


def path_scores(blocks: list[tuple[int, str]]) -> dict[int, float]:
    """The fused ratio of each path of (path, text)."""
    sums: dict[int, list[float]] = {}
    for path, text in blocks:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    paths = list(sums)
    length = [sums[p][0] / sums[p][2] for p in paths]
    points = [sums[p][1] / sums[p][2] for p in paths]

    def smooth(x: list[float]) -> list[float]:
        return [(2 * v + (x[i - 1] if i else v) + (x[i + 1] if i + 1 < len(x) else v)) / 4 for i, v in enumerate(x)]

    return {p: a * (1 + b) for p, a, b in zip(paths, smooth(length), smooth(points))}


def chosen_blocks(blocks: list[tuple[int, str]], parent: list[int], tag: list[str]) -> list[bool]:
    """Whether each block belongs to the article."""
    low = [t.endswith("*") for t in tag]
    for j in range(1, len(tag)):
        low[j] = low[j] or low[parent[j]]
    scores = {p: s * (LOWERED if low[p] else 1.0) for p, s in path_scores(blocks).items()}
    mean = sum(scores[p] * len(t) for p, t in blocks) / sum(len(t) for _, t in blocks)
    content = [scores[p] >= SHARE * mean for p, _ in blocks]
    weight = [0] * len(tag)  # of the content below each path
    for (p, t), c in zip(blocks, content):
        if c:
            weight[parent[p]] += len(t)
    total = sum(weight)
    for j in range(len(tag) - 1, 0, -1):
        weight[parent[j]] += weight[j]
    # Paths with over half of the content are on one line from the root; the last of them is the deepest.
    held = max((j for j in range(len(tag)) if 2 * weight[j] > total), default=0)
    j = held
    while j > 0:
        if tag[j].rstrip("*") in ("article", "main"):
            held = j
        j = parent[j]
    below = [False] * len(tag)
    for j in range(len(tag)):
        below[j] = j == held or j > 0 and below[parent[j]]
    apart = [False] * len(tag)  # below the article by way of a lowered path
    for j in range(1, len(tag)):
        apart[j] = below[j] and j != held and (tag[j].endswith("*") or apart[parent[j]])
    return [c or below[p] and not apart[p] for (p, _), c in zip(blocks, content)]


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by one space."""
    if not html:
        return ""
    page = Page(html)
    gone = page.left_out()
    blocks = [(path, text) for node, path, text in page.blocks if not gone[node]]
    if not blocks:
        return ""
    return " ".join(t for (_, t), c in zip(blocks, chosen_blocks(blocks, page.parent, page.tag)) if c)


def html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2):
                texts = [main_text(x) for x in piece.column(2).to_pylist()]
                out = [piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.record_batch(out, names=["page_id", "url", "text", "n_chars"])

    slim = pages.select("page_id", "url", "html")
    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(kernel, f"page_id {kind}, url string, text string, n_chars long")
