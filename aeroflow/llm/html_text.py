"""Main text of HTML pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroflow.llm.frames import table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg noframes xmp".split())
CONTROLS = frozenset("button datalist optgroup option select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Elements and class or id words that speak against content, and for it.
CHROME = frozenset("nav header footer aside form menu dialog".split())
BAD_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommend recommended related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split())
GOOD_WORDS = frozenset("article body content entry main maincontent post story text".split())

#: Words that begin so are taken like the bad words: commentlist, cookiebar and the like.
BAD_STARTS = ("advert", "banner", "breadcrumb", "comment", "cookie", "disqus", "navbar", "newsletter", "popup", "promo", "sidebar", "sponsor", "subscri")

#: Phrases of boilerplate in short blocks outside an article.
_PHRASES = re.compile(r"copyright|©|\(c\) \d{4}|all rights reserved|privacy policy|terms of (use|service)|cookies?\b|sign (up|in)\b|log ?in\b|subscribe|newsletter|read more|share (this|on)|follow us|advertisement|skip to", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Element:
    """An open element: its place in the tree and what it and its ancestors say of a block."""

    def __init__(self, parent: Element | None, name: str, attributes: str = ""):
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if attributes else ""
        words = frozenset(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower())) - {""} if named else frozenset()
        self.parent, self.name, self.chars = parent, name, 0
        self.depth = parent.depth + 1 if parent else 0
        self.bad_words = bool(words & BAD_WORDS) or any(w.startswith(BAD_STARTS) for w in words)
        self.good_words = bool(words & GOOD_WORDS)
        self.hidden = bool(parent and parent.hidden) or bool(attributes and _HIDDEN.search(attributes))
        self.holds_main = False

    def learn(self, page_chars: int) -> None:
        """Take over what the ancestors say; called for parents first, with all characters counted.

        Words and chrome of an element that holds most of the page around its main part say
        nothing: a form or a class on the body wraps content and boilerplate alike.
        """
        up, name = self.parent, self.name
        wide = name in ("html", "body") or self.holds_main and self.chars >= WIDE * page_chars
        chrome = name in CHROME and not (wide and name in ("form", "header"))
        self.article = name == "article" or bool(up and up.article)
        self.main = name == "main" or bool(up and up.main)
        self.paragraph = name in ("p", "pre", "blockquote") or bool(up and up.paragraph)
        self.heading = name in HEADINGS or bool(up and up.heading)
        self.chrome = chrome or bool(up and up.chrome)
        self.frame = name if chrome or name in ("article", "main") else up.frame if up else ""
        self.bad = self.bad_words and not wide or bool(up and up.bad)
        self.good = self.good_words or bool(up and up.good)


@dataclass
class Block:
    """Text between block-level tags, with the element that it stands in."""

    text: str
    element: Element
    link_chars: int

    @property
    def hidden(self) -> bool:
        return self.element.hidden


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; inside a block white space is one space.

    Scripts, styles and other raw elements give no text, inline tags and line breaks do not end a
    block, unclosed and truncated tags are closed where a browser would. Buttons and lists of
    options give no text and do not end a block either; one without an end tag of its own ends at
    the next block-level tag, so nothing after it is lost.
    """
    out: list[Block] = []
    root = Element(None, "html")
    elements, stack, opened = [root], [root], Counter()
    parts: list[str] = []
    links = in_link = 0
    control, closed = "", False

    def flush() -> None:
        nonlocal links
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(Block(text, stack[-1], links))
            stack[-1].chars += len(text)
        links = 0

    def say(text: str) -> None:
        nonlocal links
        if control:
            return
        parts.append(text)
        if in_link:
            links += len(text.strip())

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        say(page[at : token.start()])
        at = token.end()
        closing, name, rest = token[1], (token[2] or "").lower(), token[3] or ""
        if not name:
            continue
        if name in RAW:
            if not closing and not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in CONTROLS:
            if closing and name == control:
                control = ""
                say(" ")
            elif not closing and not control:
                control = name
                end = re.compile(rf"<(/?){name}\b", re.I).search(page, at)
                closed = bool(end and end[1]) and name not in ("option", "optgroup")
            continue
        if control and closed:
            continue
        if name == "br":
            say(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        if name in VOID:
            if not control:
                flush()
            continue
        control = ""
        flush()
        in_link = 0
        if closing:
            if opened[name]:
                while (gone := stack.pop().name) != name:
                    opened[gone] -= 1
                opened[name] -= 1
        else:
            if name in CLOSES_P and stack[-1].name == "p" or name == stack[-1].name and name in ("li", "dt", "dd", "tr", "td", "th"):
                opened[stack.pop().name] -= 1
            stack.append(Element(stack[-1], name, rest))
            opened[name] += 1
            elements.append(stack[-1])
    flush()
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
        e.parent.holds_main |= e.holds_main or e.name in ("article", "main", "h1")
    for e in elements:
        e.learn(root.chars)
    return out


#: The share of a page's text from which an element around its main part is taken for a wrapper.
WIDE = 0.7

#: Weights of the linear classifier: positive speaks for content.
WEIGHTS = {"bias": -0.4, "article": 2.6, "main": 1.6, "paragraph": 0.9, "heading": 0.3, "length": 0.55, "marks": 0.5, "links": -2.4, "chrome": -6.0, "bad_words": -5.0, "phrases": -3.0, "good_words": 0.8, "hidden": -8.0}


#: What a block's length can say at most; of a block of links it says nothing.
MOST_LENGTH = 5.0


def content_score(block: Block) -> float:
    """Log-odds that a block is content."""
    e, size = block.element, len(block.text)
    links = min(1.0, block.link_chars / size)
    heading_in_article = e.frame == "header" and e.article and e.heading
    values = {
        "bias": 1.0,
        "article": e.article,
        "main": e.main,
        "paragraph": e.paragraph,
        "heading": e.heading,
        "length": min(MOST_LENGTH, math.log1p(size / 40)) * (1 - links),
        "marks": min(2, sum(block.text.count(c) for c in ".,;!?")) / 2,
        "links": links,
        "chrome": e.chrome and not heading_in_article,
        "bad_words": e.bad,
        "phrases": size < 200 and not (e.article or e.main) and bool(_PHRASES.search(block.text)),
        "good_words": e.good,
        "hidden": e.hidden,
    }
    return sum(WEIGHTS[k] * v for k, v in values.items())


#: Cost of giving neighbours different labels, and its share for blocks in different containers.
SMOOTHNESS = 0.8
#: Edges that would cost less are left out.
LEAST_SMOOTHNESS = 0.004
#: Edges reach this many blocks back.
REACH = 2


def smoothness(a: Block, b: Block, gap: int) -> float:
    """Larger for blocks that stand close in the page and share more of their place in the tree."""
    if a.hidden != b.hidden:
        return 0.0
    x, y, apart = a.element, b.element, 0
    while x is not y and SMOOTHNESS / gap / (1 + apart) >= LEAST_SMOOTHNESS:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        apart += 1
    return SMOOTHNESS / gap / (1 + apart) if x is y else 0.0


def minimum_cut(content: list[float], other: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (true: content) of least total cost, by a maximum flow.

    ``content[i]`` is paid if block i is not content, ``other[i]`` if it is, and an edge's weight
    if its ends differ. Flow goes from the content terminal over blocks to the other; blocks
    still reachable from the content terminal at the maximum are content. Shortest augmenting
    paths are found level by level.
    """
    n = len(content)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(forth)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        both = min(content[i], other[i])  # this much flows straight through
        if content[i] > both:
            link(source, i, content[i] - both, 0.0)
        elif other[i] > both:
            link(i, sink, other[i] - both, 0.0)
    for a, b, weight in edges:
        link(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in at[x]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nexts = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path.clear()
                x = source
            while nexts[x] < len(at[x]):
                e = at[x][nexts[x]]
                if room[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                nexts[x] += 1
            else:
                if x == source:
                    break
                level[x] = -1
                x = to[path.pop() ^ 1]
                continue
            path.append(e)
            x = to[e]


def labels(found: list[Block]) -> list[bool]:
    """Which blocks are content, by the minimum cut of their scores and smoothness edges."""
    scores = [content_score(b) for b in found]
    edges = [(i - gap, i, w) for i in range(len(found)) for gap in range(1, min(REACH, i) + 1) if (w := smoothness(found[i - gap], found[i], gap)) > 0]
    return minimum_cut([max(0.0, s) for s in scores], [max(0.0, -s) for s in scores], edges)


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by one space."""
    found = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, labels(found)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page.

    The page is cut into text blocks; a linear classifier's log-odds become the capacities
    between each block and the two terminals, closeness in the page and in the tree become
    smoothness edges, and a minimum cut separates content from boilerplate. Character references
    are decoded, white space inside a block becomes one space, and kept blocks are joined in page
    order by one space.

    Returns one row per input row: the id and url columns, ``text`` (empty where nothing is
    content; null html counts as empty) and ``n_chars`` (code points). Pages of any length are
    read whole; truncated and unbalanced markup is read as far as it goes; null or repeated ids
    and repeated rows pass through; further columns are left out. One pass without a shuffle.
    """
    kept = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = kept.dtypes
    out = kept.mapInArrow(run, f"id {kinds[0][1]}, url {kinds[1][1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text and n_chars; null html gives an empty text."""
    return extract(table(spark, sf_dir, "pages"))
