"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element gives a line. A line's length is its text less that in
links; lengths are summed over sliding windows of lines. Where the sums surge from nothing a stretch
starts, where they dive to nothing it ends, and of all stretches the one with the most text is the
article's. So it goes on every page. Tags only weigh: lines inside menus, footers, adverts, forms and
the like weigh nothing and are left out; in an article or main element link text counts as text and
lines weigh ARTICLE_WEIGHT times as much, so that short ones don't end a stretch; and where such an
element begins or ends there are blank lines, so that cards beside an article, or beside each other,
are other stretches.

Classes say less than elements do: only block elements are judged by them, by whole names or their last
part (`site-footer`, not `footer-note` or `has-sidebar`), a main element never; and if what they
mark as layout holds a far heavier stretch than all the rest, it was the article.

The stretch also says which container is the article's. All from the first to the last stretch inside
that is kept, headings just before, and at both ends what stands right beside its paragraphs: lines
that are links alone too.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Elements whose content never is text of the page.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select option datalist textarea button audio video map".split())
#: Elements that hold something else than the article.
ASIDE = frozenset("nav header footer aside form dialog menu fieldset label input".split())
#: Names in class, id or role of what never is the article, whatever its length.
FOREIGN_WORDS = frozenset("""ad ads advert adverts advertisement adsbygoogle sponsor sponsored cookie cookies consent gdpr newsletter
comment comments comment-list disqus reply replies respond popup modal""".split())
#: Names of layout, which may be told of the article's own container by mistake.
LAYOUT_WORDS = frozenset("""banner promo promotion nav navbar navigation menu breadcrumb
breadcrumbs sidebar side-bar aside header masthead footer foot copyright notice notices notification alert overlay
subscribe subscription signup login share sharing social related recommended
pagination pager widget toolbar search contentinfo complementary search-form skip-link""".split())
OWN_IN_ARTICLE = frozenset(["header", "masthead"])
#: First parts of names that tell of something else in the page, and last parts that only say where.
OF_OTHERS, WHERE = frozenset("has no with without is not show hide under above below after before".split()), frozenset("left right top bottom main primary secondary global wrapper wrap container inner outer area box block section list form bar".split())
#: A layout container's stretch of so many characters, and so many times the best of the rest, is the article.
LONG_MARKED, FAR_HEAVIER = 300, 5
#: Elements that end a line.
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend""".split())
#: Those that can be around the article's paragraphs alone.
CONTAINER = BLOCK - {"html", "body"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that close an open one of the same kind, as HTML does.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ARTICLE = frozenset(["article", "main"])
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

WINDOW = 3
#: Windows with less text are down, and more of them than GAP_LINES end a stretch.
LEAST_LINE, GAP_LINES = 25, 4
ARTICLE_WEIGHT = LEAST_LINE
#: Blank lines where an article element begins or ends: a stretch never bridges them.
BREAK = WINDOW + GAP_LINES

#: Quotes open a value only after "=", as in HTML; a value or tag that isn't closed runs to the end. So no try fails late, and any page takes linear time.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|))*+)(?:>|\Z)", re.S)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


NOT, LAYOUT, FOREIGN = 0, 1, 2


def _named(token: str) -> set[str]:
    """The names that a class's token goes by: itself, and its last part that says what it is, unless its first part tells of others."""
    parts = [x for x in re.split(r"[-_:]+", token) if x]
    if len(parts) < 2 or parts[0] in OF_OTHERS:
        return {token}
    while len(parts) > 1 and (parts[-1] in WHERE or parts[-1].isdigit()):
        parts.pop()
    return {token, parts[-1]}


def _is_aside(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element holds something else than the article, by its name (FOREIGN) or by its class (which may be of LAYOUT). Inside one, a header is the article's own."""
    if name in ASIDE:
        return NOT if in_article and name == "header" else FOREIGN
    if not attributes:
        return NOT
    found = NOT
    if name in BLOCK and name != "main":
        layout = LAYOUT_WORDS - OWN_IN_ARTICLE if in_article else LAYOUT_WORDS
        for m in _MARK.finditer(attributes):
            for token in (m[1] or m[2] or m[3] or "").lower().split():
                names = _named(token)
                if names & FOREIGN_WORDS:
                    return FOREIGN
                if names & layout:
                    found = LAYOUT
    return FOREIGN if _HIDDEN.search(attributes) else found


def _decode(text: str) -> str:
    return html.unescape(text) if "&" in text else text


class Line(NamedTuple):
    text: str
    linked: int  # characters in links
    aside: int  # NOT, or the strongest of what is around it
    named: int  # number of the article element that it is in; 0: none
    container: int  # number of the block element around the one that it is the text of; 0: none
    heading: bool


class Containers:
    """Block elements by number, in order of their starts: the one around each, and the number after its last descendant's."""

    def __init__(self):
        self.around, self.end = [0], [-1]

    def opened(self, around: int) -> int:
        self.around.append(around)
        self.end.append(-1)
        return len(self.around) - 1

    def closed(self, number: int) -> None:
        self.end[number] = len(self.around)

    def holds(self, number: int, other: int) -> bool:
        end = self.end[number]
        return number <= other and (end < 0 or other < end)

    def common(self, numbers: list[int]) -> int:
        """The innermost that holds all of them."""
        number, low, high = numbers[0], min(numbers), max(numbers)
        while not (self.holds(number, low) and self.holds(number, high)):
            number = self.around[number]
        return number


def lines(page: str) -> tuple[list[Line], Containers]:
    """The page's lines in order, and its block elements."""
    found: list[Line] = []
    containers = Containers()
    pieces: list[str] = []
    linked = 0
    open_: list[tuple[str, int, bool, int]] = []  # name, makes aside, makes article, number of the innermost block element
    aside = [0, 0, 0]  # open elements of each kind
    articles: list[int] = []  # numbers of the open ones
    links = headings = 0
    unmatched: Counter = Counter()  # open elements by name
    unclosed: set[str] = set()  # silent elements that no end tag follows any more

    def close_line() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", _decode("".join(pieces))).strip()
            if text:
                container = containers.around[open_[-1][3]] if open_ else 0
                kind = FOREIGN if aside[FOREIGN] else LAYOUT if aside[LAYOUT] else NOT
                found.append(Line(text, min(linked, len(text)), kind, articles[-1] if articles else 0, container, headings > 0))
            pieces.clear()
        linked = 0

    def pop() -> None:
        nonlocal links, headings
        name, a, b, number = open_.pop()
        aside[a] -= 1
        if b:
            articles.pop()
        links -= name == "a"
        headings -= name in HEADING
        unmatched[name] -= 1
        if name in CONTAINER:
            containers.closed(number)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else n]
        if text:
            pieces.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, attributes = m[2].lower(), m[3]
        block = name in BLOCK
        if m[1]:
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None) if unmatched[name] else None
            if block or depth is not None and (open_[depth][1] or open_[depth][2]):
                close_line()
            if depth is not None:
                while len(open_) > depth:
                    pop()
            continue
        if name in SILENT:
            close_line() if name in ("head", "title") else None
            if not attributes.endswith("/") and name not in unclosed:
                end = re.compile(rf"</{re.escape(name)}\s*>|</{re.escape(name)}\Z" if name != "head" else r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in ("script", "style", "textarea", "title", "noscript", "iframe"):
                    at = n
                else:
                    unclosed.add(name)
            continue
        makes_aside, makes_article = NOT if name in ("html", "body") else _is_aside(name, attributes, bool(articles)), name in ARTICLE
        if block or makes_aside:
            close_line()
        if name in VOID or attributes.endswith("/"):
            continue
        if name in SELF_CLOSING:
            # the innermost of its kind, unless a container stands between
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in SELF_CLOSING[name]:
                    while len(open_) > i:
                        pop()
                    break
                if open_[i][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "main", "aside", "nav", "footer", "header", "form", "body"):
                    break
        number = open_[-1][3] if open_ else 0
        open_.append((name, makes_aside, makes_article, containers.opened(number) if name in CONTAINER else number))
        aside[makes_aside] += 1
        if makes_article:
            articles.append(open_[-1][3])
        links += name == "a"
        headings += name in HEADING
        unmatched[name] += 1
    close_line()
    return found, containers


def stretches(weights: np.ndarray, least: int, gap: int) -> list[tuple[int, int]]:
    """First and end of each stretch of lines: it starts where the sum over a window surges from under least, ends before it dives back and stays down for more than gap windows. If no window has as much, any text counts."""
    if not weights.any():
        return []
    sums = np.convolve(weights, np.ones(WINDOW, np.int64))[WINDOW - 1:]  # of each line and those after it
    high = np.flatnonzero(sums >= min(least, sums.max()))
    breaks = np.flatnonzero(np.diff(high) > gap)
    starts, ends = high[np.concatenate([[0], breaks + 1])], high[np.concatenate([breaks, [len(high) - 1]])]
    found = []
    for start, last in zip(starts.tolist(), ends.tolist(), strict=True):
        full = np.flatnonzero(weights[start:last + WINDOW])
        found.append((start + int(full[0]), start + int(full[-1]) + 1))
    return found


class Region(NamedTuple):
    first: int
    end: int
    size: int  # characters of the heaviest stretch


def region(found: list[Line], containers: Containers) -> Region:
    """First and end of the article among the lines of a page."""
    named = np.array([line.named for line in found], np.int64)
    size = np.array([len(line.text) - (0 if line.named else line.linked) for line in found], np.int64)
    place = np.arange(len(found)) + BREAK * np.cumsum(np.diff(named, prepend=named[:1]) != 0)  # of each line among the blank ones
    weights = np.zeros(len(found) and int(place[-1]) + 1, np.int64)
    weights[place] = size * np.where(named > 0, ARTICLE_WEIGHT, 1)
    apart = [tuple(np.searchsorted(place, x).tolist()) for x in stretches(weights, LEAST_LINE, GAP_LINES)]
    if not apart:
        return Region(0, 0, 0)
    heavy = lambda x: int(size[x[0]:x[1]].sum())
    a, b = max(apart, key=heavy)
    article = containers.common([line.container for line in found[a:b]])
    within = [line.named == found[a].named and containers.holds(article, line.container) for line in found]
    inside = [(c, d) for c, d in apart if any(within[c:d])]
    first, end = inside[0][0], inside[-1][1]
    while first and within[first - 1] and (found[first - 1].heading or article and found[first - 1].container == article):
        first -= 1
    while end < len(found) and within[end] and article and found[end].container == article:
        end += 1
    return Region(first, end, heavy((a, b)))


def extract(page: str | None) -> str:
    """The main text: blocks in page order, joined by one space; empty if there is none (null and empty pages too). Takes time in proportion to the page's length."""
    if not page:
        return ""
    every, containers = lines(page)
    found = [line for line in every if line.aside == NOT]
    best = region(found, containers)
    marked = [line for line in every if line.aside == LAYOUT]
    if sum(len(line.text) for line in marked) >= LONG_MARKED:
        other = region(marked, containers)
        if other.size >= max(LONG_MARKED, FAR_HEAVIER * best.size):
            found, best = marked, other
    return " ".join(line.text for line in found[best.first:best.end])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html; other columns are ignored); repeated rows give repeated rows, an empty table none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [extract(x) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array(map(len, found), pa.int64())})

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
