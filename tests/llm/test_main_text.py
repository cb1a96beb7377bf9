"""Main text against an independent version, without the lists of tags and classes, and on long and deep pages."""

from __future__ import annotations

import random
import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from fathomline.llm import html

PAGES = "/root/testdata/sf0.01/pages.parquet"
BLOCKS = {"html", "body", "div", "p", "li", "ul", "ol", "h1", "h2", "article", "main", "section", "br", "footer", "header", "nav", "aside", "table", "tr", "td", "form"}


class Blocks(HTMLParser):
    """Text by block, with its links' characters; what is in scripts, menus and the like is left out. For pages of elements that BLOCKS has."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.text, self.linked = [], [], "", 0

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.found.append((text, min(self.linked, len(text)), any(x[0] in ("article", "main") for x in self.open)))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        if tag in ("br", "meta", "link", "img"):
            return
        if tag == "p" and self.open and any(x[0] == "p" for x in self.open):
            while self.open.pop()[0] != "p":
                pass
        if tag == "li" and self.open and self.open[-1][0] == "li":
            self.open.pop()
        marks = re.split(r"[-_\\s]+", (dict(attrs).get("class") or "") + " " + (dict(attrs).get("id") or ""))
        aside = tag in ("nav", "footer", "aside", "form", "script", "style", "title", "head", "noscript") or bool({"ad", "ads", "comments", "cookie", "sidebar", "promo", "related"} & set(marks))
        self.open.append((tag, aside))

    def handle_endtag(self, tag):
        if tag in BLOCKS or any(x == (tag, True) for x in self.open):
            self.flush()
        if any(x[0] == tag for x in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(aside for _, aside in self.open):
            self.text += data
            if any(x[0] == "a" for x in self.open):
                self.linked += len(data)


def by_hand(page):
    """The line-block distribution line by line: surge where three lines together have enough, dive after enough windows without. Only the heaviest stretch, without the rest of its container."""
    b = Blocks()
    b.feed(page)
    b.close()
    b.flush()
    rows, before = [], None  # (weight, plain weight, text); blank ones where an article begins or ends
    for text, linked, named in b.found:
        if before is not None and named != before:
            rows += [(0, 0, None)] * html.BREAK
        before = named
        size = len(text) if named else len(text) - linked
        rows.append((size * (html.ARTICLE_WEIGHT if named else 1), size, text))
    sums = [sum(w for w, *_ in rows[i:i + html.WINDOW]) for i in range(len(rows))]
    least, parts, last = min(html.LEAST_LINE, max(sums, default=0)), [], None
    for i, x in enumerate(sums):
        if x and x >= least:
            if last is None or i - last > html.GAP_LINES:
                parts.append([i, i])
            last = parts[-1][1] = i
    best, text = -1, ""
    for first, end in parts:
        inside = [r for r in rows[first:end + html.WINDOW]]
        while inside and not inside[-1][0]:
            inside.pop()
        while inside and not inside[0][0]:
            inside.pop(0)
        if (total := sum(r[1] for r in inside)) > best:
            best, text = total, " ".join(r[2] for r in inside if r[2])
    return text


@pytest.fixture(scope="module")
def pages():
    return pq.read_table(PAGES).column("html").to_pylist()


def test_equals_the_version_by_hand(pages):
    for page in pages:
        assert html.extract(page) == by_hand(page)


A, B = "one part of the text, long enough. " * 9, "another part of the text. " * 7


@pytest.mark.parametrize("page", [
    f"<div><p>{A}</p><p>{B}</p></div><article><p>card</p></article>", f"<article><p>{A}</p><p>x</p></article><div><p>{B}</p></div>", f"<ul><li><a>menu</a></li><li><a>more</a></li></ul><p>{A}</p><p>{B}</p>",
    f"<div><p>{B}</p></div>" + "<p><a>link</a></p>" * 12 + f"<div><p>{A}</p></div>", "<p>hi</p>", "<ul><li><a>only links</a></li></ul>"])
def test_surge_and_dive_by_hand(page):
    assert html.extract(page) == by_hand(page)


def test_finds_the_article_without_lists(pages, monkeypatch):
    """With no tag or class known as aside or article, all of the article is found, and little else on most pages."""
    known = [html.extract(page) for page in pages]
    for name in ("ASIDE", "FOREIGN_WORDS", "LAYOUT_WORDS", "ARTICLE"):
        monkeypatch.setattr(html, name, frozenset())
    found = [html.extract(page) for page in pages]
    assert all(a in b for a, b in zip(known, found, strict=True))
    assert sum(len(b) <= 1.5 * len(a) for a, b in zip(known, found, strict=True)) > 0.75 * len(pages)


@pytest.mark.parametrize("page", ["<div><p>{a}</p><p><a href=x>all of it a link</a></p></div><div><a>out</a></div>", "<div><p><a href=x>all of it a link</a></p><p>{a}</p></div>"])
def test_linked_paragraphs_at_the_ends_stay(page):
    link = "all of it a link"
    assert html.extract(page.format(a=A)) == (f"{A.strip()} {link}" if page.index("{a}") < page.index(link) else f"{link} {A.strip()}")


@pytest.mark.parametrize("page", ['<a "' * 50_000, "<svg>" * 50_000, "<!--" * 50_000, "<a b='x>" * 50_000, "<p>x" * 100_000, "<div><p>t</p>" * 20_000, "<div>" * 20_000 + "</p>" * 20_000, "x " * 1_000_000])
def test_long_and_deep_pages(page):
    began = time.time()
    html.extract(page)
    assert time.time() - began < 10


def test_long_page_is_kept_whole():
    parts = [f"paragraph {i} " * 9 for i in range(20_000)]
    assert html.extract("<nav>menu</nav><main>" + "".join(f"<p>{x}</p>" for x in parts) + "</main>") == " ".join(x.strip() for x in parts)


#: Classes that tell of something else in the page, or mean the article's own parts.
STATES = ["has-sidebar", "no-sidebar", "with-footer", "nav-open", "no-comments", "share-price", "footer-note", "menu-card", "subscription-models", "header-image", "related-work", "comments-closed", "widget-free", "content", "has-cookie-notice", "searchable", "adventure"]
#: Elements that are not the article.
OTHERS = ["<nav class='main-nav'><ul>{links}</ul></nav>", "<div class='site-header'><p>{short}</p></div>", "<div class='sidebar-left'><p>{text}</p></div>", "<footer><p>{text}</p></footer>", "<div id='cookie-banner'><p>{text}</p></div>", "<aside><p>{text}</p></aside>",
          "<section class='comments'><h2>Comments</h2><div class='comment'><p>{text}</p><p>{text}</p></div></section>", "<div class='advert'>{short}</div>", "<form><p>{short}</p><input value='x'></form>", "<div role='navigation'><ul>{links}</ul></div>",
          "<div class='newsletter'><p>{text}</p></div>", "<div class='post-footer'><p>{short}</p></div>", "<script>var x = '{text}';</script>", "<div hidden><p>{text}</p></div>", "<div class='related'><ul>{links}</ul></div>"]


def generated(seed):
    """A page and its article's text: random layout, classes and neighbours, the article known from the start."""
    r = random.Random(seed)
    words = [f"w{i}{'aeiou'[i % 5]}r" for i in range(90)]
    text = lambda n: " ".join(r.choices(words, k=n)) + "."
    state = lambda: f' class="{" ".join(r.sample(STATES, r.randrange(0, 3)))}"'
    other = lambda: r.choice(OTHERS).format(links="".join(f"<li><a href=x>{text(2)}</a></li>" for _ in range(r.randrange(2, 7))), short=text(3), text=text(18))
    blocks, parts = [], []
    for _ in range(r.randrange(3, 9)):
        block = text(r.randrange(25, 60))
        blocks.append(block)
        tag = r.choice(["p", "p", "p", "div", "blockquote"])
        first, _, rest = block.partition(" ")
        parts.append(f"<{tag}{state()}>{first} <span class='{r.choice(['alert', 'share', 'menu', 'ad-hoc'])}'>{rest.replace(' ', chr(10) + ' ', 1)}</span></{tag}>")
    inner = "".join(parts)
    frame = r.choice(["<main{c}>{x}</main>", "<article{c}>{x}</article>", "<div{c}>{x}</div>", "<main{c}><article{d}>{x}</article></main>", "<div{d}><section{c}>{x}</section></div>"]).format(x=inner, c=state(), d=state())
    cards = "".join(f"<article{state()}><p>{text(12)}</p></article>" for _ in range(6)) if r.random() < 0.3 else ""
    before, after = "".join(other() for _ in range(r.randrange(4))), "".join(other() for _ in range(r.randrange(4)))
    return f"<html><head><title>{text(4)}</title></head><body{state()}>{before}{frame}{cards}{after}</body></html>", " ".join(blocks)


@pytest.mark.parametrize("start", range(0, 300, 50))
def test_generated_layouts(start):
    for seed in range(start, start + 50):
        page, article = generated(seed)
        assert html.extract(page) == article, (seed, page)


LONG, MORE = "First paragraph of the article, with enough words to be one. " * 4, "Second paragraph that goes on with other words for a while. " * 5


@pytest.mark.parametrize("mark", ["content has-sidebar", "no-sidebar", "widget", "banner", "menu", "site-footer", "social related", "footer_note"])
@pytest.mark.parametrize("tag", ["main", "div", "section"])
def test_no_class_loses_the_article(tag, mark):
    """Whatever layout class its container has, the only long text of a page is found."""
    page = f"<nav><a>x</a></nav><p>Home</p><{tag} class='{mark}'><p>{LONG}</p><p>{MORE}</p></{tag}><div class='comments'><p>{LONG * 9}</p></div>"
    assert html.extract(page).endswith(f"{LONG.strip()} {MORE.strip()}")


def test_parts_of_the_article_stay():
    parts = [("p class='share-price'", LONG), ("p class=footer-note", MORE), ("p id='subscription-models'", LONG), ("div class='menu-card'", MORE), ("p", "before <span class='alert'>inside</span> after")]
    page = "<article>" + "".join(f"<{t}>{x}</{t.split()[0]}>" for t, x in parts) + "</article>"
    assert html.extract(page) == f"{LONG.strip()} {MORE.strip()} {LONG.strip()} {MORE.strip()} before inside after"


@pytest.mark.parametrize("around", ["{body}{cards}", "{cards}{body}", "<main>{body}{cards}</main>"])
def test_cards_beside_the_body(around):
    """Six cards are six stretches, each smaller than the body that is no article element."""
    body = f"<div><p>{LONG}</p><p>{MORE}</p></div>"
    cards = "".join(f"<article><h3>Card {i}</h3><p>{LONG[:200]}</p></article>" for i in range(6))
    assert html.extract(around.format(body=body, cards=cards)) == f"{LONG.strip()} {MORE.strip()}"


def test_comments_are_never_the_article():
    for mark in ("comments", "comment-list", "respond", "ad", "cookie-consent"):
        assert html.extract(f"<p>{LONG[:60]}</p><div class='{mark}'><p>{LONG * 30}</p></div>") == LONG[:60].strip()
