"""Main text of web pages from flat blocks and a learned decision tree.

A page is read once as a row of text blocks; tags only end blocks and open or
close containers. Each block has its words and link density, those of the blocks
before and after it, its number of links and their mean length, whether it reads as an
imprint, and what its containers say (article, boilerplate, heading). Signs that stand alone
between links (``|``, ``·``) are no words of a block.
A decision tree (CART, Gini), trained on the labelled pages below, keeps or drops
it: pages without an ``article`` are told by words, links and neighbours alone.

Names in class, id and role count only where every part of a name is known, so a
``share-price-report`` is no share box. Names of layout (``sidebar``, ``header``,
``form``) end at an ``article`` or ``main`` within, and count for nothing where
no such element exists and nearly all of a page's words stand in the container.

Time is linear in the page: each search either consumes what it reads or is made
once. Null html: empty text. Broken markup never fails: unclosed comments and scripts
run to the end, an unclosed quote or tag is text up to the next ``>``, stray end
tags are ignored, unclosed tags end with their parents. Text without any tag is a
block; pages without words give an empty text. Very long pages are read whole.
Repeated rows are handled each. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""(?<![a-z-])([a-z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTED, _HIDDEN = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
_LONG_NUMBER = re.compile(r"&#(\d{8}|[xX][0-9a-fA-F]{8})[0-9a-fA-F]+;?")
_SIGNS = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
#: Beginnings of lines of imprint; within an article they may be quoted.
_IMPRINT = re.compile(r"©|\(c\)|copyright\b", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title iframe noframes xmp".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
#: Elements that hold no text of the page.
_UNSEEN = frozenset("noscript template svg math select canvas object button datalist audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img br input label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside dialog menu fieldset".split())
_CONTENT = frozenset("article main".split())
_CELLS = frozenset("td th table caption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of containers that are no main text wherever they stand.
_STRONG = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertisements advertising advertorial sponsor sponsored sponsors promo promos promoted promotion cookie cookies consent gdpr popup modal lightbox overlay "
    "newsletter subscribe subscription signup comment comments commentlist disqus respond reply replies related recommend recommended recommendations share sharing sharebar social "
    "breadcrumb breadcrumbs pagination pager footer copyright colophon contentinfo complementary".split()
)
#: Names of layout: a whole page may stand in such a container.
_WEAK = frozenset("sidebar aside header masthead nav navbar navigation menu menubar menus search searchbox searchform banner banners notice notices alert alerts alertdialog dialog widget widgets toolbar topbar login signin rail".split())
#: Parts that say nothing more beside one of these names.
_BESIDE = frozenset(
    "site main top bottom left right primary secondary global mobile desktop sticky fixed box bar block list lists link links item items area section wrap wrapper container inner outer body form unit slot row col column "
    "group panel card thread meta tools button buttons icon icons text title heading label count more toggle dropdown side the up in js".split()
)
#: Parts that only stand beside strong names: a post's header is part of the post, its comments are not.
_OF_CONTENT = frozenset("post posts article articles story stories page entry content".split())
#: A layout container with this share of a page's words, where there is no article, holds the main text.
_WHOLE = 0.8


@lru_cache(8192)
def _level(token: str) -> int:
    """Of one name: 2 boilerplate anywhere, 1 layout, 0 neither."""
    parts = [p.lower() for p in _NAME_PART.findall(token)]
    if any(p in _STRONG for p in parts):
        return 2 if all(p in _STRONG or p in _WEAK or p in _BESIDE or p in _OF_CONTENT for p in parts) else 0
    if any(p in _WEAK for p in parts):
        return 1 if all(p in _WEAK or p in _BESIDE for p in parts) else 0
    return 0


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boiler: int
    article: int
    heading: int
    layout: int = 0  # the innermost layout container, 0 is none
    links: int = 0


@dataclass
class _Element:
    tag: str
    dropped: int = 0  # within boilerplate
    article: int = 0  # within content
    layout: int = 0


class _Stack:
    """Open elements, with the places of each tag, so an end tag finds its element at once."""

    def __init__(self) -> None:
        self.items = [_Element("")]
        self.places: dict[str, list[int]] = defaultdict(list)

    @staticmethod
    def _kinds(tag: str) -> tuple[str, ...]:
        return (tag, "#cell") if tag in _CELLS else (tag, "#list") if tag in ("ul", "ol") else (tag,)

    def push(self, e: _Element) -> None:
        for kind in self._kinds(e.tag):
            self.places[kind].append(len(self.items))
        self.items.append(e)

    def last(self, kind: str) -> int:
        return p[-1] if (p := self.places.get(kind)) else 0

    def cut(self, at: int) -> None:
        while len(self.items) > at:
            for kind in self._kinds(self.items.pop().tag):
                self.places[kind].pop()

    def close(self, tag: str) -> None:
        """Closes the innermost open ``tag``, unless a table's cell (or, for items, a list) began since."""
        at = self.last(tag)
        if at and (tag in _CELLS or self.last("#cell") < at) and (tag != "li" or self.last("#list") < at):
            self.cut(at)

    def open_block(self, tag: str) -> None:
        """A new block ends an open paragraph, a new item the one before."""
        self.close("p")
        if tag == "li":
            self.close("li")


def _decoded(text: str) -> str:
    return entities.unescape(_LONG_NUMBER.sub("�", text) if "&#" in text else text) if "&" in text else text


class _Page:
    """One pass over a page: its blocks, and the layout containers with their words."""

    def __init__(self, page: str):
        self.page, self.out, self.stack = page, [], _Stack()
        self.parts: list[str] = []
        self.links: list[str] = []
        self.in_link = self.heading = self.n_links = 0
        self.parents, self.words = [0], [0]  # of layout containers, by number
        self.quoted = True  # quotes hide ``>``
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.read()

    def end(self) -> None:
        """Closes the block under way."""
        if self.parts:
            text = " ".join(_decoded("".join(self.parts)).split())
            if text:
                e = self.stack.items[-1]
                words = text.count(" ") + 1
                if self.n_links > 1:
                    words = max(1, words - len(_SIGNS.findall(text)))
                linked = min(words, len(_decoded(" ".join(self.links)).split()))
                self.out.append(Block(text, words, linked, e.dropped, e.article, self.heading, e.layout, self.n_links))
                self.words[e.layout] += 0 if e.dropped else words - linked
            self.parts.clear()
            self.links.clear()
        self.in_link = self.n_links = 0

    def text(self, a: int, b: int) -> None:
        if b > a:
            self.parts.append(self.page[a:b])
            if self.in_link:
                self.links.append(self.page[a:b])

    def tag_end(self, at: int) -> int:
        """Where the tag that was begun before ``at`` ends (its ``>``), -1 if nowhere."""
        page, k = self.page, at
        if at > self.last[">"]:
            return -1
        while self.quoted:
            m = _STOP.search(page, k)
            if m is None:  # quotes hid all the rest: from here on they don't
                self.quoted = False
                break
            c, k = m[0], m.end()
            if c == ">":
                return k - 1
            before = k - 2
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and k <= self.last[c]:  # a quoted value
                k = page.find(c, k) + 1
        return page.find(">", at)

    def read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            m = _OPEN.search(page, at)
            if m is None:
                break
            self.text(at, m.start())
            if m[1]:
                k = page.find("-->", m.start() + 2)
                at = k + 3 if k >= 0 else n
                continue
            k = self.tag_end(m.end()) if m[4] else page.find(">", m.end())
            if k < 0:  # never closed: nothing more is markup
                at = n
                break
            at = k + 1
            if not m[4]:
                continue
            tag = m[4].lower()
            if m[3]:
                self.closing(tag)
            elif tag in _RAW:
                k = _RAW_END[tag].search(page, at)
                self.parts.append(" ")
                close = page.find(">", k.end()) if k else -1
                at = close + 1 if close >= 0 else n
            else:
                self.opening(tag, page[m.end() : at - 1])
        self.text(at, n)
        self.end()

    def closing(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        elif tag == "span":
            if self.stack.items[-1].tag == "span":
                self.end()
                self.stack.cut(len(self.stack.items) - 1)
        elif tag not in _INLINE:
            self.end()
            self.stack.close(tag)
            self.heading = 0

    def opening(self, tag: str, inside: str) -> None:
        if tag == "a":
            self.in_link = 1
            self.n_links += 1
            return
        if tag == "br":
            self.parts.append(" ")
            return
        level, main = self.named(inside) if ("=" in inside or "hidden" in inside) and tag not in ("body", "html") else (0, False)
        if tag in _INLINE and not (tag == "span" and level):
            return
        self.end()
        if tag in _VOID:
            return
        if tag != "span":
            self.stack.open_block(tag)
            self.heading = int(tag in _HEADINGS)
        up = self.stack.items[-1]
        e = _Element(tag, up.dropped, up.article, up.layout)
        if tag in _CONTENT or main:
            e.article, e.layout = 1, 0
        if tag in _UNSEEN:
            e.dropped = 2
            if inside.endswith("/"):
                return
        elif tag in _DROPPED or level == 2:
            e.dropped = max(1, e.dropped)
        elif (level == 1 and not (e.article and self.only_header)) or tag == "form" or (tag == "header" and not e.article):
            self.parents.append(e.layout)
            self.words.append(0)
            e.layout = len(self.parents) - 1
        self.stack.push(e)

    def named(self, inside: str) -> tuple[int, bool]:
        """What an element's attributes say: the level of its names, and whether it is the main element by role."""
        level, main, header = 0, False, True
        for key, a, b, c in _ATTRIBUTE.findall(inside):
            key, value = key.lower(), a or b or c  # noqa: PLW2901
            if key in ("class", "id", "role"):
                main = main or (key == "role" and value.lower() == "main")
                for token in value.split():
                    if now := _level(token):
                        level, header = max(level, now), header and token.lower().endswith("header")
            elif key == "style" and re.search(r"display\s*+:\s*+none", value, re.I):
                level, header = 2, False
        if "hidden" in inside and _HIDDEN.search(_QUOTED.sub("", inside)):
            level, header = 2, False
        self.only_header = header
        return level, main


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, without those of elements that hold no text."""
    p = _Page(page)
    found = [b for b in p.out if b.boiler < 2]
    total = sum(p.words)
    for k in range(len(p.parents) - 1, 0, -1):
        p.words[p.parents[k]] += p.words[k]
    content = any(b.article and not b.boiler for b in found)
    marks = [0]
    for k in range(1, len(p.parents)):
        marks.append(int(marks[p.parents[k]] or content or p.words[k] < _WHOLE * total))
    for b in found:
        b.boiler = max(b.boiler, marks[b.layout])
    return found


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """For each block: words, link density, both of the blocks before and after, boilerplate, article, heading, links, words a link, imprint."""
    flat = [(float(b.words), b.linked / b.words) for b in found]
    none = (0.0, 0.0)
    out = []
    for i, b in enumerate(found):
        before, after = flat[i - 1] if i else none, flat[i + 1] if i + 1 < len(flat) else none
        imprint = not b.article and b.words <= 40 and _IMPRINT.match(b.text) is not None
        out.append((*flat[i], *before, *after, float(b.boiler), float(b.article), float(b.heading), float(b.links), b.linked / b.links if b.links else 0.0, float(imprint)))
    return out


def labelled_pages() -> list[str]:
    """The labelled pages, made by rule: words of main text are spelled ``m``, all others ``x``."""

    def text(kind: str, n: int, linked: int = 0) -> str:
        plain = " ".join([kind] * (n - linked))
        return f"{plain} <a>{' '.join([kind] * linked)}</a>" if linked else plain

    def p(n: int, linked: int = 0, kind: str = "m") -> str:
        return f"<p>{text(kind, n, linked)}</p>"

    def menu(n: int, words: int = 1) -> str:
        return "<ul>" + "".join(f"<li><a>{text('x', 1 + (k + words) % 3)}</a></li>" for k in range(n)) + "</ul>"

    def title(n: int) -> str:
        return f"<h1>{text('m', n)}</h1>"

    def bar(n: int, tag: str, sign: str, words: int = 1) -> str:
        return f"<{tag}>" + sign.join(f"<a>{text('x', 1 + (k + words) % 3)}</a>" for k in range(n)) + f"</{tag}>"

    pages = []
    sizes = (1, 2, 4, 8, 15, 30, 60, 150)
    for i, a in enumerate(sizes):
        for j, b in enumerate(sizes):
            k = (i + j) % 4
            advert = f"<div class='ad'>{text('x', b, b // 2 * (j % 2))}</div>" if i % 2 else ""
            share = "<div class='share'>" + "".join(f"<a>{text('x', 1 + s)}</a>" for s in range(1 + j % 2)) + "</div>"
            replies = f"<div id='comments'>{p(a, 0, 'x')}{p(b, 0, 'x')}</div>" if k == 0 else ""
            footer = f"<footer>{text('x', a, a // 3)}</footer>" if j % 5 else ""
            # an article element: all in it but marked boxes, also paragraphs and items that are links
            body = (title(a) if j % 4 else "") + p(b, b // 4 * (i % 2)) + (p(a, a) if k == 1 else "") + p(a) + (share if k == 2 else "") + (f"<ul><li>{text('m', b)}</li><li>{text('m', a, a)}</li></ul>" if k == 3 else "") + p(b)
            pages.append(f"<nav>{menu(k + 1)}</nav>{advert}<article>{body}</article>{replies}{footer}")
            pages.append(f"<div class='sidebar'>{menu(k, 2)}{p(a, 0, 'x')}<main>{p(b)}{share}{p(a, a // 2)}</main></div>")
            # plain containers: menus and lists of links around prose
            around, after = menu(k + 2, j), menu(2 + j % 4, i)
            prose = (title(3 + a // 10) if i % 3 else "") + p(40 + a, a // 9) + (p(4 + j) if k == 1 else "") + (f"<ul><li>{text('m', 5 + i)}</li><li>{text('m', 7 + j)}</li></ul>" if k == 2 else "") + p(30 + b, b // 5)
            pages.append(f"<div>{around}</div><div>{prose}</div><div>{after if j % 4 else ''}</div>")
            pages.append(f"<div class='header'>{text('x', a)}</div>{around}<div>{prose}{p(25 + a)}</div><div>{after}</div><div>{text('x', 3 + j % 3, 1)}</div>")
            # the same with labels between menus, a line of imprint after links, and prose that is rich in links
            imprint = f"<div>{text('x', 2 + i)}</div>"
            pages.append(f"<div>{text('x', 1 + j % 3)}</div>{around}<div>{text('x', 1 + i % 4)}</div>{menu(2, i)}<div>{prose}{p(35 + a, (35 + a) * (1 + j % 3) // 8)}</div>{menu(2 + k, j)}{imprint}")
            # flat bars of links, with and without signs between, around and within content; rights at the end
            n = (2, 3, 4, 6, 8, 15, 25, 40)
            top, low = bar(n[i], ("div", "p")[j % 2], (" ", " | ", " &middot; ", "")[k], j), bar(n[j], ("p", "div")[i % 2], ("", " / ", " ", " | ")[k], i)
            rights = f"<div>&copy; {text('x', 1 + i)}</div>" if j % 2 else f"<p>Copyright {text('x', 2 + j)}</p>"
            brief = "".join(p(1 + (a + b + s) % 9) for s in range(1 + (i + k) % 5))
            pages.append(f"{top}<article>{body}</article>{low}{rights if k else ''}")
            pages.append(f"{top}<article>{title(3 + a // 10)}{p(b)}{low}{p(a)}</article>{bar(n[-1 - i], 'div', ' ')}")
            pages.append(f"{top}<div>{prose}</div>{low if k < 3 else ''}{rights if k != 1 else ''}")
            uneven = "".join(p((9 + (a + s) % 25, 1 + (b + s) % 5)[s % 3 > 0]) for s in range(2 + (i + j) % 6))
            one = p(10 + (17 * i + 29 * j) % 100)
            pages += [f"{bars}{'<div>' if j % 2 else ''}{one}{'</div>' if j % 2 else ''}{end}" for bars in (top, low, top + low, menu(1 + j, i)) for end in ("", rights, bar(n[k + 2], "div", " "))]
            pages.append(f"{top}<div>{brief}</div>{low}{rights if k == 2 else ''}")
            pages.append(f"{top}<div>{uneven}</div>{low if k else ''}{rights if k % 2 else ''}")
            pages.append(f"{top}{low}<div>{title(2 + j % 4) if k else ''}{p(a)}</div>{low if k % 2 else ''}{rights if i % 2 else ''}")
            # short pages: a block or two that no link is near; lists of links alone
            pages.append(p(a) if j % 2 else f"{text('m', a)}")
            pages.append(title(1 + i) + p(b) if i % 2 else p(a) + p(b))
            pages.append(menu(3 + k, i) + menu(2 + i % 3, j))
    return pages


@dataclass
class Node:
    kept: bool
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def verdict(self, row: tuple[float, ...]) -> bool:
        at = self
        while at.feature >= 0:
            at = at.low if row[at.feature] <= at.cut else at.high
        return at.kept


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 10, least: int = 3) -> Node:
    """A tree by greatest fall of Gini impurity; ties go to the earlier feature and lower cut."""
    return _grow(np.array([x for x, _ in rows], np.float64).reshape(len(rows), -1), np.array([y for _, y in rows], np.int64), depth, least)


def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int) -> Node:
    n, ones = len(y), int(y.sum())
    leaf = Node(2 * ones > n)
    if not depth or ones in (0, n):
        return leaf
    best, choice = 2 * ones * (n - ones) / n - 1e-9, None
    left = np.arange(1, n)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, seen = x[order, f], np.cumsum(y[order])[:-1]
        impurity = 2 * seen * (left - seen) / left + 2 * (ones - seen) * (n - left - ones + seen) / (n - left)
        impurity[(v[1:] <= v[:-1]) | (left < least) | (n - left < least)] = np.inf
        if n > 1 and impurity.min() < best:
            at = int(impurity.argmin())
            best, choice = float(impurity[at]) - 1e-9, (f, float(v[at] + v[at + 1]) / 2)
    if choice is None:
        return leaf
    f, cut = choice
    low = x[:, f] <= cut
    return Node(leaf.kept, f, cut, _grow(x[low], y[low], depth - 1, least), _grow(x[~low], y[~low], depth - 1, least))


def labelled_rows(pages: list[str]) -> list[tuple[tuple[float, ...], int]]:
    """Features and label of every block of labelled pages."""
    return [(x, int(b.text.startswith("m"))) for page in pages for found in [blocks(page)] for b, x in zip(found, features(found), strict=True)]


@lru_cache(1)
def default_tree() -> Node:
    return grow(labelled_rows(labelled_pages()))


def main_text(page: str | None, tree: Node | None = None) -> str:
    found = blocks(page or "")
    tree = tree or default_tree()
    return " ".join(b.text for b, x in zip(found, features(found), strict=True) if tree.verdict(x))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), tree: Node | None = None) -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars`` (code points) of each page; the tree is grown once, by the driver."""
    chosen = pages.select(*(pages[c] for c in keep), pages[html_col].cast("string").alias("_html"))
    tree = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p, tree) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    from pyspark.sql.types import LongType, StringType, StructType

    return chosen.mapInArrow(run, StructType([f for f in chosen.schema.fields if f.name != "_html"]).add("text", StringType()).add("n_chars", LongType()))
