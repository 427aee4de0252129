"""Main text of hand-made pages and of the pages table."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from quarry.llm import html_extract as h

LONG = "This paragraph has a good many words so that it reads like prose and not like a menu at all. " * 3
CASES = [
    (None, ""),
    ("", ""),
    ("<html><body></body></html>", ""),
    ("<nav><ul><li><a href='/x'>X</a></li></ul></nav><article><h1>Head &amp; tail</h1><p>a &lt; b  &#8364;\n c</p></article><footer>&copy; site</footer>", "Head & tail a < b € c"),
    ("<article><p><b>bold<br><p>next</p><p>x<i>y</i>z</article>", "bold next xyz"),
    ("<div class='ad'>Buy now</div><main><p>One.</p><aside>Side text</aside><p>Two.</p></main><div id='comments'><p>" + LONG + "</p></div>", "One. Two."),
    ("<article><p>Kept<script>var x='<p>no</p>'</script></p><style>p{}</style><!-- gone <p>no</p> --><p>too</p></article>", "Kept too"),
    ("<article><p>Text</p><!-- never closed <p>lost</p></article>", "Text"),
    ("<article><p>&am &amp &quot;q&quot;</p><form><p>Name</p><input></form></article>", '&am & "q"'),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Body.</p></article>", "Title Body."),
    ("<article><p class='notice'>Accept cookies</p><p>Body text.</p><div class='share'><a>Share</a></div></article>", "Body text."),
    ("<article><p>a < b and 2<3</p></article>", "a < b and 2<3"),
    ("<article><p>open", "open"),
    ("</div></article><article><p>fine</p></div><p>still</p></article>", "fine still"),
    ("<ul><li><a>Home</a></li><li><a>News</a></li></ul><div><h1>The title of the page</h1><p>" + LONG + "</p><p>" + LONG + "</p></div><ul><li><a>Imprint</a></li></ul>", "The title of the page " + " ".join((LONG + LONG).split())),
    ("<article><p>1</p>" + "<p>w</p>" * 5000 + "</article>", "1" + " w" * 5000),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_pages(page, want):
    assert h.main_text(page) == want


def test_tree_learns_its_table():
    rows = h.labelled_rows(h.labelled_pages())
    assert sum(h.default_tree().verdict(x) == bool(y) for x, y in rows) >= 0.98 * len(rows)


def test_tree_left_out_pages():
    pages, right, total = h.labelled_pages(), 0, 0
    for k in range(0, len(pages), 3):
        tree = h.grow(h.labelled_rows(pages[:k] + pages[k + 1 :]))
        rows = h.labelled_rows(pages[k : k + 1])
        right, total = right + sum(tree.verdict(x) == bool(y) for x, y in rows), total + len(rows)
    assert right >= 0.93 * total


PROSE = " ".join(["word"] * 60)
ARTICLE = f"<article><p>{PROSE}</p></article>"
PROBES = [
    # names of layout end at an article; names that hold other words mean nothing
    (f'<div class="layout sidebar-right">{ARTICLE}</div>', PROSE),
    (f'<div class="header-fixed sidebar"><div class="banner">{ARTICLE}</div></div>', PROSE),
    (f'<div class="content notice-board">{ARTICLE}</div>', PROSE),
    (f'<form id="aspnetForm" action="x">{ARTICLE}</form>', PROSE),
    (f'<main class="search-page"><p>{PROSE}</p></main>', PROSE),
    (f'<div role="main"><p>{PROSE}</p></div>', PROSE),
    (f'<article><p>{PROSE}</p><section class="share-price-report"><p>Up two.</p></section></article>', PROSE + " Up two."),
    (f'<article><div class="entry-header"><h1>Title</h1></div><div class="header"><p>Lead</p></div><p>{PROSE}</p></article>', "Title Lead " + PROSE),
    # without an article, a layout container that holds all words is the page
    (f'<nav><a>Home</a></nav><div class="sidebar"><h1>Title</h1><p>{PROSE}</p></div>', "Title " + PROSE),
    # linked paragraphs and items of an article stay, marked boxes go
    ("<article><p><a>A linked paragraph</a></p><ul><li><a>An item</a></li><li>Another</li></ul></article>", "A linked paragraph An item Another"),
    (f'<article><p>{PROSE}</p><div class="related-posts"><article><p>Read this too</p></article></div></article>', PROSE),
    (f'{ARTICLE}<section id="comments"><article><p>{PROSE}</p></article></section>', PROSE),
    (f'{ARTICLE}<div style="display: none"><p>{PROSE}</p></div><div hidden><p>{PROSE}</p></div><p aria-hidden="true" class="x">{PROSE}</p>', PROSE + " " + PROSE),
    # little text, or none of the markup of a page
    ("<p>x</p>", "x"),
    ("plain text, no tags", "plain text, no tags"),
    ("one < two", "one < two"),
    # broken markup
    (f'<article><p title="a > b">{PROSE}</p><p class="never closed>lost</p><p>Kept.</p></article>', PROSE + " lost Kept."),
    (f"<article><p>{PROSE}<div class=x>y</div></article>", PROSE + " y"),
    ("<article><p>a&#99999999999999;b&#" + "9" * 6000 + ";c</p></article>", "a�b�c"),
    (f"<article><svg><text>no</text><path/></svg><button>no</button><p>{PROSE}</p></article>", PROSE),
    (f"<table><tr><td><ul><li><a>Home</a></li></ul></td><td><div><p>{PROSE}</td></tr></table>", PROSE),
]


@pytest.mark.parametrize(("page", "want"), PROBES)
def test_probes(page, want):
    assert h.main_text(page) == want


N = 1_000_000
HOSTILE = {
    "quotes and scripts": "<p x='" * (N // 14) + "<script" * (N // 14), "unclosed links": '<a "' * (N // 4), "less-than": "<" * N, "stray ends": "<div>" * (N // 10) + "</x>" * (N // 10),
    "spans in items": "<li><div>" + "<span class=ad>" * (N // 30) + "</li>" * (N // 10), "ampersands": "&" * N, "one class": '<p class="' + "a-" * (N // 2) + '">x', "one attribute": "<p " + "a" * N + "=>x",
    "quoted values": "<p " + 'a="' * (N // 3) + ">x", "comments": "<!--" * (N // 4), "paragraphs": "<p>" * (N // 3), "quotes to the end": '<a x="' * (N // 6) + ">", "digits": "&#x" + "f" * N, "spaces": "<p a" + " " * N + '">x',
    "sidebars": "<div class=sidebar>" * (N // 19) + "x", "end tags": "<div>" * (N // 11) + "</div>" * (N // 11), "scripts": "<script>" * (N // 8), "cells": "<table><td>" * (N // 22) + "</p>" * (N // 8),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    h.default_tree()
    began = time.process_time()
    h.main_text(HOSTILE[name])
    assert time.process_time() - began < 3  # about a second at most; quadratic time would be minutes


@pytest.mark.parametrize("semantic", [True, False])
def test_made_pages_without_article(semantic):
    """Prose between menus, told by words and links alone where no element or class says what is what."""
    r = random.Random(4)
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    for _ in range(200):
        menu = lambda: "<ul>" + "".join(f"<li><a href='/'>{words(r.randint(1, 3))}</a></li>" for _ in range(r.randint(2, 9))) + "</ul>"
        body = [words(r.randint(4, 10)), *(words(r.randint(15, 120)) for _ in range(r.randint(2, 6)))]
        inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{b}</p>" for b in body[1:])
        top, tail = ("nav", "footer") if semantic else ("div", "div")
        page = f"<body><{top}>{menu()}</{top}><div id='{words(1)}'>{inner}</div><{tail}>{menu()}</{tail}></body>"
        assert h.main_text(page) == " ".join(body)


def test_pages_table(spark, sf):
    """Each page there has one article element: its text is what is wanted."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = h.extract(pages).collect()
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
    assert len(got) == len(want)
    for r in got:
        assert r.text == want[r.page_id]
        assert r.n_chars == len(r.text)


def test_pages_table_without_article_elements(spark, sf):
    """The same pages with the article in a plain container give the same texts."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", "<(/?)article>", "<$1div>"))
    assert sorted(h.extract(plain).collect()) == sorted(h.extract(pages).collect())


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "<article>x</article>", "t", 7), (1, "u", "<article>x</article>", "t", 7), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    out = h.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in out.collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert h.extract(df.limit(0)).collect() == []


WORDS = "river stone light carry under north window paper train seven quiet market letter summer engine".split()


def link_bar(r, n, style):
    say = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(1, 3)))
    sign = r.choice([" ", "\n", " | ", " · ", " &raquo; ", " / "])
    links = sign.join(f'<a href="/{i}">{say()}</a>' for i in range(n))
    return (f"<div>{links}</div>", f"<p>{links}</p>", f"<div><div>{links}</div></div>", f"<p class='x'>{links}</p>")[style]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8, 15, 40])
@pytest.mark.parametrize("style", [0, 1, 2])
def test_flat_link_bars_are_no_text(n, style):
    r = random.Random(n)
    bar = link_bar(r, n, style)
    for page in (f"{bar}{ARTICLE}", f"{ARTICLE}{bar}", f"{bar}<main><p>{PROSE}</p></main>{bar}", f"{bar}<p>{PROSE}</p>{bar}", f"{bar}<div><p>{PROSE}</p><p>{PROSE}</p></div>{bar}"):
        assert h.main_text(page) == (PROSE + " " + PROSE if page.count(PROSE) == 2 else PROSE)
    if n > 3:
        assert h.main_text(f"<article><p>{PROSE}</p>{bar}<p>{PROSE}</p></article>") == PROSE + " " + PROSE
    assert h.main_text(f"{bar}<p>{PROSE}</p><div>Copyright 2020 Example Corp. All rights reserved.</div>") == PROSE
    assert h.main_text(f"<p>{PROSE}</p><div>Copyright 2020 Example Corp. All rights reserved.</div>") == PROSE


def random_page(r, kind):
    """A page and its main text; shares nothing with the labelled pages of the library."""
    say = lambda lo, hi: " ".join(r.choice(WORDS) for _ in range(r.randint(lo, hi)))
    inner, want = [], []

    def put(tag, text, shown=None):
        inner.append(f"<{tag}>{shown or text}</{tag}>")
        want.append(text)

    if kind == "short":
        for _ in range(r.randint(2, 9)):
            put("p", say(3, 12))
    elif kind == "terms":
        for _ in range(r.randint(2, 6)):
            put("dt", say(1, 3))
            put("dd", say(6, 30))
    elif kind == "table":
        put("p", say(10, 30))
        inner.append("<table>")
        for _ in range(r.randint(2, 5)):
            inner.append("<tr>")
            put("td", say(1, 4))
            put("td", say(2, 9))
            inner.append("</tr>")
        inner.append("</table>")
        put("p", say(10, 30))
    elif kind == "questions":
        for _ in range(r.randint(2, 5)):
            put("h3", say(4, 8) + "?")
            put("p", say(8, 40))
    elif kind == "links":
        for _ in range(r.randint(2, 5)):
            plain, marked = [], []
            for _ in range(r.randint(2, 5)):
                x, y = say(4, 12), say(1, 3)
                plain += [x, y]
                marked += [x, f'<a href="/q">{y}</a>']
            z = say(3, 9)
            put("p", " ".join([*plain, z]), " ".join([*marked, z]))
    else:
        put("p", say(20, 90))
    body = "".join(inner)
    bar = lambda: link_bar(r, r.randint(2, 40), r.randrange(4))
    imprint = r.choice(["", f"<div>Copyright {r.randint(1999, 2024)} {say(1, 3)}. All rights reserved.</div>", f"<p>&copy; 2020 {say(1, 3)}</p>"])
    page = r.choice([f"{bar()}<article>{body}</article>{bar()}{imprint}", f"{bar()}<main>{body}</main>{imprint}", f"{bar()}<div>{body}</div>{bar()}{imprint}", f"{bar()}{bar()}<div><div>{body}</div></div>{imprint}"])
    return f"<body>{page}</body>", " ".join(want)


def test_random_pages_with_link_bars():
    r, kinds, wrong = random.Random(12), ("short", "terms", "table", "questions", "links", "one"), 0
    for i in range(1800):
        page, want = random_page(r, kinds[i % 6])
        wrong += h.main_text(page) != want
    assert wrong <= 3
