from __future__ import annotations

import pytest

from findrift.llm import htmltext
from findrift.llm.common import table

WORDS = "Many words of the story follow one another here, and so the paragraph is long. " * 3
HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body class='has-sidebar'>"


def page(body: str) -> str:
    return HEAD + body + "</body></html>"


CASES = {
    "article": (
        page(f"<nav><ul><li><a href='/'>Home</a></ul></nav><div class=ad>Buy</div><article><h1>Head &amp; line</h1><p>{WORDS}<p>Short.<br>Two</p>"
             "<div class='ad-slot'>Buy this</div><aside>Side</aside><section class='comments'><p>First!</p></section></article>"
             "<footer>&copy; us</footer>"),
        f"Head & line\n{WORDS.strip()}\nShort. Two",
    ),
    "no article element": (
        page(f"<div id='header'>Site</div><div id='menu'><a href='#'>x</a> <a>y</a></div><div class='cookie-notice'>We use cookies</div>"
             f"<div class='content'><p>{WORDS}</p><p>Ok.</p><p>{WORDS}</p><form><p>Mail <input></p></form></div>"
             f"<div class='comment-list'><p>{WORDS}</p></div><div id=footer>end</div>"),
        f"{WORDS.strip()}\nOk.\n{WORDS.strip()}",
    ),
    "unclosed": (f"<p><b>{WORDS}<br><p>next <i>one", f"{WORDS.strip()}\nnext one"),
    "list and table": (
        page(f"<main><p>{WORDS}</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><blockquote>q</blockquote></main>"),
        f"{WORDS.strip()}\na\nb\nc\nd\nq",
    ),
    "references": (page("<article><p>a &lt;b&gt; &eacute;&#233;&#x1F600; &nbsp; c&&amp;</p></article>"), "a <b> éé\U0001f600 c&&"),
    "inline advert": (page(f"<article><p>{WORDS}<span class=ad>Buy</span> more</p></article>"), f"{WORDS.strip()} more"),
    "only script": ("<script>var x = 1;</script>", ""),
    "text": ("no markup  at\nall", "no markup at all"),
    "null": (None, ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    html, want = CASES[name]
    assert htmltext.main_text(html) == want


def test_query_shape(spark, sf_dir):
    rows = [(i, "u", h, "clash") for i, (h, _) in enumerate(CASES.values())] + [(0, "u", None, "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract(df).collect()
    assert len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert htmltext.extract(df.limit(0)).count() == 0
    assert htmltext.extract(table(spark, sf_dir, "pages")).columns == ["page_id", "url", "text", "n_chars"]


def test_odd_markup_ends():
    for html in ("<", "<div " * 2000, "</p>" * 2000, "<div>" * 3000 + "x", "<!--" + "x" * 1000, "&#xFFFFFFFF; a", "<a" + " b" * 5000 + ">c"):
        assert isinstance(htmltext.main_text(html), str)
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(20_000)) + "</article>"
    assert htmltext.main_text(long).count("\n") == 19_999


BODY = f"<div><p>{WORDS}</p><p>{WORDS * 6}</p><p>{WORDS * 6}</p><p>{WORDS * 6}</p></div>"
BODY_TEXT = "\n".join([WORDS.strip(), *[(WORDS * 6).strip()] * 3])
WIDE = {
    "title and lead beside the body": (f"<div><h1>Title</h1><p>lead</p>{BODY}</div><div id=footer>end</div>", f"Title\nlead\n{BODY_TEXT}"),
    "heading of a main": (f"<main><h1>Title</h1><article>{BODY}</article></main>", f"Title\n{BODY_TEXT}"),
    "heading beside an article": (f"<div><h2>Title</h2><article>{BODY}</article></div><nav>x</nav>", f"Title\n{BODY_TEXT}"),
    "two articles": (f"<div><article>{BODY}</article><article><p>{WORDS * 8}</p></article></div><div>Site</div>", f"{BODY_TEXT}\n{(WORDS * 8).strip()}"),
}


@pytest.mark.parametrize("name", WIDE)
def test_wide_regions(name):
    html, want = WIDE[name]
    assert htmltext.main_text(page(html)) == want


def article(n: int) -> list[str]:
    return [f"This is paragraph {i} of the article, with enough words in it to stand for real prose and not for a menu." for i in range(n)]


def test_the_cluster_decides_where_nothing_is_named():
    """No article or main, no class names: menus and footers are told by their density alone."""
    links = [f"<a href='/{i}'>Link {i}</a>" for i in range(12)]
    body = article(6)
    prose = "<h2>Title</h2>" + "".join(f"<p>{x}</p>" for x in body)
    want = "\n".join(["Title", *body])
    menu = "<div>" + "".join(f"<div>{x}</div>" for x in links) + "</div>"
    listed = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
    small = "<div><div>(c) 2024 Somebody</div><div>All rights</div></div>"
    assert htmltext.main_text(f"<body>{menu}<div>{prose}</div>{small}</body>") == want
    assert htmltext.main_text(f"<body>{menu}{prose}{small}</body>") == want
    assert htmltext.main_text(f"<body>{listed}{prose}{listed}{small}</body>") == want
    assert htmltext.main_text(f"<body><table><tr><td>{listed}</td><td>{prose}</td></tr></table>{small}</body>") == want


def test_the_cluster_is_needed(monkeypatch):
    import numpy as np

    page = "<body><div><div><a href=x>One</a></div><div><a href=y>Two</a></div></div>" + "".join(f"<p>{x}</p>" for x in article(4)) + "<div>(c) me</div></body>"
    assert htmltext.main_text(page) == "\n".join(article(4))
    everything = lambda lengths, tags, picked=None: np.ones(len(lengths), bool)
    monkeypatch.setattr(htmltext, "content_lines", everything)
    monkeypatch.setattr(htmltext, "long_lines", everything)
    assert "One" in htmltext.main_text(page) and "(c) me" in htmltext.main_text(page)


def test_short_lines_among_paragraphs_stay():
    body = article(3)
    page = f"<body><div><p>{body[0]}</p><p>Yes.</p><ul><li>a</li><li>b</li></ul><p>{body[1]} See <a href=x>this page</a>.</p><blockquote>No.</blockquote><p>{body[2]}</p></div></body>"
    assert htmltext.main_text(page) == "\n".join([body[0], "Yes.", "a", "b", body[1] + " See this page.", "No.", body[2]])


def test_deep_and_broken_markup_is_linear():
    import time

    began = time.time()
    assert htmltext.main_text("<b>" * 64_000 + "</i>" * 64_000 + "x") == "x"
    assert htmltext.main_text("<div>" * 64_000 + "text here" + "</div>" * 64_000) == "text here"
    assert htmltext.main_text("<div><p>a b c" * 32_000).count("\n") == 31_999
    assert time.time() - began < 20
