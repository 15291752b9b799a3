import html
import os
import re
import time

import pytest

from docnest.llm import html_text
from docnest.llm.html_text import main_text

SF = "/root/testdata/sf0.01"
PROSE = "This is a sentence, with a comma, that goes on for a while so that it reads like the body of an article."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>Head</h1><p>{PROSE}<p>Two&nbsp;&amp; <b>three<br>four</article><footer>foot</footer>", f"Head\n{PROSE}\nTwo & three four"),
        (f"<div class='site-header'><h1>Site</h1></div><div id=content><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p><div class='share-links'>Share me</div></div><div class=sidebar><p>{PROSE}</p></div>", f"Head\n{PROSE}\n{PROSE}"),
        (f"<main><section><p>{PROSE}</p></section><section><p>Short.</p></section><section id=comments><article class=comment><p>{PROSE}</p></article></section></main>", f"{PROSE}\nShort."),
        (f"<form><p>{PROSE}</p></form><div><p>{PROSE}</p><ul><li>One<li>Two</ul></div><div class='cookie-notice'>{PROSE}</div>", f"{PROSE}\nOne\nTwo"),
        (f"<div><div><p>{PROSE}</p></div><div><p>{PROSE} More.</p></div><div>{'<a href=a>link text here</a> ' * 9}</div></div>", f"{PROSE}\n{PROSE} More."),
        (f"<article><p>{PROSE}</p><aside>Aside</aside><div hidden>Hidden</div><!-- no --><p>End &lt;x&gt; &#233;</p></article>", f"{PROSE}\nEnd <x> é"),
        ("<article><h1>Only a head</h1></article>", "Only a head"),
        ("", ""),
        ("<p>unclosed <div><table><tr><td>a<td>b</table>", "unclosed\na\nb"),
    ],
)
def test_pages(body, want):
    assert main_text(page(body)) == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<div class='content has-sidebar'><p>{PROSE}</p><p>{PROSE}</p></div><div class=sidebar><p>{PROSE}</p></div>", f"{PROSE}\n{PROSE}"),
        (f"<div class='post-content no-sidebar'><p>{PROSE}</p></div>", PROSE),
        (f"<div class='content sidebar-left'><p>{PROSE}</p><p>{PROSE}</p></div><div class=footer>foot</div>", f"{PROSE}\n{PROSE}"),
        (f"<div id=side-layout><p>{PROSE}</p><p>{PROSE}</p></div><div class=menu><a href=x>Home</a></div>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE}</p><section id=discussion><h2>Talk</h2><p>{PROSE}</p></section><section id=related-work><p>{PROSE}</p></section></article>", f"{PROSE}\nTalk\n{PROSE}\n{PROSE}"),
        (f"<main><div class='entry ad-free'><p>{PROSE}</p></div></main>", PROSE),
        (f"<form id=aspnet><div><p>{PROSE}</p><p>{PROSE}</p></div></form>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE}</p><div class=discussion><div class=comment><p>{PROSE}</p></div></div></article>", PROSE),
        (f"<article><p>{PROSE}</p><div class=related-posts>{'<p><a href=a>' + PROSE + '</a></p>'}</div></article>", PROSE),
        (f"<div class=content><p>{PROSE}</p></div><div class=sidebar><p>{PROSE}</p><p>{PROSE}</p></div>", PROSE),
        (f"<div class='post category-promo comments-open'><p>{PROSE}</p><p>{PROSE}</p></div><p>{PROSE}</p>", f"{PROSE}\n{PROSE}\n{PROSE}"),
        (f"<div><p>{PROSE}</p></div><div id=comments>{f'<p>{PROSE}</p>' * 9}</div>", PROSE),
    ],
)
def test_one_word_of_a_class_does_not_cut_prose(body, want):
    assert main_text(page(body)) == want


def test_deep_and_odd_markup():
    assert main_text("<div>" * 5000 + f"<p>{PROSE}</p>") == PROSE
    assert main_text(f"<![if x]><p>{PROSE}</p></div></div><![endif]>") == PROSE
    assert main_text("just text") == "just text"
    assert main_text("<html></html>") == ""


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{PROSE}</p></article>"), "x"), (1, "u", page(f"<article><p>{PROSE}</p></article>"), "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<p>" + "word " * 50_000, "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.url or "", len(r.text), r.n_chars) for r in got) == [(0, "v", 0, 0), (1, "u", len(PROSE), len(PROSE)), (1, "u", len(PROSE), len(PROSE)), (2, "", 0, 0), (3, "w", 249_999, 249_999)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
def test_sample_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert main_text(r.html) == "\n".join(b for b in blocks if b)


P = "This is a paragraph of some length, with commas, and enough words in it to be read as prose by anyone."


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (f"<article><p>{P}</p></article><article><p>2 {P}</p></article>", f"{P}\n2 {P}"),
        (f"<main><h1>Head</h1><article><p>{P}</p></article><article><p>2 {P}</p></article></main>", f"Head\n{P}\n2 {P}"),
        (f"<h1>Head</h1><article><p>{P}</p></article><table><tr><td>1</td><td>2</td></tr></table>", f"Head\n{P}\n1\n2"),
        (f"<div><div><p>{P}</p><p>3 {P}</p></div><div>A short column.</div></div>", f"{P}\n3 {P}\nA short column."),
        (f"<div><a href=x>one</a> <a href=y>two</a></div><div><p>{P}</p><p>3 {P}</p></div>", f"{P}\n3 {P}"),
        (f"<nav>menu</nav><h1>Head</h1><div><p>{P}</p></div><aside>side</aside><footer>foot</footer>", f"Head\n{P}"),
        (f"<article><p>{P}</p></article><div class=comments><article><p>Reader: {P}</p></article></div>", P),
        (f"<article><p>{P}</p></article><p>{P}</p>", f"{P}\n{P}"),
    ],
)
def test_nothing_of_the_article_is_dropped(html, expected):
    assert html_text.main_text(f"<body>{html}</body>") == expected


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<div>" * n + "text", lambda n: "<span>" * n + "<p>a" * n, lambda n: "<blockquote>" * n + P, lambda n: "<td>" + "<span>" * n + "</b>" * n,
        lambda n: "<div><p>x" * n, lambda n: "<li>" * n, lambda n: "<table><tr><td>" * n + P, lambda n: "<ul><li>" * n + "</td>" * n,
    ],
)
def test_time_grows_with_the_page(make):
    def spent(n):
        start = time.process_time()
        html_text.main_text(make(n))
        return time.process_time() - start

    spent(1000)
    few, many = min(spent(5_000) for _ in range(2)), spent(50_000)
    assert many < 40 * few + 0.5  # ten times the page; a hundred times the time if it were quadratic
    assert many < 10


def test_every_page_at_once(spark):
    """The query's rows are those of the pages taken one by one, repeated rows and null ids included."""
    pages = [(i % 30 or None, "u", f"<h1>{i}</h1><article><p>{i % 7} {P}</p></article>") for i in range(60)] + [(1, None, None), (1, None, "")] * 2
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()
    want = [(i, u, html_text.main_text(h or ""), len(html_text.main_text(h or ""))) for i, u, h in pages]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
