import time

import numpy as np
import pytest

from noticelake.llm import extract

LONG = "This paragraph is the article, with commas, and stops. It goes on for a while, as articles do."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{body}</body></html>"


def test_article_without_its_surroundings():
    found = extract.main_text(page(
        f"<header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav><div class='cookie-notice'>We use cookies, accept.</div>"
        f"<article><h1>Title &amp; more</h1><p>{LONG}<p>Short<br>line &eacute;&nbsp; x &lt;b&gt;<ul><li>one<li>two</ul>"
        f"<aside>aside</aside><div class='ad'>Buy, now!</div><form><p>mail</p></form><table><tr><td>c1<td>c2</table></article>"
        f"<section id='comments'><p>{LONG} says a reader.</p></section><footer>&copy; 2026</footer>"))
    assert found == f"Title & more\n{LONG}\nShort line é x <b>\none\ntwo\nc1\nc2"


def test_content_without_article_element():
    found = extract.main_text(page(
        f"<div id=wrap><div class=links><a>a</a> <a>b</a></div><div class=post><p>{LONG}</p><p>{LONG} Again.</p><p>End</p></div>"
        f"<div class='sidebar'><p>{LONG}</p></div></div>"))
    assert found == f"{LONG}\n{LONG} Again.\nEnd"


@pytest.mark.parametrize("body, text", [
    ("", ""), ("<p></p>", ""), ("plain", "plain"), ("a <b>b</b> <i>c", "a b c"), ("x < y & z &amp", "x < y & z &"),
    ("<p>a<!-- <p>no</p> -->b</p>", "ab"), ("<p>a<!-- never closed <p>b", "a"), ("<p title='a>b'>c</p>", "c"),
    ("<p title=don't>c</p><p>it's</p>", "c\nit's"), ("<script>x<p>", ""), ("</p></div>a", "a"), ("<p hidden>a</p><p>b</p>", "b"),
    ("<DIV>A</DIV><Script>x</SCRIPT>b", "A\nb"), ("<select><option>a<option>b</select>c", "c"), ("<br>a<hr>b<img alt='>'>c", "a\nbc")])
def test_broken_markup(body, text):
    assert extract.main_text(body) == text


def test_linear_in_hostile_pages():
    start = time.perf_counter()
    for part in ("<", "<a ", "<!-- ", "<script>", '<a b="', "<a b='x' ", "<p>", "<div>a", "</p>", "&", "<td>", "<![", "<b>"):
        extract.main_text(part * (200_000 // len(part)))
    assert time.perf_counter() - start < 30


def test_awkward_rows(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</article>"), 1), (1, "u", page(f"<article><p>{LONG}</article>"), 1),
            (None, None, None, None), (2, "v", "", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = extract.extract(pages)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found.collect()) == [
        (0, "", 0), (1, LONG, len(LONG)), (1, LONG, len(LONG)), (2, "", 0)]
    assert extract.extract(pages.limit(0)).count() == 0


def test_long_tags_keep_their_quotes():
    data = "x" * 5000
    assert extract.main_text(page(f"<article><p data-a='{data}' data-b='1 > 0' data-c = \"<p>\">{LONG}</p></article>")) == LONG
    assert extract.main_text(f"<p {'a ' * 3000} title='b>c'>d</p>") == "d"


def test_deep_elements_close_nothing_outside():
    deep = "<div>" * 600 + "deep" + "</div>" * 600
    assert extract.main_text(page(f"<div><article><div>{deep}</div><p>{LONG}</p></article><p>after</p></div>")) == f"deep\n{LONG}"
    paragraphs = "<div>" * 600 + "<p>a<p>b<ul><li>c<li>d</ul></div>" + "</div>" * 599
    assert extract.main_text(page(f"<div><article>{paragraphs}<p>{LONG}</p></article><p>after</p></div>")) == f"a\nb\nc\nd\n{LONG}"


@pytest.mark.parametrize("wrapper", [
    "<div class='page has-sidebar'>", "<div class='with-comments'>", "<div id='search-layout'>", "<form id='aspnetForm'>",
    "<form><div role='search'><div class='has-sidebar'>"])
@pytest.mark.parametrize("kind", ["article", "main", "div"])
def test_a_hint_around_the_article_skips_nothing(wrapper, kind):
    rest = f"<div class='comments'><article><p>{LONG[:60]}, says a reader.</p></article></div>" if kind != "div" else ""
    found = extract.main_text(page(
        f"<nav>Home</nav>{wrapper}<{kind}><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div class='ad'>Buy, now!</div></{kind}>{rest}"
        "</form></div><footer>f</footer>"))
    assert found == f"Title\n{LONG}\n{LONG}"


def test_a_hint_inside_the_article_around_its_text():
    found = extract.main_text(page(f"<article><h1>Title</h1><div class='post share'><p>{LONG}</p><p>{LONG}</p></div></article>"))
    assert found == f"Title\n{LONG}\n{LONG}"


@pytest.mark.parametrize("body, text", [
    (f"<p title='the hidden cost' data-style='display:none'>{LONG}</p>", LONG),
    (f"<p>{LONG} <a class='ad'>Buy now</a><ins class=adsbygoogle>AD</ins><span style='display:none'>x</span>end</p>", f"{LONG} end"),
    (f"<p>{LONG}</p><span hidden><div>gone</div></span><p>b", f"{LONG}\nb"),
    (f"<p>a <span class='ad'>never closed</p><p>{LONG}</p>", f"a\n{LONG}"),
    (f"<p>{LONG} a<script>var x = '<p>';</script>b<style>p</style> c</p>", f"{LONG} ab c"),
    (f"<p>{LONG}</p><ul class='more-like-this'><li><a href=x>One thing</a><li><a href=y>Other thing, too</a></ul><p>{LONG}</p>", f"{LONG}\n{LONG}"),
    (f"<p>{LONG} <a href=x>a link</a> in it</p><ul><li>plain<li>list</ul>", f"{LONG} a link in it\nplain\nlist"),
    (f"<h2>A <a href=x>b</a> title</h2><p>{LONG}</p>", f"A b title\n{LONG}")])
def test_inside_the_article(body, text):
    assert extract.main_text(page(f"<article>{body}</article>")) == text


def test_sibling_articles_are_one():
    other = LONG.replace("article", "second part")
    found = extract.main_text(page(f"<div><article><p>{LONG}</p><p>{LONG}</p></article><article><p>{other}</p></article>"
                                   "<article><a href=x>More</a></article></div>"))
    assert found == f"{LONG}\n{LONG}\n{other}"


def test_flat_page_without_names(monkeypatch):
    flat = page(f"<div>Home | Contact</div><h1>Title</h1><p>{LONG}</p><div>A short line</div><p>{LONG}</p><p>{LONG}</p>"
                "<div><a href=a>Imprint</a> <a href=b>Terms</a></div>")
    assert extract.main_text(flat) == f"Title\n{LONG}\nA short line\n{LONG}\n{LONG}"
    monkeypatch.setattr(extract, "scores", lambda found: np.ones(len(found)))  # without scores nothing is told apart
    assert "Home | Contact" in extract.main_text(flat) and "Imprint" in extract.main_text(flat)
