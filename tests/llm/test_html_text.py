import re
from html import unescape

import pytest

from haulgrid.llm import html_text
from haulgrid.llm.html_text import extract_pages, main_text
from haulgrid.llm.queries import QUERIES

WORDS = "the quick brown fox jumps over the lazy dog and then sleeps in the warm sun until noon "


def page(core, extra=""):
    return (
        '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body>'
        '<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/x">X</a></ul></nav>'
        '<div class="cookie-notice">We use cookies ' + WORDS * 3 + "</div>"
        + core + extra +
        '<div id="sidebar"><p>' + WORDS * 2 + '</p></div><div class="ad">Buy</div>'
        '<form><label>Name</label></form><section class="comments"><p>' + WORDS * 4 + "</p></section>"
        "<footer>&copy; 2024</footer></body></html>"
    )


PARTS = [WORDS.strip() * 1 + f" {i} &amp; caf&eacute; &#x1F642;" for i in range(5)]
WANT = "\n\n".join(["Head line", *(unescape(p) for p in PARTS)])


@pytest.mark.parametrize("core", [
    "<article><h1>Head\n  line</h1>" + "".join(f"<p>{p}" for p in PARTS) + "</article>",
    "<article><header><h1>Head line</h1></header><div class='text'>" + "".join(f"<p>{p}</p>" for p in PARTS) + "</div></article>",
    "<main><h1>Head <b>line</b></h1><div><div>" + "".join(f"<p><i>{p}<br></p>" for p in PARTS) + "</div></div></main>",
    "<div class='post'><h1>Head line</h1>" + "".join(f"<p>{p}</p>" for p in PARTS) + "</div>",
    "<article class=x><!-- c --><h1>Head&nbsp;line</h1><p>" + "<p>".join(PARTS) + "<aside>" + WORDS + "</aside><nav>n</nav></article>",
])
def test_article_without_its_surroundings(core):
    assert main_text(page(core)) == WANT


def test_article_without_article_element_keeps_its_heading():
    core = "<h1>Head line which is long enough to be dense</h1><div>" + "".join(f"<p>{p}</p>" for p in PARTS) + "</div>"
    got = main_text(page(core))
    assert got.endswith("\n\n".join(unescape(p) for p in PARTS)) and "cookies" not in got and "2024" not in got


def test_broken_and_odd_pages():
    assert main_text("") == "" and main_text("   ") == ""
    assert main_text("just text & more") == "just text & more"
    assert main_text("<p>a < b and c > d</p>") == "a < b and c > d"
    assert main_text("<p>open <b>bold <p>next</b> end <a href='x") == "open bold\n\nnext end"
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("<p title='a>b'>x</p><!-- <p>no</p> --><p>y") == "x\n\ny"
    assert main_text("<ul><li>one<li>two</ul><table><tr><td>c<td>d</table>") == "one\n\ntwo\n\nc\n\nd"
    assert main_text("<script>if (a</b/.test(x)) {}</script>z") == "z"
    assert main_text("<article><p>" + "x" * 200_000 + "</article>") == "x" * 200_000
    assert main_text("<a " + 'b="' * 3000) == ""


def test_operator_edges(spark):
    rows = [(1, "u", "<p>a</p>", 1, "t"), (1, "u", "<p>a</p>", 1, "t"), (2, None, None, None, None), (None, "v", "", 2, "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int, text string")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract_pages(df).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (0, "v", "", 0)], key=str)
    assert extract_pages(df.limit(0)).count() == 0


def template_text(html):
    core = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", core)
    want = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n\n".join(w for w in want if w)


def test_small_table_against_its_template(spark):
    got = {r.page_id: r.text for r in QUERIES["op10_html_text"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert got[r.page_id] == template_text(r.html)


@pytest.mark.parametrize("start, end", [
    ("<div>", "</div>"), ("<section class='x'>", "</section>"), ("", ""), ("<div class=a><div class=b>", "</div></div>"),
    ("<div class='page has-sidebar'><article class='post comments-open'>", "</article></div>"),
    ("<form id='aspnetForm'><div>", "</div></form>"), ("<div class=widget><main>", "</main></div>"),
])
def test_pages_without_the_article_element(spark, start, end):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        html = r.html.replace("<article>", start).replace("</article>", end)
        assert main_text(html) == template_text(r.html), html


def test_names_that_only_look_like_boilerplate():
    p = "".join(f"<p>{x}</p>" for x in PARTS)
    want = "\n\n".join(unescape(x) for x in PARTS)
    for core in (
        f"<div class='page has-sidebar'><article>{p}</article></div>",
        f"<form id='aspnetForm'><article>{p}</article><label>Search</label><input></form>",
        f"<article class='post comments-open'>{p}</article>",
        f"<article>{p.replace('<p>', '<div class=share-price>').replace('</p>', '</div>')}</article>",
    ):
        assert main_text(page(core)) == want
        assert main_text(f"<html><body>{core}</body></html>") == want
    assert main_text(f"<article>{p}<p><math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>") == want + "\n\nx=1"
    for name in ("cookie-notice", "siteFooter", "main-nav", "ad-slot", "post-comments", "related-posts", "sidebar-left", "ad_300x250", "social-links"):
        assert main_text(page(f"<article>{p}<div class='{name}'><p>{WORDS}</p></div></article>")) == want, name


def test_link_lists_without_a_name_are_no_main_text():
    links = "<ul>" + "".join(f"<li><a href=/{k}>more about {k}</a></li>" for k in range(9)) + "</ul>"
    p = "".join(f"<p>{x}</p>" for x in PARTS)
    want = "\n\n".join(unescape(x) for x in PARTS)
    assert main_text(page(f"<article>{p}{links}</article>")) == want
    assert main_text(page(f"<div>{links}</div><div>{p}</div>")) == want
    few = "<ul><li>one</li><li>two <a href=/>link</a></li></ul>"
    assert main_text(page(f"<article>{p}{few}</article>")) == want + "\n\none\n\ntwo link"


def test_densities_against_the_formula():
    """Densities by recursion, straight from the paper, over pages of every shape above."""
    from math import e, log

    def count(n):
        own = [k for k in n.kids if type(k) is html_text.Node and not k.gone]
        c = sum(len(re.sub(r"\s", "", k)) for k in n.kids if type(k) is str)
        t = lc = lt = 0
        for k in own:
            kc, kt, klc, klt = count(k)
            c, t, lc, lt = c + kc, t + kt + 1, lc + klc, lt + klt + (k.tag == "a")
        return c, t, c if n.tag == "a" else lc, lt

    html = page("<article><h1>Head</h1>" + "".join(f"<p>{x} <a href=/>a link</a></p>" for x in PARTS) + "<div>loose <b>text</b><p>x</p></div></article>")
    root = html_text.parse(html)
    body = next(n for n in html_text._ordered(root) if n.tag == "body")
    nodes = html_text._ordered(body)
    html_text._densities(nodes, body)
    c, _, lc, _ = count(body)
    share = lc / c
    for n in nodes:
        c, t, lc, lt = count(n)
        if not c:
            assert n.density == 0
            continue
        nlc = (c - lc) or 1
        want = c / (t or 1) * log(c / (lc or 1) * (t or 1) / (lt or 1)) / log(log(c / nlc * lc + share * c + e))
        assert abs(n.density - want) < 1e-9 * abs(want) + 1e-9, n.tag
        blocks = [k.density for k in n.kids if type(k) is html_text.Node and not k.gone and k.tag in html_text.BLOCK]
        assert n.total >= sum(blocks) - 1e-9 and (n.total == 0 or blocks)
