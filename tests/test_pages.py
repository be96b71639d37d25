"""Facts about single pages: tree, selectors, regions, metadata, Markdown, links."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import pages as P
from pagemill.functions.dom import SelectorError, parse, select
from pagemill.functions.mdscan import extract_urls, scan_links, splice
from pagemill.functions.regions import RegionError, content_region
from pagemill.functions.render import TabMarkdown, escape_tab, html_to_markdown, tab_to_markdown


def md(html):
    return html_to_markdown(html)


def test_tree_keeps_unclosed_elements_and_scripts():
    root = parse('<p><b>x<br><p>y</b><script>var a="</p>";</script>z')
    assert root.first("br").children == []
    assert root.text_content() == "xyz"
    assert parse("<p>a</i></p>").html() == "<p>a</p>"


def test_serialization():
    assert parse('<img alt="a&b" src=x><!-- c -->&lt;').html() == '<img alt="a&amp;b" src="x"/><!-- c -->&lt;'


@pytest.mark.parametrize(
    ("selector", "n"),
    [("p", 3), ("div > p", 2), (".a.b", 1), ("#i", 1), ("p:not(.a)", 2), ("p:nth-child(2n+1)", 2), ("[href^='/x']", 1), ("p + p", 1), ("p ~ span", 1), ("a, span", 2), ("div p", 3)],
)
def test_selectors(selector, n):
    root = parse("<div><p class='a b'>1</p><p id=i>2</p><span>s</span><section><p><a href='/x1'>l</a></p></section></div>")
    assert len(select(root, selector)) == n


@pytest.mark.parametrize("selector", ["", "p[", "p >", ":nope", "p:nth-child(x)"])
def test_bad_selectors(selector):
    with pytest.raises(SelectorError):
        select(parse("<p>"), selector)


def test_regions():
    long = "<article>" + "word " * 60 + "</article>"
    assert content_region(f"<nav>n</nav>{long}", "main").startswith("<article>")
    assert content_region("<nav>n</nav><main>short</main>", "main") == "<main>short</main>"
    assert content_region("<p>x</p>") == "<p>x</p>"
    assert content_region("<b>1</b><i>2</i><b>3</b>", "selector", "b") == "<main><b>1</b><b>3</b></main>"
    for mode, selector in (("main", None), ("selector", "u"), ("selector", None), ("full", "p"), ("other", None)):
        with pytest.raises(RegionError):
            content_region("<p>x</p>", mode, selector)


def test_metadata_and_base():
    html = """<html lang=" en "><head><base href="/docs/"><meta name="twitter:title" content="First"><meta property="og:title" content="Second">
    <meta name="author" content=" A  B "><link rel="alternate canonical" href="c"></head><body><a href="x">l</a><a href="#f">f</a><img srcset="a 1x, b 2x"></body></html>"""
    page = P.convert(html, "https://e.org/a/b")
    assert (page["title"], page["author"], page["language"], page["canonical_url"]) == ("First", "A B", "en", "https://e.org/docs/c")
    assert page["links"] == ["https://e.org/docs/x"]
    assert "https://e.org/docs/a 1x, https://e.org/docs/b 2x" in page["selected_html"]
    assert page["markdown"].startswith('---\ntitle: "First"\nauthor: "A B"\ncanonical_url: "https://e.org/docs/c"\nlanguage: "en"\n---\n\n')


def test_local_pages_stay_as_they_are():
    page = P.convert('<link rel=canonical href="c"><a href="x">l</a>', "file:///tmp/a.html")
    assert page["canonical_url"] == "c" and 'href="x"' in page["selected_html"] and page["links"] == []


def test_empty_pages_are_errors():
    assert P.convert(None, "u")["error"] and P.convert(" ", "u")["error"]
    assert P.convert("<script>x</script>", "https://e.org/")["error"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h2>A <b>b</b></h2><p>c</p>", "## A **b**\n\nc"), ("<p>a<br>b</p>", "a  \nb"), ("<p>a_b *c*</p>", r"a\_b \*c\*"), ("<p><code>a`b</code></p>", "`` a`b ``"),
        ("<pre>x\n  y</pre>", "```\nx\n  y\n```"), ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"), ("<ul><li>a<ul><li>b</li></ul></li></ul>", "* a\n  + b"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"), ('<a href="u" title="t">x</a>', '[x](u "t")'), ('<img src="s" alt="a">', "![a](s)"), ("<p>a</p><hr><p>b</p>", "a\n\n---\n\nb"),
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("<p>a <del>b</del></p>", "a ~~b~~"), ("<script>x</script><p>y</p>", "y"),
    ],
)
def test_markdown(html, want):
    assert md(html) == want


def test_tab_dialect():
    assert tab_to_markdown("<p><em>a</em> <strong>b</strong></p>") == "_a_ **b**"
    assert tab_to_markdown("<h1>T</h1>", heading_style="setext") == "T\n="
    assert tab_to_markdown('<a href="#x">a</a>') == "a"
    assert tab_to_markdown('<img src="i.png" width=5><img src="j.png">') == "![](j.png)"
    assert tab_to_markdown("<p>1. a</p>") == r"1\. a"
    assert tab_to_markdown("<nav>n</nav><p>x</p>", remove=("nav",)) == "x"
    t = TabMarkdown()
    t.add_rule("mark", ("mark",), lambda node, content: f"=={content}==")
    assert t.render(parse("<p><mark>a</mark></p>")) == "==a=="
    assert tab_to_markdown("<table><tr><td>a|b</td></tr><tr><td>c</td><td>d</td></tr></table>") == "| a\\|b |  |\n| --- | --- |\n| c | d |"


def test_link_scanner():
    text = "[a](https://e.org/x_(y)) ![i](j) \\[n](m) [b] (<https://e.org/a b>)\n```\n[c](d)\n```\n[e](f \"t\")"
    assert [d for d, _, _ in scan_links(text)] == ["https://e.org/x_(y)", "https://e.org/a b", "f"]
    for d, s, e in scan_links(text):
        assert text[s:e] == d
    assert splice("abc", [(1, 2, "X"), (0, 1, "")]) == "Xc"


def test_urls_in_text():
    text = "[a](https://e.org/1) https://e.org/2, <a href='https://e.org/3'>x</a>\nhttps://e.org/4\nHTTPS://e.org/5"
    assert extract_urls(text) == ["https://e.org/1", "https://e.org/2,", "https://e.org/3", "https://e.org/4"]


def test_assets():
    root = parse('<img src=" a.png " srcset="b 1x, data:x"><p style="background-image: url(\'c.jpg\')">')
    assert P.asset_urls(root, "https://e.org/d/") == ["https://e.org/d/a.png", "https://e.org/d/b", "https://e.org/d/c.jpg"]
    P.rewrite_assets(root, "https://e.org/d/", {"https://e.org/d/a.png": "l/a.png", "https://e.org/d/c.jpg": "l/c.jpg"})
    assert 'src="l/a.png"' in root.html() and "url('l/c.jpg')" in root.html()


def test_quality_corpus(spark):
    from pagemill.operators import evaluate

    for r in evaluate.scores(evaluate.CORPUS.df(spark), ("main",)).collect():
        assert r["honest"] and r["recall"] in (None, 1.0) and r["rejection"] in (None, 1.0), r


def test_sql_names(spark):
    P.register(spark)
    page = "<html><head><title>T</title></head><body><h2>A</h2><p><a href=\"/b\">c</a></p></body></html>"
    spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string").createOrReplaceTempView("_pagemill_sql_names")
    found = dict(spark.sql("SELECT id, html_to_markdown(html) FROM _pagemill_sql_names").collect())
    assert "## A" in found[1] and "[c](/b)" in found[1] and found[2] is None and found[3].strip() == ""
    got = spark.sql("SELECT html_links(html, 'https://e.org/x').links l, url_join('https://e.org/x', '/b') u, md_urls('see https://e.org/q') m FROM _pagemill_sql_names WHERE id = 1").first()
    assert got.u == "https://e.org/b" and got.m == ["https://e.org/q"] and len(got.l) == 1


@pytest.mark.parametrize(
    ("plain", "escaped"),
    [
        ("-5 degrees", "-5 degrees"), ("== x", "== x"), ("~~~ x", "~~~ x"), ("- x", "\\- x"), ("  + x", "  \\+ x"), ("a - b", "a - b"), ("# x", "\\# x"), ("#x", "#x"), ("####### x", "####### x"), ("> x", "\\> x"), (">x", ">x"),
        ("12. x", "12\\. x"), ("1.5", "1.5"), ("a_b*c`d[e]", "a\\_b\\*c\\`d\\[e\\]"), ("a\\b", "a\\\\b"), ("x\n- y\n 3. z", "x\n\\- y\n 3\\. z"),
    ],
)
def test_tab_escapes(plain, escaped):
    assert escape_tab(plain) == escaped


def test_a_deep_page_is_an_error_row(spark):
    from pagemill.functions import pages

    rows = spark.createDataFrame([(1, "<div>" * 70_000 + "x"), (2, "<p>x")], "page_id int, html string")
    page = pages.page_udf(want=("markdown",))
    got = {r["page_id"]: (r["p"]["markdown"], r["p"]["error"]) for r in rows.select("page_id", page("html", F.lit("https://e.org/")).alias("p")).collect()}
    assert got[1][0] is not None or got[1][1] == "the page is nested too deeply"
    assert "x" in got[2][0] and got[2][1] is None
