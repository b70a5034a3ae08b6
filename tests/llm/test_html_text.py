import html
import os
import re
import time

import pytest

from veritide.llm.html_text import content_paths, extract, main_text, parse

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header>Site header</header><nav><ul><li><a href="/a">menu a</a><li><a href="/b">menu b</a></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy this now, it is cheap. Really, it is.</div>
<article><h1>Title &amp; more</h1><p><b>First  paragraph,
 with   words.<br><p>Second &eacute; paragraph; it is longer, and has marks. Yes.</p><p>Tiny.</p><aside>aside text</aside><form>form <input value="q"></form><ul><li>one<li>two</ul></article>
<div class="sidebar">side, side. side!</div><section id="comments"><p>A comment, quite long, with words. And more.</p></section><div class="cookie-notice">We use cookies.</div><footer>&copy; me</footer></body></html>"""


def test_article_without_furniture():
    assert main_text(PAGE) == "Title & more\nFirst paragraph, with words.\nSecond é paragraph; it is longer, and has marks. Yes.\nTiny.\none\ntwo"


def test_pages_without_an_article_element():
    body = "".join(f"<p>Sentence number {i}, with several words. And another one.</p>" for i in range(6))
    page = f"<body><div id=top><a href=x>home</a> <a href=y>about</a></div><div class=content><h2>Head</h2>{body}</div><div class='footer'>foot</div></body>"
    assert main_text(page).split("\n")[0] == "Head" and main_text(page).count("\n") == 6 and "home" not in main_text(page)


def test_odd_pages(spark):
    pages = [None, "", "   ", "plain text only", "<p>unclosed", "<script>alert(1)", "<", "<<<>>>", "<div " + "x" * 1000, "a &lt;b&gt; &#233;", "<article></article>", '<p title="a>b">in</p>', "<p>" * 3000 + "deep"]
    want = ["", "", "", "plain text only", "unclosed", "", "<", "<<<>>>", None, "a <b> é", "", "in", "deep"]
    df = spark.createDataFrame([(i, "u", p, "c") for i, p in enumerate(pages)] + [(None, None, PAGE, "c"), (3, "u", pages[3], "c")], "page_id long, url string, html string, text string")
    rows = extract(df).collect()
    assert len(rows) == len(pages) + 2
    for r in rows:
        assert r.n_chars == len(r.text)
        if r.page_id is not None and want[r.page_id] is not None:
            assert r.text == want[r.page_id], pages[r.page_id][:20]
    assert extract(df.limit(0)).count() == 0


def test_paths_decide():
    """All text of a path goes or stays together, and content paths hold the long marked text."""
    runs, paths = parse(PAGE)
    said = [x for x in runs if x.text.strip()]
    chosen = content_paths(said, paths)
    assert {x.path for x in said if "paragraph" in x.text} <= chosen
    assert "\n".join(" ".join(x.text.split()) for x in said if x.path in chosen).count("words") == 1


def test_names_do_not_empty_a_page():
    body = "<h1>Head</h1>" + "".join(f"<p>Sentence {i} of the story, with some more words in it. And one.</p>" for i in range(5))
    for wrapper in ('<div class="content ad-free">', '<div id="main" class="col has-nav">', '<section class="article search-result">', '<div class="widget">'):
        assert main_text(f"<body><ul><li><a href=x>home</a><li><a href=y>more</a></ul>{wrapper}{body}") == main_text(f"<article>{body}</article>"), wrapper
    assert "Prices fell" in main_text(f'<article>{body}<p class="share price">Prices fell.</p></article>')
    assert "Tweet" not in main_text(f'<article>{body}<div class="share">Tweet this</div><section class="comments"><p>I say so, too.</p></section></article>')


def test_all_articles_of_a_page_stay():
    first, second = "<p>First story, which is long enough. It ends.</p>", "<p>Second one, also of some length. It ends too.</p>"
    assert main_text(f"<nav>menu</nav><article>{first}</article><article>{second}</article>") == "First story, which is long enough. It ends.\nSecond one, also of some length. It ends too."


def test_deep_nesting_and_long_pages():
    for page in ("<div>x" * 100_000, "<b>x" * 100_000, "<ul><li>x" * 50_000, "<p>x</b>" * 100_000, "<a " * 50_000, "<div>" * 50_000 + "</span>" * 50_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 4


def test_text_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", "u", PAGE, 1, "t")], "page_id string, url string, html string, n_chars int, text string")
    assert [(r.page_id, r.n_chars == len(r.text) > 0) for r in extract(df).collect()] == [("a", True)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pages_give_their_article(spark):
    """On the driver's pages, whose article is known to stand in one element, the text is that element's blocks, by a plain cut."""
    got = {r.page_id: r.text for r in extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside).replace("<br>", " "))
        assert got[r.page_id] == "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)
