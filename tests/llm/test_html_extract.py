import random
import re
import time

import pytest

from lattica.llm.html_extract import FALLBACK, best_stretch, extract_main_text, learn_scores, main_text
from lattica.llm.queries import op3_html_extraction


def test_query_takes_the_articles(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = op3_html_extraction(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.n_chars == len(r.text)
        article = re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1])
        clean = lambda s: __import__("html").unescape(s).split()
        assert r.text.split() == clean(article)


PAGE = """<!DOCTYPE html><html><head><title>A title here</title><style>p > b {{}}</style><script>var x = "<p>not text</p>";</script></head>
<body><header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News page</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to serve you.</p><button>Accept all</button></div>
<{tag}><h1>The &amp; headline</h1><p>First   paragraph has several
words&nbsp;in <b>bold</b>face &lt;and&gt; more.<p>Second<br>paragraph goes on with words that tell a story.
<div class="ad">Buy this product now for less money</div><!-- a comment with words --><p>Third paragraph ends the story with a number of words.</p></{tag}>
<aside><p>Related: other stories of note</p></aside><form><input><label>Your name</label></form>
<section id="comments"><p>Reader says first comment text is here.</p></section><footer>&copy; 2020 Someone. All rights.</footer></body></html>"""
WANT = "The & headline\n\nFirst paragraph has several words in boldface <and> more.\n\nSecond paragraph goes on with words that tell a story.\n\nThird paragraph ends the story with a number of words."


@pytest.mark.parametrize("tag", ["article", "div", "main"])
def test_main_text_of_a_full_page(spark, tag):
    page = PAGE.format(tag=tag)
    learned = learn_scores(spark.createDataFrame([(PAGE.format(tag="article"),)] * 3, "html string"))
    for scores in (learned, FALLBACK):
        assert main_text(page, scores | {k: -0.1 for k in ("p", "/p", "h1", "/h1", "br", "b", "/b", "/div", "div")} if scores is FALLBACK else scores) == WANT


def test_best_stretch_equals_brute_force():
    rng = random.Random(2)
    for _ in range(500):
        values = [rng.randrange(-5, 6) for _ in range(rng.randrange(12))]
        low, high = best_stretch(values)
        sums = [sum(values[i:j]) for i in range(len(values)) for j in range(i, len(values) + 1)]
        assert sum(values[low:high]) == max([0, *sums])


def test_broken_markup_and_odd_rows(spark):
    rows = ["", None, "plain words only", "<p>a < b and c > d", "<div class='x", "<!-- never closed", "<script>var a", "</p></div>text", "<p>" * 3000 + "deep words", "x" * 200_000, "<a href=\"x>y\">link</a>", "&#x41;&bogus; &amp", "<p>one</p><p>two</p>", "same", "same", "<nav>menu<article>story words here</article>"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert got[0] == got[1] == "" and got[2] == "plain words only" and got[3] == "a < b and c > d"
    assert got[4] == got[5] == got[6] == "" and got[7] == "text" and got[8] == "deep words" and got[9] == rows[9]
    assert got[11] == "A&bogus; &" and got[13] == got[14] == "same" and got[15] == "story words here"
    assert extract_main_text(pages.where("false")).count() == 0


def test_only_hidden_elements_are_left_out():
    words = "It rained all day, and the river rose over the old bridge before the evening came."
    page = "<html><body><article>" + "".join(f"<div {a}><p>{words} {k}</p></div>" for k, a in (("kept1", 'class="overflow-hidden"'), ("kept2", 'style="overflow:hidden"'), ("kept3", 'title="the hidden river"'), ("gone1", "hidden"), ("gone2", 'style="display: none"'), ("gone3", 'aria-hidden="true"'))) + "</article></body></html>"
    text = main_text(page, FALLBACK)
    assert [k for k in ("kept1", "kept2", "kept3", "gone1", "gone2", "gone3") if k in text] == ["kept1", "kept2", "kept3"]


WORDS = "It rained all day, and the river rose over the old bridge before the evening came."


@pytest.mark.parametrize(
    "start",
    ['<div style="overflow:hidden">', '<div class="overflow-hidden">', '<div title="hidden gems">', '<div class="search results">', '<div id="widget">', "<div don't>", "<div title=it's>", "<div data-x=a\"b>", '<div class="ad"><div class="comment-list">'],
)
def test_what_wraps_the_article_does_not_cost_it(start):
    page = f"<html><body><nav>Menu of pages</nav>{start}<h1>Rain</h1><p>{WORDS}</p><div class='ad'>Buy this</div><p>{WORDS}</p></div><footer>Some firm</footer></body></html>"
    assert main_text(page, FALLBACK | {k: -0.1 for k in ("p", "/p", "h1", "/h1", "div", "/div")}) == f"Rain\n\n{WORDS}\n\n{WORDS}"


def test_pages_without_the_tag_they_learn_from(spark, small):
    """The text is the same when the article is a plain div, on every page."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    scores = learn_scores(pages)
    for r in pages.collect():
        assert main_text(re.sub("<(/?)article>", r"<\1div>", r.html), scores) == main_text(r.html, scores)


def test_large_and_nested_pages_take_linear_time():
    deep = "".join(f"<div class=x{i % 9}><b>w</i></u>" for i in range(40_000))
    for page in (deep, "<p " + "a=" * 300_000, "<div class='ad'>" * 30_000 + "word", "<a b='" * 100_000, "<!-- " * 100_000, "</b>" * 200_000, "<nav><article>" * 30_000 + "x"):
        began = time.perf_counter()
        main_text(page, FALLBACK)
        assert time.perf_counter() - began < 2.5


def test_every_kind_of_tag_counts(spark):
    """Many made-up tags do not push standard ones out."""
    page = "<body><nav>a b</nav><article><p>one two three</p>" + "".join(f"<x-{i}>w</x-{i}>" for i in range(600)) + "<kbd>k</kbd></article></body>"
    scores = learn_scores(spark.createDataFrame([(page,)], "html string"))
    assert scores["kbd"] != -3.0 and "other" in scores and not any(k.startswith("x-") for k in scores)
