import itertools
import re
import time
from html import unescape

import numpy as np

from vantage.llm.htmltext import Forest, Page, extract_main_text, labelled_pages, train

ODD = {
    1: None,
    2: "",
    3: "plain words only",
    4: "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title &amp; more</h1><p>One <b>two</b>&nbsp;three.<p>Four<br>five &lt;six&gt;.</article><footer>&copy; us</footer>",
    5: "<div class='sidebar'>Side stuff here</div><div class='post-content'><p>The story of the day is long and full of words.</p><p>It goes on.</p></div><div id='comments'><p>Great post, thanks a lot for this.</p></div>",
    6: "<article><p>Text<script>var x = '<p>no</p>';</script> stays</p><!-- <p>gone</p> --><style>p{}</style></article>",
    7: "<" * 50 + "<p" + ">" * 20 + "</div></p><b><i></b>",
    8: "<article>" + "<div>" * 3000 + "deep words in here." + "</div>" * 3000 + "</article>",
    9: "<main><form><p>Sign up for our news</p><input></form><p>The main text, which has a point to make, ends here.</p></main><div class='cookie-notice'>We use cookies.</div>",
}


def rows(spark):
    return spark.createDataFrame([(k, f"u{k}", v, "x") for k, v in ODD.items()], "page_id long, url string, html string, text string")


def test_odd_pages(spark):
    got = {r.page_id: r for r in extract_main_text(rows(spark)).collect()}
    assert len(got) == len(ODD) and all(r.n_chars == len(r.text) for r in got.values())
    assert got[1].text == got[2].text == ""
    assert got[4].text == "Title & more One two three. Four five <six>."
    assert got[5].text == "The story of the day is long and full of words. It goes on."
    assert got[6].text == "Text stays"
    assert got[9].text == "The main text, which has a point to make, ends here."
    assert extract_main_text(rows(spark).limit(0)).collect() == []


def test_table_pages(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    for r in extract_main_text(df).collect():
        body = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        body = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", body))
        assert r.text == " ".join(unescape(body).split())


def test_marginals_are_those_of_enumeration():
    pages = [Page("<div><p>a b c</p><ul><li>d</li></ul></div>"), Page("x")]
    index = {}
    Forest(pages, index, grow=True)
    rng = np.random.default_rng(3)
    w, bias, pair = rng.normal(size=len(index)), 0.3, rng.normal(size=(2, 2, 2))
    forest = Forest(pages, index)
    p, _ = forest.marginals(w, bias, pair)
    score = np.array([bias + sum(w[index[f]] for f in feats) for page in pages for feats in page.feats])
    total, mass = np.zeros(forest.n), 0.0
    for y in itertools.product((0, 1), repeat=forest.n):
        y = np.array(y)
        x = np.exp((score * y).sum() + sum(pair[forest.kind[i], y[a], y[i]] for i, a in enumerate(forest.parent) if a >= 0))
        total += x * y
        mass += x
    assert np.allclose(p, total / mass)


def test_held_out_pages():
    index, w, bias, pair = train()
    pages = [Page(h, labelled=True) for h in labelled_pages(150, seed=123)]
    p, _ = Forest(pages, index).marginals(w, bias, pair)
    y = np.array([1 if v is None else v for x in pages for v in x.labels])
    assert ((p >= 0.5) == y).mean() > 0.98


def texts(spark, pages):
    found = extract_main_text(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' as url", "html"))
    return [r.text for r in sorted(found.collect(), key=lambda r: r.page_id)]


def test_labels_of_corpus_pages_are_not_read(spark):
    cell = lambda attribute: f"<article><h1>Prices of the year</h1><table><tr><td {attribute}>Ten euros a kilo.</td></tr></table><p>They rose a little, as they do each year.</p></article>"
    want = "Prices of the year Ten euros a kilo. They rose a little, as they do each year."
    assert texts(spark, [cell('data-label="Price"'), cell("data-label"), cell('data-label="0"'), cell("data-label=1")]) == [want] * 4


def test_broken_markup_takes_linear_time():
    long = 1 << 20
    pages = ["<a b='" + "<a c " * (long // 5), "<a c " * (long // 5), "<svg>" * (long // 5), "<b>" * (long // 3) + "</i>" * 1000]
    pages += ['<a ">" ' * (long // 7) + "'", "<div>" * (long // 10) + "</p>" * (long // 10), "<!--" + "<p " * (long // 3), "<b><td>" + "<i>" * 100_000 + "</b>" * 100_000, '<p class="' * (long // 10)]
    for html in pages:
        began = time.process_time()
        Page(html)
        assert time.process_time() - began < 2, html[:20]
    deep = Page("<div>" * 3000 + "in" + "</div>" * 3000 + "<p>out</p>")
    assert [t for _, t in deep.runs] == ["in", "out"] and deep.parent[deep.runs[1][0]] == 0


def test_pages_without_article(spark):
    pages = [
        "<div class='site-header'><a href='/'>Home</a> <a href='/b'>Blog</a></div><div id='content'><h2>A walk by the sea</h2><p>We left early in the morning and walked along the shore.</p><p>The wind was strong, and nobody else was out.</p></div><div class='footer'>Copyright the author.</div>",
        "<body><ul class=menu><li><a href=/>Start</a><li><a href=/c>Contact</a></ul><main><p>Bread needs flour, water, salt and time, and most of all it needs time.</main><aside><h3>More recipes</h3><p>Soup</p></aside></body>",
        "<table><tr><td><p>A first paragraph of plain text, laid out in a table cell.</p><p>And then a second one follows it here.</p></td></tr></table>",
        "<div class='cookie-banner'><p>We use cookies to make this site work.</p></div><section class='post'><p>The council met on Monday to decide on the new bridge.</p></section><form class='newsletter'><p>Subscribe to our letter.</p></form>",
    ]
    assert texts(spark, pages) == [
        "A walk by the sea We left early in the morning and walked along the shore. The wind was strong, and nobody else was out.",
        "Bread needs flour, water, salt and time, and most of all it needs time.",
        "A first paragraph of plain text, laid out in a table cell. And then a second one follows it here.",
        "The council met on Monday to decide on the new bridge.",
    ]
