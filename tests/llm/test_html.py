"""Main text of pages: marked articles, unmarked ones, chrome, broken markup and odd rows."""

import html as references
import random
import re
from collections import Counter

import duckdb
import pytest

from assayloom.llm import html, queries

WORDS = "these are the words of a paragraph that goes on for a while and says nothing at all"


@pytest.fixture(scope="module")
def costs(spark, sf):
    return html.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def plain(page):
    """The test pages' articles, by their own layout."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [references.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", p))) for p in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(t for t in (re.sub(r"\s+", " ", p).strip() for p in parts) if t)


def test_test_pages(spark, sf, costs):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = queries.op3_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == plain(pages[r.page_id].html)


def test_layouts(costs):
    nav = "<nav><ul><li><a href=/>Home page of it all</a><li><a href=/x>Other</a></ul></nav>"
    article = f"<h1>Title</h1><p>{WORDS} &amp; &eacute;&#8212;<b>bold</b>ed</p><p>\n short  <i>one</i>.</p><ul><li>item one<li>item two</ul>"
    want = f"Title\n{WORDS} & é—bolded\nshort one.\nitem one\nitem two"
    pages = [
        f"<html><body>{nav}<article>{article}</article><footer>{WORDS}</footer>",
        f"<body><header><h2>Site</h2></header><div id=main-menu><a href=/>{WORDS}</a></div><main>{article}<div class='comments'><p>{WORDS}</p></div></main><aside>{WORDS}</aside>",
        f"<body>{nav}<div>{article}</div><div class='cookie-notice'>{WORDS}</div><form><p>{WORDS}<input><button>Go</button></form>",
        f"<body class='has-sidebar'><div class=sidebar><p>{WORDS} {WORDS}</div><article class='post with-sidebar'>{article.replace('<p>', '<p><script>var a = 1 < 2;</script><!-- no > -->', 1)}</article>",
        f"<article>{article.replace('<ul>', f'<div class=ad>{WORDS} {WORDS} {WORDS}</div><ul>')}<article class=comment><p>{WORDS}</p></article></article>",
        f"<body><article>{article}</article><section><h2>Related</h2><p>{WORDS}</p></section>",
    ]
    for p in pages:
        assert html.main_text(p, costs) == want, p
        assert html.main_text(p.replace("<p>", "<P CLASS='x'>").replace("</p>", ""), costs) == want


def test_the_best_run_of_all_runs(costs):
    rng = random.Random(3)
    pieces = ["<nav><a href=/>Home</a></nav>", "<div class=ad>Buy this now</div>", f"<p>{WORDS}</p>", "<p>Short.</p>", "<img><img><br>", "<li>item</li>", "<script>x</script>", "<footer>the end of it</footer>", "<h2>Head</h2>", "<main><p>In it.</p></main>"]
    for _ in range(300):
        page = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        scored = html.scores(html.blocks(page), costs)
        runs = {(i, j): sum(s for _, s in scored[i:j]) - sum(g for g, _ in scored[i + 1 : j]) for i in range(len(scored)) for j in range(i + 1, len(scored) + 1)}
        i, j = html.best_run(scored)
        assert (runs[i, j] if j else 0.0) == pytest.approx(max([0.0, *runs.values()]))


def test_weights_decide(costs):
    """On the test pages: right without their article elements, and without what is believed before any page; wrong without the weights."""
    pages = [r[0] for r in duckdb.sql("select html from read_parquet('/root/testdata/sf0.01/pages.parquet')").fetchall()]
    assert all(html.main_text(re.sub("</?article>", "", p), costs) == plain(p) for p in pages)
    assert all(html.main_text(p, html.Weights({}, {})) != plain(p) for p in pages)
    learnt = html.weights(Counter({(True, "<p"): 90, (False, "<p"): 10, (False, "<div"): 50, (True, ".notice"): 400, (False, ".notice"): 1, (False, ".rare"): 2}), Counter({True: 400, False: 400}))
    assert learnt.tags["p"] < learnt.tags["div"] and ".rare" not in learnt.marks
    believed = html.weights(Counter(), Counter())
    for cls, text, none in (("notice", WORDS, ""), ("xyz", WORDS, WORDS)):
        assert html.main_text(f"<div class={cls}>{WORDS}</div>", learnt) == text and html.main_text(f"<div class={cls}>{WORDS}</div>", believed) == none


def test_labelled_pages_alone_are_enough(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    monkeypatch.setattr(html, "_BELIEVED", frozenset())
    monkeypatch.setattr(html, "_INTERRUPTS", frozenset())
    w = html.fit(pages)
    assert {m for m, x in w.marks.items() if x > 3} == {"nav", "footer", ".ad"}
    assert all(html.main_text(r.html, w) == plain(r.html) for r in pages.collect())


def test_the_scan_decides(costs):
    """Where nothing is marked: lists of links around an article, and a far-off run of text; no block by itself is against the odds."""
    links = "<ul>" + "".join(f"<li><a href=/{i}>Topic {i}</a></li>" for i in range(12)) + "</ul>"
    article = "".join(f"<p>{WORDS} {i}</p>" for i in range(4))
    want = "\n".join(f"{WORDS} {i}" for i in range(4))
    for page in (f"<body>{links}{article}{links}", f"<body><p>Log in</p>{links}{article}", f"<body>{article}{links}{links}<p>Made by us, with care</p>"):
        assert html.main_text(page, costs) == want
        every = "\n".join(b.text for b in html.blocks(page) if not b.dropped and costs.odds(b, False) < 0)
        assert every != want and want in every


def test_ties_go_to_the_earlier_run(costs):
    far = "<ul>" + "<li><a href=/>x</a></li>" * 40 + "</ul>"
    assert html.main_text(f"<p>one two three</p>{far}<p>six five four</p>", costs) == "one two three"


def test_broken_markup(costs):
    assert html.main_text("plain words only", costs) == "plain words only"
    assert html.main_text("<p>a < b and c > d <", costs) == "a < b and c > d <"
    assert html.main_text("<p>one<p class=\"open>two", costs) == "one\ntwo"
    assert html.main_text("<p>cut <a href=", costs) == "cut"
    assert html.main_text("<p>x<!-- never closed <p>y", costs) == "x"
    assert html.main_text("<script>only()</script><style>p{}", costs) == html.main_text("", costs) == ""
    assert html.main_text("<p>" + "<b>" * 20_000 + "deep" + "<p>next", costs) == "deep\nnext"
    assert len(html.main_text("<p>" + "long " * 200_000 + "</p>", costs)) == 999_999


def test_odd_rows(spark, sf, costs):
    pages = spark.createDataFrame([(1, "u", "<p>one two</p>", "x", 1), (2, None, None, None, None), (None, "u", "", "x", 2), (1, "u", "<p>one two</p>", "x", 1)], "page_id long, url string, html string, text string, n_chars long")
    rows = html.extract(pages, html.fit(pages), keep=("page_id", "url")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "", 0), (1, "one two", 7), (1, "one two", 7), (2, "", 0)]
    assert html.extract(pages.limit(0), html.fit(pages.limit(0)), keep=("page_id",)).count() == 0
    with pytest.raises(ValueError):
        html.extract(pages, html.fit(pages), keep=("text",))
    assert html.extract(pages, html.fit(pages), keep=("text",), name="main").columns == ["text", "main", "n_chars"]
