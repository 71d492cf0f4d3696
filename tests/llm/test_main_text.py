import html
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from spanlake.llm import main_text
from spanlake.llm.boosted import fit_trees
from spanlake.llm.dom import Forest, parse
from spanlake.llm.page_templates import MARK, pages as template_pages

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return main_text.fit_page_model()


def blocks(page):
    return [t for t in parse(page).text if t]


@pytest.mark.parametrize("page, expected", [
    (None, []), ("", []), ("no markup  at\nall", ["no markup at all"]),
    ("<p>one<p>two <b>bold</b>er<br>line", ["one", "two bolder line"]),
    ("<P CLASS=x>a &lt;b&gt; &amp;amp; &#x41;&nbsp;&copy;</P>tail", ["a <b> &amp; A ©", "tail"]),
    ("<head><title>no</title><style>p{}</style><script>var t='</p><p>no</p>';</script><body>yes", ["yes"]),
    ("<div>a<!-- no <p>no</p> --><!--> b<hr>c</div></span></div>d", ["a b", "c", "d"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>e", ["a", "b", "c", "e"]),
    ("<select><option>no<option>no</select><textarea><p>no</textarea><button>no</button>yes", ["yes"]),
    ("a <3 b < c", ["a <3 b < c"]), ("x<script>never closed <p>no</p>", ["x"]), ("x <a href='never closed>y</a>", ["x y"]),
    ("<p title='a > b' hidden>c</p>", ["c"]), ("\0a", ["a"]),
])
def test_blocks_of_pages(page, expected):
    assert blocks(page) == expected


def test_every_node_has_the_sums_of_its_subtree():
    for page in list(template_pages(30, 3)) + ["", "<div><div><p>x</p></div></div>"]:
        forest = Forest([parse("<p>before"), parse(page), parse("after")])
        for i in range(len(forest.parent)):
            below = [j for j in range(len(forest.parent)) if any(k == i for k in path(forest, j))]
            texts = [forest.text[j] for j in below if forest.text[j]]
            assert forest.sums[i, 0] == sum(map(len, texts)) and forest.sums[i, 6] == len(texts)
            assert forest.longest[i] == max(map(len, texts), default=0)


def path(forest, i):
    while i >= 0:
        yield i
        i = forest.parent[i]


def test_decoding_is_the_best_choice_without_contradictions():
    from itertools import product
    rng = np.random.default_rng(4)
    for _ in range(60):
        page = rng.choice(["<div><p>a</p><p>b<div>c</div></div>d", "<div><div>a</div></div><p>b</p>", "<ul><li>a<li><b>b</b><li>c</ul>", "<div><p>a</p></div><div><p>b</p>c</div>"])
        forest = Forest([parse(page)])
        n = len(forest.parent)
        odds = rng.normal(size=n)
        children = [[j for j in range(n) if forest.parent[j] == i] for i in range(n)]
        best = 0.0
        for keep in product((False, True), repeat=n):
            if any(keep[i] and i and not keep[forest.parent[i]] for i in range(n)) or any(keep[i] and children[i] and not any(keep[j] for j in children[i]) for i in range(n)):
                continue
            best = max(best, sum(odds[i] for i in range(1, n) if keep[i]))
        keep = forest.decode(odds)
        assert all(not keep[i] or keep[forest.parent[i]] for i in range(1, n))
        assert sum(odds[1:][keep[1:]]) == pytest.approx(best)


def test_trees_learn_and_repeat():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = fit_trees(x[:1500], y[:1500], np.ones(1500))
    assert (((trees.log_odds(x[1500:]) > 0) == y[1500:]).mean()) > 0.97
    assert (trees.log_odds(x) == fit_trees(x[:1500], y[:1500], np.ones(1500)).log_odds(x)).all()


def test_held_out_pages(model):
    """Other made-up pages: characters of main text found, and characters that belong elsewhere."""
    hit = extra = missed = 0
    known = list(template_pages(250, 99))
    for page, got in zip(known, main_text.main_texts([p.replace(MARK, "") for p in known], model)):
        want = Counter(" ".join(t.replace(MARK, "").split()) for t in parse(page).text if MARK in t)
        found = Counter(b for b in got.split("\n\n") if b)
        weigh = lambda c: sum(len(k) * n for k, n in c.items())
        hit, extra, missed = hit + weigh(want & found), extra + weigh(found - want), missed + weigh(want - found)
    assert hit / (hit + extra) > 0.97 and hit / (hit + missed) > 0.98


def test_hand_written_page(model):
    page = """<html><body class="home"><header id="masthead"><a href="/">Site name</a><ul class="menu"><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></header>
    <div class="cookie-notice"><p>We use cookies, and you can say no.</p><button>Fine</button></div>
    <div id="content"><h1>How rivers bend</h1><p>Water takes the way of least resistance, mostly.</p><p>Sand &amp; stones settle inside the bend.</p>
    <div class="ad-box">Buy one, get two.</div><blockquote>A river never looks back.</blockquote><ul><li>erosion</li><li>deposition</li></ul></div>
    <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">A first thing</a></li><li><a href="/2">A second thing</a></li></ul></aside>
    <section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I never knew that, thanks a lot for the explanation.</p></div></section>
    <form class="search"><label>Search <input name=q></label></form><footer>&copy; 2020 Site name. All rights reserved.</footer></body></html>"""
    assert main_text.main_texts([page], model)[0].split("\n\n") == [
        "How rivers bend", "Water takes the way of least resistance, mostly.", "Sand & stones settle inside the bend.", "A river never looks back.", "erosion", "deposition"]


def test_query_against_the_articles_of_the_table(spark):
    """The given pages hold one article element each; its blocks, read by a plain pattern, are the main text."""
    got = {r["page_id"]: r for r in entry.queries()["op11_main_text"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        article = re.search("<article>(.*)</article>", row["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        want = "\n\n".join(p for p in parts if p)
        r = got[row["page_id"]]
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), row["url"])


def test_hard_rows(spark, model):
    long = "<article>" + "<p>many words in a row, again and again.</p>" * 20000 + "</article>"
    kind = "page_id long, url string, html string, _html string, text string, n_chars long, parent int"
    data = [(1, "u", None), (2, None, ""), (3, "u", " \n "), (None, None, "<p>x"), (4, "u", "<article><p>Same page, twice.</p></article>"), (4, "u", "<article><p>Same page, twice.</p></article>"),
            (5, "u", long), (6, "u", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    rows = spark.createDataFrame([(*d, "h", "t", 9, 1) for d in data], kind)
    got = main_text.extract_main_text(rows, model).collect()
    assert sorted((r["page_id"] or 0) for r in got) == [0, 1, 2, 3, 4, 4, 5, 6]
    by_id = {r["page_id"]: r for r in got}
    assert [by_id[i]["text"] for i in (1, 2, 3)] == ["", "", ""] and by_id[1]["n_chars"] == 0
    assert by_id[4]["text"] == "Same page, twice." and by_id[5]["text"].count("again and again.") == 20000
    assert main_text.extract_main_text(rows.limit(0), model).count() == 0
