"""Site template removal: blocks on few of many pages, copies of one page, both ways of the join."""

import functools
import re

import pytest
from pyspark.sql import functions as F

from foliospark.llm import common, html


@pytest.mark.parametrize("broadcast_rows", [common.BROADCAST_ROWS, 0])
def test_template_on_a_small_share_of_a_large_host(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    box, rare = "<div>follow <span>us</span> now</div>", "<div>on three pages only</div>"
    own = lambda i: f"<p>own {i}</p>" + (box if i % 8 == 0 else "") + (rare if i < 3 else "")
    rows = [(i, f"http://a.example/{i}", own(i)) for i in range(40)]
    rows += [(100 + i, f"http://b.example/{i}", own(i)) for i in range(0, 24, 8)]  # three pages of another host
    rows += [(200 + i, f"http://c.example/{i}", f"<nav>{i}</nav><div>one page at six addresses</div>") for i in range(6)]
    rows += [(300, "http://a.example/0", own(0)), (301, "http://a.example/0", None)]
    got = {r.page_id: r.text for r in html.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"own {i}" + (" on three pages only" if i < 3 else "") for i in range(40))
    assert "follow us now" in got[100] and got[203] == "one page at six addresses" and got[300] == got[0] and got[301] == ""


@pytest.mark.parametrize("depth", [500, 20_000])
def test_elements_below_many_open_ones(depth):
    deep = "<font>" * depth
    page = f"<body>{deep}<nav>menu</nav><div class=ad>buy</div><article><p>one</p><footer>foot</footer></article><p>rest</body>"
    assert html.text_of(html.parse(page)) == "one"
    assert html.text_of(html.parse(f"<div>{deep}<nav><div>a</div>b</nav>c</div>d")) == "c d"
    assert html.text_of(html.parse(deep + "x" + "</i></b>" * depth + "</font>" * depth + "<p>y")) == "x y"


def test_counts_decide_what_recurs_on_sf01(spark):
    """Without names and marks: exactly the menus, adverts and footers on four pages of their host go."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = {(r.host, r.source): set(r.template) for r in html.templates(spark, pages).collect()}
    rows = pages.select("page_id", "html", html.host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("source")).collect()
    block = re.compile(r'<nav>.*?</nav>|<footer>.*?</footer>|<div class="ad">.*?</div>', re.S)
    on: dict = {}
    for r in rows:
        trunk = re.sub(r"<(script|style|title)>.*?</\1>", "", block.sub("", r.html), flags=re.S)
        for b in block.findall(r.html):
            on.setdefault((r.host, b), set()).add(trunk[trunk.index("<body") :])
    gone = changed = 0
    for r in rows:
        tree = html.parse(r.html)
        own = found.get((r.host, r.source), set())
        recur = [b for b in block.findall(r.html) if len(on[r.host, b]) >= html.LEAST_PAGES]
        want = html.text_of(html.parse(functools.reduce(lambda h, b: h.replace(b, " "), recur, r.html)), marks=False)
        got = html.text_of(tree, own, marks=False)
        assert got == want, r.page_id
        gone += len(recur)
        changed += got != html.text_of(tree, marks=False)
    assert gone > 900 and changed > 300


def test_words_of_classes_in_articles_and_split_references():
    page = "<article><p class='promotion-history'>kept</p><p class='ad'>buy</p><div class='promotion-box'>deal</div><p>&am<b>p;</b> &amp;amp; x&nbsp;y</article>"
    assert html.text_of(html.parse(page)) == "kept &amp; &amp; x y"


def test_an_article_under_other_menus_is_no_template(spark):
    rows = [(i, f"http://a.example/{i}", f"<nav>{i}</nav><div><article><p>the same article</p></article></div><div>other {i}</div>") for i in range(6)]
    got = html.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"the same article"}
