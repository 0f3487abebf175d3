"""Question numbers and option labels on small papers of our own."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import anchors as an

LINE = "paper_id string, page int, n int, text string, x0 double, y0 double, x1 double, y1 double, first_text string, first_x0 double, first_y0 double, first_x1 double, first_y1 double, first_bold boolean"


def lines(spark, rows):
    full = [("p", p, n, t, x, y, x + 7.0 * len(t), y + 10, t.split(" ")[0], x, y, x + 7.0 * len(t.split(" ")[0]), y + 10, bold) for p, n, t, x, y, bold in rows]
    return spark.createDataFrame(full, LINE)


def pages(spark, n):
    return spark.createDataFrame([("p", i, 600.0, 800.0) for i in range(1, n + 1)], "paper_id string, page int, width double, height double")


def test_anchors(spark):
    rows = [(2, 1, "1 Find", 50.0, 100.0, True), (2, 2, "1", 100.0, 140.0, False), (2, 3, "2. Solve", 51.0, 300.0, True), (3, 1, "B 3", 40.0, 100.0, False), (3, 2, "Q3 Show", 50.0, 200.0, True), (5, 1, "5 skip", 50.0, 90.0, True), (5, 2, "4) Prove", 50.0, 120.0, True)]
    got = an.question_anchors(lines(spark, rows), pages(spark, 5))
    assert sorted((r.number, r.page, r.y0) for r in got.collect()) == [(1, 2, 100.0), (2, 2, 300.0), (3, 3, 200.0), (4, 5, 120.0)]


def test_page_numbers(spark):
    """Numbers at the foot, one a page, are no questions if the pages have others; alone they are."""
    foot = [(p, 9, str(p), 50.0, 780.0, False) for p in (1, 2, 3, 4)]
    asked = [(p, 1, f"{p} What", 50.0, 100.0, False) for p in (1, 2, 3, 4)]
    got = an.question_anchors(lines(spark, [*foot, *asked]), pages(spark, 4))
    assert sorted((r.number, r.y0) for r in got.collect()) == [(p, 100.0) for p in (1, 2, 3, 4)]
    assert an.question_anchors(lines(spark, foot), pages(spark, 4)).count() == 4
    assert an.question_anchors(lines(spark, [(1, 1, "words", 50.0, 10.0, False)]), pages(spark, 1)).count() == 0


GLYPH = "q int, line int, k int, ch string, x0 double, x1 double, math_font boolean, bold boolean, ocr boolean"


def glyphs(spark, texts, gap=6.0):
    """A space is a gap; glyphs are 5 wide."""
    rows = []
    for q, lines_ in texts.items():
        for i, t in enumerate(lines_):
            x, k = 50.0, 0
            for ch in t:
                if ch == " ":
                    x += gap
                else:
                    rows.append((q, i, k, ch, x, x + 5, False, False, False))
                    x, k = x + 5, k + 1
    return spark.createDataFrame(rows, GLYPH)


@pytest.mark.parametrize(
    "texts,want",
    [
        (["stem A", "A one", "B two"], {None: "stemA", "A": "one", "B": "two"}),
        (["stem", "(A) one (B) two", "(C) three"], {None: "stem", "A": "one", "B": "two", "C": "three"}),
        (["stem", "A. one", "B. two"], {None: "stem", "A": "one", "B": "two"}),
        (["stem", "A) one", "Btwo", "C three"], {None: "stem", "A": "one", "B": "two", "C": "three"}),
        (["no labels", "cAt B"], {None: "nolabelscAtB"}),
    ],
)
def test_options(spark, texts, want):
    got: dict = {}
    for r in an.split_options(glyphs(spark, {1: texts}), ["q"], F.lit(10.0)).orderBy("line", "k").collect():
        got[r.segment] = got.get(r.segment, "") + r.ch
    assert got == want


def test_chain_against_plain_search(spark):
    rng = random.Random(3)
    cases = {q: [(i, rng.choice("AABBCD"), rng.random() < 0.7) for i in range(rng.randrange(1, 9))] for q in range(60)}
    rows = [(q, i, 0, c, 0, s) for q, cs in cases.items() for i, c, s in cs]
    got: dict = {}
    for r in an.label_chain(spark.createDataFrame(rows, "q int, line int, k int, label string, last int, strong boolean"), ["q"]).collect():
        got.setdefault(r.q, []).append(r.line)
    for q, cs in cases.items():
        best: list = []
        for i, c, _ in cs:
            if c == "A":
                run: list = []
                for x in cs[i:]:
                    if x[1] == "ABCDEFGH"[len(run)]:
                        run.append(x)
                if len(run) < 3 and not all(x[2] for x in run):
                    run = [x for x in run[:1] if x[2]]
                if run and len(run) >= len(best):
                    best = run
        assert sorted(got.get(q, [])) == [x[0] for x in best], (q, cs)


def test_last_option(spark):
    rows = [("q", None, 0, 1, 0.0, 10.0), ("q", "A", 1, 1, 12.0, 22.0), ("q", "A", 2, 1, 90.0, 99.0), ("q", "B", 3, 1, 100.0, 110.0), ("q", "B", 4, 1, 115.0, 125.0), ("q", "B", 5, 1, 160.0, 170.0), ("q", "B", 6, 1, 171.0, 180.0)]
    df = spark.createDataFrame(rows, "q string, segment string, line int, page int, y0 double, y1 double")
    assert sorted(r.line for r in an.cut_last_option(df, ["q"], F.lit(10.0)).collect()) == [0, 1, 2, 3, 4]


def test_rows_of_a_picture(spark):
    box = lambda x, y, w=7.0, h=8.0: ("q", 1, x, y, x + w, y + h)
    blobs = spark.createDataFrame([box(50.0, 100.0), box(70.0, 100.0, 60.0), box(51.0, 130.0), box(50.0, 160.0), box(60.0, 160.0, 9.0), box(52.0, 190.0, 40.0)], "q string, page int, x0 double, y0 double, x1 double, y1 double")
    letters = spark.createDataFrame([("q", 50.2), ("q", 51.0), ("q", 300.0)], "q string, x0 double")
    rows = an.label_rows(blobs, letters, ["q"], 10.0)
    assert [(r.label, r.y0) for r in rows.orderBy("pos").collect()] == [("A", 100.0), ("B", 130.0)]
    items = spark.createDataFrame([("q", 1, 20.0, 1), ("q", 1, 97.0, 2), ("q", 1, 126.0, 3), ("q", 1, 127.0, 4), ("q", 2, 1.0, 5)], "q string, page int, y double, i int")
    assert [r.owner for r in an.owners(items, rows, ["q"], 10.0).orderBy("i").collect()] == [None, "A", "A", "B", "B"]
