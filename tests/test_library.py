"""Scalars, layout, validation, maths and assembly on small tables of our own."""

import bisect
import json
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry as g
from foliospark.functions import latex
from foliospark.functions import text as tx
from foliospark.operators import assemble as asm
from foliospark.operators import layout as lay
from foliospark.operators import validate as val
from foliospark.operators.mathbuild import rebuild
from foliospark.sources import papers as src


def one(spark, s, f, kind="string"):
    return spark.createDataFrame([(s,)], f"s {kind}").select(f(F.col("s")).alias("r")).first().r


@pytest.mark.parametrize(
    "said,minutes",
    [("Time: 1 hour 15 minutes", 75), ("75 mins", 75), ("1.5 hours", 90), ("two hours", 120), ("one hour and 10 minutes", 70), ("2 hr", 120), ("", None), ("no time", None)],
)
def test_duration(spark, said, minutes):
    assert one(spark, said, tx.parse_duration) == minutes


@pytest.mark.parametrize("said,n", [("20 questions", 20), ("There are sixteen multiple-choice questions", 16), ("answer all questions, 5 questions", 5), ("none", None)])
def test_question_count(spark, said, n):
    assert one(spark, said, tx.parse_question_count) == n


def test_names(spark):
    df = spark.createDataFrame([("Spring Set", "Paper 2"), ("Paper 2 mock", "Paper 2"), ("  ", None)], "t string, p string")
    got = [tuple(r) for r in df.select(tx.paper_id(F.col("t"), F.col("p")), tx.paper_filename(F.col("t"), F.col("p"))).collect()]
    assert got == [("spring-set-paper-2", "Spring_Set_Paper_2.json"), ("paper-2-mock", "Paper_2_mock.json"), ("paper", "paper.json")]
    assert one(spark, "a/b\\c d?.pdf", tx.safe_name) == "c_d_.pdf" and one(spark, "café ﬁ", tx.nfkd_ascii) == "cafe fi"


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 13.0, 14.0, 15.0, 16.0)], "x0 double, y0 double, x1 double, y1 double, ax0 double, ay0 double, ax1 double, ay1 double")
    a, b = g.box(), g.box("a")
    r = df.select(g.gap(a, b), g.area(g.union(a, b)), g.area(g.intersect(a, b)), g.overlap_fraction(g.expand(a, 4), b), g.contains(a, b, 6.0), g.is_empty(a)).first()
    assert tuple(r) == (5.0, 240.0, 0.0, 0.0, True, False)


def test_segments():
    parts, problems = latex.segments("let $x_{a$b}$ be $$y$$ or \\$")
    assert [p[0] for p in parts][:4] == ["text", "inline", "text", "display"] and problems == [("unclosed", 27)]
    assert latex.segments("a \\$x$ $$a$ b$$ $ $") == ([("text", "a \\", 0), ("inline", "x", 4), ("text", " ", 6), ("display", "a$ b", 9), ("text", " ", 15), ("inline", " ", 17)], [("escaped-dollar", 3), ("single-dollar", 7), ("empty", 16)])
    assert latex.segments(None) == ([], [])


CLEAN = ["plain words", "let $x^2$ be", "$$\\frac{1}{2}$$", "$\\left(a\\right)$", "a\nb", "$\\begin{cases}a\\end{cases}$", "price, 5"]
BAD = [
    ("", "empty"), ("a�b", "replacement-char"), ("a\tb", "control-char"), ("a", "private-char"), ("a​b", "invisible-char"), ("Ã©", "mojibake"), ("$\\\\frac{1}{2}$", "double-backslash"),
    ("one\\nTwo", "literal-backslash-n"), ("cost $5", "dollar-balance"), ("\\alpha here", "command-outside-math"), ("$frac{1}{2}$", "bare-command"), ("a {b", "text-braces"), ("$a \neq b$ \\times", "command-outside-math"), ("$a \neq b$".replace("\\n", "\n"), "eaten-backslash-n"), ("$x \\r y$", "unknown-command"), ("$\\frac{1}{2}}$", "brace-balance"), ("$\\frac{1}{2$", "dollar-balance"), ("$$a $ b$$", "dollar-balance"), ("a $$ $$", "dollar-balance"),
    ("$\\left(a$", "left-right"), ("$\\begin{a}x\\end{b}$", "environment"), ("$sin x$", "bare-function"), ("$a\nb$", "newline-in-inline-math"), ("$$a\\\\ b$$", "latex-linebreak"),
]


def test_string_rules(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*CLEAN, *[s for s, _ in BAD], None])], "id int, s string")
    found: dict = {}
    for r in val.string_issues(df, ["id"], "s").collect():
        found.setdefault(r.id, []).append((r.level, r.code))
    for i, s in enumerate(CLEAN):
        assert not [c for lv, c in found.get(i, []) if lv == "error"], (s, found.get(i))
    for i, (s, code) in enumerate(BAD, len(CLEAN)):
        assert code in [c for _, c in found.get(i, [])], (s, found.get(i))
    assert found[len(CLEAN) + len(BAD)] == [("error", "type")]


def paper(**change):
    q = lambda n: {"number": n, "stem": "What?", "options": [{"label": "A", "content": "1"}, {"label": "B", "content": "2"}], "images": [], "sourcePage": 2, "needsReview": False}
    return {"formatVersion": 1, "id": "set-1", "title": "Set", "paper": "Paper 1", "year": "2001", "durationMinutes": 75, "questions": [q(1), q(2)]} | change


def test_paper_rules(spark):
    base = paper()["questions"]
    cases = {
        "root": "[1]", "format-version": json.dumps(paper(formatVersion=True)), "duration": json.dumps(paper(durationMinutes="75")), "questions": json.dumps(paper(questions=[])),
        "extra-keys": json.dumps(paper(other=1)), "missing-keys": json.dumps({k: v for k, v in paper().items() if k != "year"}), "answer-leak": json.dumps(paper(questions=[base[0] | {"correct-answer": "A"}, base[1]])),
        "numbering": json.dumps(paper(questions=[base[1], base[0]])), "option-label": json.dumps(paper(questions=[base[0] | {"options": [{"label": "B", "content": "1"}, {"label": "A", "content": "2"}]}, base[1]])),
        "options": json.dumps(paper(questions=[base[0] | {"options": []}, base[1]])), "duplicate-option": json.dumps(paper(questions=[base[0] | {"options": [{"label": "A", "content": "x y"}, {"label": "B", "content": "xy"}]}, base[1]])),
        "source-page": json.dumps(paper(questions=[base[0] | {"sourcePage": 0}, base[1]])), "needs-review": json.dumps(paper(questions=[base[0] | {"needsReview": "no"}, base[1]])), "question-type": json.dumps(paper(questions=[1, base[1]])),
        "id-format": json.dumps(paper(id="Set 1")), "question-keys": json.dumps(paper(questions=[base[0] | {"x": 1}, base[1]])), "ok": json.dumps(paper()),
    }
    df = spark.createDataFrame(list(cases.items()), "paper_id string, json string")
    found: dict = {}
    for r in val.paper_issues(df).collect():
        found.setdefault(r.paper_id, []).append(r.code)
    assert found.pop("ok", []) == []
    for code in cases:
        assert code == "ok" or code in found.get(code, []), (code, found.get(code))


def glyphs(spark, *chars):
    rows = [("p", 1, i, float(x), base - 0.7 * size, x + 0.5 * size, base + 0.2 * size, float(base), float(size), ch, maths, space) for i, (ch, x, base, size, maths, space) in enumerate(chars)]
    return spark.createDataFrame(rows, "paper_id string, question int, gid int, x0 double, y0 double, x1 double, y1 double, base double, size double, ch string, math_font boolean, space_before boolean")


def rules(spark, *rows):
    return spark.createDataFrame([("p", 1, i, *r) for i, r in enumerate(rows)], "paper_id string, question int, rid int, x0 double, x1 double, y double")


def test_maths_rebuilt(spark):
    power = glyphs(spark, ("x", 10, 100, 10, True, False), ("2", 15, 96, 7, True, False), ("+", 22, 100, 10, True, False), ("y", 28, 100, 10, True, False))
    assert rebuild(power, rules(spark)).first().text == "$x^2 + y$"
    frac = glyphs(spark, ("a", 10, 96, 10, True, False), ("b", 10, 111, 10, True, False), ("i", 30, 103, 10, False, True), ("s", 33, 103, 10, False, False))
    got = rebuild(frac, rules(spark, (9.0, 16.0, 101.0))).first()
    assert got.text.startswith("$\\frac{a}{b}$") and got.error is None
    root = glyphs(spark, ("√", 10, 100, 10, True, False), ("x", 16, 100, 10, True, False))
    assert rebuild(root, rules(spark, (15.0, 22.0, 92.0))).first().text == "$\\sqrt{x}$"


def test_big_operators_and_paragraphs(spark):
    total = glyphs(spark, ("∑", 10, 100, 10, True, False), ("n", 11, 88, 6, True, False), ("1", 11, 110, 6, True, False), ("k", 20, 100, 10, True, False))
    assert rebuild(total, rules(spark)).first().text == "$\\sum_1^n k$"
    word = lambda s, x, y, maths=False: [(c, x + 5 * i, y, 10, maths, False) for i, c in enumerate(s)]
    text = word("firstlinehere", 10, 100) + word("goeson", 10, 112) + word("x=1", 35, 126, True) + word("then", 10, 140) + word("more", 10, 170)
    assert rebuild(glyphs(spark, *text), rules(spark)).first().text == "firstlinehere goeson\n\n$$x = 1$$\n\nthen\n\nmore"
    listed = [("I", 10, 100, 10, False, False), (".", 15, 100, 10, False, False)] + word("isaroot", 30, 100) + word("of", 30, 112) + [("I", 10, 124, 10, False, False), ("I", 15, 124, 10, False, False)] + word("other", 30, 124)
    assert rebuild(glyphs(spark, *listed), rules(spark)).first().text == "I. isaroot of\n\nII other"
    under = glyphs(spark, *word("ab", 10, 100), *word("cd", 22, 100))
    got = rebuild(under, rules(spark, (21.0, 33.0, 101.0))).first()
    assert got.problems == [] and "overline" not in got.text


def test_function_words(spark):
    word = lambda s, x, maths=False: [(c, x + 5 * i, 100, 10, maths, False) for i, c in enumerate(s)]
    bar = [("y", 12, 115, 10, True, False)]
    for chars, want in [
        (word("sin", 10) + word("x", 25, True), "\\sin x"), (word("asin", 10) + word("x", 30, True), "asinx"), (word("sin", 10) + word("+", 25, True) + word("sin", 30), "\\sin+\\sin"),
        (word("lcm", 10) + word("x", 25, True), "\\operatorname{lcm}x"), (word("sin", 10, True), "sin"), (word("si", 10) + word("n", 25), "sin"),
    ]:
        got = rebuild(glyphs(spark, *chars, *bar), rules(spark, (9.0, 60.0, 103.0))).first()
        assert got.text == f"$\\frac{{{want}}}{{y}}$", got.text
    assert rebuild(glyphs(spark, *word("sin", 10), *word("x", 25, True)), rules(spark)).first().text == "$\\sin x$"


def test_cross_check_and_flags(spark):
    a = spark.createDataFrame([(1, "ab $\\frac{1}{2}$"), (2, "xx")], "q int, text string")
    b = spark.createDataFrame([(1, "a b 1 2"), (2, "x")], "q int, text string")
    assert [tuple(r) for r in asm.cross_check(a, b, ["q"]).collect()] == [(2, 1, 0)]
    issues = spark.createDataFrame([(1, 2, "error", "b"), (1, 1, "error", "a"), (1, 3, "error", "b"), (2, 0, "warning", "c")], "q int, ord int, level string, code string")
    got = {r.q: (r.needs_review, r.review_reasons) for r in asm.flag(a, issues, ["q"]).collect()}
    assert got == {1: (True, ["a", "b"]), 2: (False, [])}


def test_combine(spark):
    papers = spark.createDataFrame([("x", 2, "Paper 2", "2001", 75), ("y", 1, "Paper 1", "2001", 75)], "paper_id string, pos int, paper string, year string, durationMinutes int")
    qs = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "paper_id string, number int")
    head, rows = asm.combine(qs, papers, "Both")
    assert (head.first().durationMinutes, head.first().year) == (150, "2001 Paper 1 + 2001 Paper 2")
    assert sorted((r.number, r.paper_id) for r in rows.collect()) == [(1, "y"), (2, "x"), (3, "x")]
    with pytest.raises(ValueError):
        asm.combine(qs, papers.limit(0), "None")


def test_json_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(paper(title="Ünï")))
    read = src.read_papers(spark, str(tmp_path / "a.json"))
    text = src.paper_text(src.typed(read)).first().json
    assert json.loads(text) == paper(title="Ünï") and text.startswith('{\n  "formatVersion": 1') and "Ü" in text
    assert one(spark, b"\x89PNG", lambda c: src.decode_data_uri(src.data_uri(c)), "binary") == b"\x89PNG"


def test_layout(spark):
    boxes = spark.createDataFrame([("p", 0.0, 0.0, 10.0, 10.0), ("p", 12.0, 0.0, 20.0, 10.0), ("p", 90.0, 0.0, 99.0, 9.0)], "k string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.x1 for r in lay.merge_boxes(boxes, ["k"], 3.0).collect()) == [20.0, 99.0]
    seq = spark.createDataFrame([("p", i, n) for i, n in enumerate([1, 7, 2, 2, 3, 9, 5])], "k string, o int, n int")
    assert lay.number_run(seq, ["k"], ["o"], "n").first().run == 3
    files = spark.createDataFrame([("b.pdf", 0), ("x.PNG", 1), ("y.jpg", 2), ("c.pdf", 3)], "path string, pos int")
    assert sorted((r.input, r.paths) for r in asm.group_inputs(files).collect()) == [(0, ["b.pdf"]), (1, ["x.PNG", "y.jpg"]), (3, ["c.pdf"])]


def test_label_runs(spark):
    said = ["A one", "(B) two", "text", "A. uno", "B) dos", "C tres", "E odd", "And so", "D"]
    df = spark.createDataFrame([("p", i, s) for i, s in enumerate(said)] + [("q", 0, "B"), ("r", 0, "A")], "k string, o int, s string")
    assert {tuple(r) for r in lay.label_run(df, ["k"], "o", "s").collect()} == {("p", 4, 3), ("r", 1, 0)}


def test_regions_end_at_blank_pages(spark):
    box = lambda y: (50.0, y, 60.0, y + 10)
    marks = [("p", 1, 2, *box(50.0)), ("p", 2, 2, *box(300.0)), ("p", 3, 3, *box(60.0)), ("p", 4, 6, *box(70.0)), ("q", 1, 1, *box(200.0)), ("q", 2, 2, *box(30.0))]
    anchors = spark.createDataFrame(marks, "paper_id string, number int, page int, x0 double, y0 double, x1 double, y1 double")
    pages = [("p", n, 800.0, n == 5, None if n == 4 else 30.0, None if n == 4 else 700.0) for n in range(1, 8)] + [("q", n, 800.0, False, 30.0, 799.0) for n in (1, 2)]
    pages = spark.createDataFrame(pages, "paper_id string, page int, height double, blank boolean, top double, bottom double")
    images = spark.createDataFrame([("q", 1, 70.0, 120.0, 200.0, 205.0), ("p", 2, 70.0, 40.0, 90.0, 301.0), ("q", 1, 10.0, 20.0, 40.0, 205.0)], "paper_id string, page int, x0 double, y0 double, x1 double, y1 double")
    want = [("p", 1, 2, 41.0, 291.0), ("p", 2, 2, 291.0, 704.0), ("p", 2, 3, 24.0, 51.0), ("p", 3, 3, 51.0, 704.0), ("p", 4, 6, 61.0, 704.0), ("p", 4, 7, 24.0, 704.0), ("q", 1, 1, 191.0, 800.0), ("q", 2, 2, 21.0, 800.0)]
    assert sorted(tuple(r) for r in lay.question_regions(anchors, pages).collect()) == want
    with_pictures = [(*r[:3], {("q", 1): 116.0, ("p", 1): 36.0}.get(r[:2], r[3]), r[4]) for r in want]
    assert sorted(tuple(r) for r in lay.question_regions(anchors, pages, images=images).collect()) == with_pictures


def test_nearest_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), float(rng.randrange(40)) if rng.random() < 0.95 else None) for i in range(200)]
    others = [(i, rng.choice("ab"), float(rng.randrange(40))) for i in range(60)]
    got = lay.nearest(spark.createDataFrame(rows, "i int, k string, v double"), spark.createDataFrame(others, "o int, k string, v double"), ["k"], "v", "o").collect()
    want = {i: min(((abs(x - v), o) for o, q, x in others if q == k), default=(0, None))[1] if v is not None else None for i, k, v in rows}
    assert {r.i: r.o for r in got} == want and len(got) == len(rows)


def test_nearest_in_a_large_key(spark):
    rng = random.Random(2)
    rows, others = [(i, "a", rng.randrange(10**6) / 4) for i in range(20_000)], [(i, "a", rng.randrange(10**6) / 4) for i in range(3_000)]
    found = lay.nearest(spark.createDataFrame(rows, "i int, k string, v double"), spark.createDataFrame(others, "o int, k string, v double"), ["k"], "v", "o")
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()  # such a frame is quadratic in a key's rows
    line = sorted({v: o for o, _, v in reversed(others)}.items())
    at = lambda v: line[max(bisect.bisect_left(line, (v, -1)) - 1, 0) :][:2]
    assert {r.i: r.o for r in found.collect()} == {i: min((abs(x - v), o) for x, o in at(v))[1] for i, _, v in rows}


def test_stream(spark, tmp_path):
    from foliospark.streaming.papers import issue_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("[]")
    q = issue_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("issues").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.code for r in spark.table("issues").collect()] == ["root"]
