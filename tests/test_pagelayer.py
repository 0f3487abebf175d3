"""The page layer on small pages of our own."""

from foliospark.operators import pagelayer as pl

BOX = "x0 double, y0 double, x1 double, y1 double"


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def boxes(spark, *rows):
    return df(spark, [("p", *r) for r in rows], f"paper_id string, page int, {BOX}")


def lines(spark, rows):
    return df(spark, [("p", p, n, t, x, y, x + 8.0 * len(t), y + 10) for p, n, t, x, y in rows], f"paper_id string, page int, n int, text string, {BOX}")


def test_ocr_and_layers(spark):
    pages = df(spark, [("p", 1, 600.0, 800.0, True), ("p", 2, 600.0, 800.0, False)], "paper_id string, page int, width double, height double, has_text boolean")
    images = boxes(spark, (1, 0.0, 0.0, 300.0, 100.0), (1, 0.0, 200.0, 300.0, 300.0), (1, 0.0, 400.0, 20.0, 420.0))
    words = df(spark, [("p", 1, w, 10.0 + 40 * i, 10.0, 45.0 + 40 * i, 30.0) for i, w in enumerate(["find", "the", "value", "area", "bcd"])], f"paper_id string, page int, word string, {BOX}")
    areas = pl.ocr_areas(pages, images, words)
    assert sorted((r.page, r.mode, r.y1) for r in areas.collect()) == [(1, "partial", 100.0), (2, "full", 800.0)]
    native = lines(spark, [(1, 1, "in", 10.0, 20.0), (1, 2, "out", 10.0, 120.0)])
    ocr = lines(spark, [(1, 1, "read", 10.0, 20.0), (1, 2, "not", 10.0, 120.0), (2, 1, "scan", 5.0, 5.0)])
    assert sorted(r.text for r in pl.merged_layers(native, ocr, areas).collect()) == ["out", "read", "scan"]
    assert [r.y1 for r in pl.in_areas(images, areas).collect()] == [100.0]


def test_lines_of_spans(spark):
    spans = [("p", 1, 1, 0, "Find", "Arial-Bold", 0, 10.0, 10.0, 50.0, 30.0, 60.0), ("p", 1, 1, 1, "x", "Arial", 0, 10.0, 33.0, 50.0, 40.0, 60.0), ("p", 1, 1, 2, "+1", "Arial", 0, 10.0, 41.0, 50.0, 50.0, 60.0),
             ("p", 1, 2, 0, "zz", "LINE10", 0, 10.0, 1.0, 1.0, 2.0, 2.0), ("p", 1, 3, 0, " ", "Arial", 0, 10.0, 1.0, 1.0, 2.0, 2.0), ("p", 1, 4, 0, "top", "Arial", 16, 9.0, 1.0, 1.0, 2.0, 2.0)]
    got = pl.lines_of_spans(df(spark, spans, f"paper_id string, page int, line int, ord int, text string, font string, flags int, size double, {BOX}"))
    assert [(r.n, r.text, r.x1, r.first_text, r.first_bold) for r in got.orderBy("n").collect()] == [(1, "top", 2.0, "top", True), (2, "Find x+1", 50.0, "Find", True)]
    assert pl.page_text(got).first().text == "top\nFind x+1"


def test_furniture_and_blank(spark):
    pages = df(spark, [("p", i, 600.0, 800.0, None) for i in (1, 2, 3, 4)], "paper_id string, page int, width double, height double, dark double")
    rows = [(i, 1, f"Set {i} of 4", 200.0, 20.0) for i in (1, 2, 3)] + [(i, 2, str(i), 300.0, 770.0) for i in (1, 2)] + [(1, 3, "7", 50.0, 770.0), (2, 3, "2", 300.0, 20.5), (2, 4, "words", 200.0, 400.0), (3, 3, "This page is blank", 200.0, 300.0)]
    all_lines = lines(spark, rows)
    kept = pl.content(all_lines, pages)
    assert sorted((r.page, r.text) for r in kept.collect()) == [(1, "7"), (2, "2"), (2, "words"), (3, "This page is blank")]
    none = boxes(spark, (1, 0.0, 0.0, 9.0, 9.0))
    assert sorted((r.page, r.blank) for r in pl.blank_pages(kept, none, pages).collect()) == [(1, False), (2, False), (3, True), (4, True)]
    assert {r.page: r.x0 for r in pl.content_boxes(kept, none).collect()} == {1: 0.0, 2: 200.0, 3: 200.0}


def test_bars_and_roots(spark):
    item = lambda kind, *b: {"kind": kind, **dict(zip(("x0", "y0", "x1", "y1"), b, strict=True))}
    rows = [
        ("p", 1, 0.0, 10.0, 20.0, 11.0, [item("l", 0.0, 10.0, 20.0, 11.0)]),
        ("p", 1, 0.0, 20.0, 30.0, 50.0, [item("re", 0.0, 20.0, 30.0, 21.0), item("re", 0.0, 49.0, 10.0, 50.0)]),
        ("p", 1, 0.0, 60.0, 30.0, 72.0, [item("l", 0.0, 66.0, 4.0, 72.0), item("l", 4.0, 72.0, 8.0, 60.0), item("l", 8.0, 60.0, 30.0, 60.0)]),
    ]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("paper_id", T.StringType()), T.StructField("page", T.IntegerType()), *[T.StructField(s, T.DoubleType()) for s in ("x0", "y0", "x1", "y1")], T.StructField("items", pl.ITEMS)])
    drawings = df(spark, rows, schema)
    assert sorted((r.x1, r.y) for r in pl.bars(drawings).collect()) == [(10.0, 49.5), (20.0, 10.5), (30.0, 20.5)]
    assert [(r.bar_x0, r.bar_x1, r.bar_y) for r in pl.drawn_roots(drawings).collect()] == [(8.0, 30.0, 60.0)]


def test_dashes(spark):
    rows = [("p", 1, i, "-", 10.0 + 5 * i, 50.0, 15.0 + 5 * i, 52.0, True) for i in range(4)] + [("p", 1, 9, "-", 100.0, 50.0, 105.0, 52.0, True), ("p", 1, 10, "a", 10.0, 60.0, 15.0, 70.0, True)]
    from pyspark.sql import functions as F

    glyphs = df(spark, rows, f"paper_id string, page int, gid int, ch string, {BOX}, ocr boolean")
    found, left = pl.dash_bars(glyphs, F.lit(10.0))
    assert [(r.x0, r.x1, r.y) for r in found.collect()] == [(10.0, 30.0, 51.0)] and sorted(r.gid for r in left.collect()) == [9, 10]


def test_graphics(spark):
    pages = df(spark, [("p", 1, 600.0, 800.0)], "paper_id string, page int, width double, height double")
    clusters = boxes(spark, (1, 10.0, 10.0, 60.0, 60.0), (1, 0.0, 0.0, 600.0, 790.0), (1, 0.0, 5.0, 590.0, 12.0), (1, 5.0, 5.0, 90.0, 6.0), (1, 590.0, 100.0, 700.0, 200.0))
    images, areas = boxes(spark, (1, 100.0, 100.0, 300.0, 300.0), (1, 400.0, 400.0, 500.0, 500.0)), boxes(spark, (1, 90.0, 90.0, 310.0, 310.0))
    blobs = boxes(spark, (1, 110.0, 110.0, 150.0, 120.0), (1, 200.0, 200.0, 280.0, 280.0))
    text = lines(spark, [(1, 1, "words", 110.0, 110.0)])
    got = pl.graphics(pages, clusters, images, areas, blobs, text)
    assert sorted((r.x0, r.x1) for r in got.collect()) == [(10.0, 60.0), (200.0, 280.0), (400.0, 500.0), (590.0, 600.0)]


def test_glyphs(spark):
    schema = f"paper_id string, page int, gid int, c string, font string, flags int, size double, base double, {BOX}, x double, y double"
    at = lambda i, c, font="Times", flags=0: ("p", 1, i, c, font, flags, 10.0, 90.0, 10.0 * i, 80.0, 10.0 * i + 5, 92.0, 10.0 * i, 90.0)
    chars = df(spark, [at(0, "a"), at(1, " "), at(2, ""), at(3, "²"), at(4, "ﬁ", "Times-Italic"), at(5, "\u200b"), at(6, "−", "CMSY10"), at(7, ""), at(8, "z", "GlyphLessFont", 16)], schema)
    trace = df(spark, [("p", 1, 0, 20.02, 90.0, "F1", 6), ("p", 1, 1, 20.03, 90.0, "F1", 7)], "paper_id string, page int, ord int, x double, y double, font string, glyph int")
    fonts = df(spark, [("F1", 7, "∫"), ("F1", 6, "x")], "font string, glyph int, c string")
    got = pl.glyphs_of(pl.repaired(chars, trace, fonts)).orderBy("gid").collect()
    assert [(r.ch, r.space_before) for r in got] == [("a", False), ("∫", True), ("²", False), ("fi", False), ("-", False), ("\ufffd", False), ("z", False)]
    assert [r.gid for r in got if r.italic] == [4] and [r.gid for r in got if r.math_font] == [6] and [r.gid for r in got if not r.known] == [7] and [r.gid for r in got if r.ocr] == [8]
    assert pl.body_size(pl.glyphs_of(chars), ["paper_id"]).first().size == 10.0
