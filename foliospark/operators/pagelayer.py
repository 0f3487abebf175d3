"""The page layer: from spans, characters, drawings and pictures to lines, glyphs, rules and graphics.

Tables carry (paper_id, page); every join below has both as equality, so that work is dealt by page, and
windows are over one page or one paper. Boxes are columns x0, y0, x1, y1 in points, origin top left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.functions import geometry as g
from foliospark.functions import text as tx

PAGE = ["paper_id", "page"]
# Fonts that draw lines, bold and italic fonts, fonts of maths; dashes that OCR reads for bars.
DRAWING_FONT = r"(?i)^(?:[A-Z]{6}\+)?(?:line|lcircle|linew|lcirclew)[0-9]*\z"
BOLD_FONT, ITALIC_FONT = r"(?i)bold|black", r"(?i)italic|oblique"
MATH_FONT = r"(?i)math|cmmi|cmsy|cmex|symbol|stix"
DASHES = "—–-_─‒―"
LABEL, NUMBER_ONLY, QUESTION_START = r"^\(?[A-J](?:[).]|\s|\z)", r"^[0-9]{1,3}\z", r"^(?:Question\s+|Q\s*)?[0-9]{1,3}[.):]?(?:\s|\z)"


def _side(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    """df with its boxes and the named columns under a prefix, PAGE as it is."""
    return df.select(*PAGE, *[F.col(c).alias(prefix + c) for c in (*g.SIDES, *more)])


def _centre_in(areas: DataFrame) -> tuple[DataFrame, list]:
    a = areas.select(*[F.col(c).alias(f"_{c}") for c in (*PAGE, *g.SIDES)])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return a, [F.col("paper_id") == F.col("_paper_id"), F.col("page") == F.col("_page"), g.contains_point(g.box("_"), x, y)]


def merged_layers(native: DataFrame, ocr: DataFrame, areas: DataFrame) -> DataFrame:
    """Lines of a page: its own with their centre outside of the OCR areas, OCR lines inside of one."""
    a, on = _centre_in(areas)
    return native.join(a, on, "left_anti").unionByName(ocr.join(a, on, "left_semi"))


def text_pictures(images: DataFrame, words: DataFrame) -> DataFrame:
    """The images that are pictures of text: four words or more of three letters with a vowel lie in
    them and cover 1.5 % of their area."""
    is_word = F.col("word").rlike(r"[A-Za-z]{3,}") & F.col("word").rlike(r"(?i)[aeiouy]")
    w = words.where(is_word).select(*[F.col(c).alias(f"_{c}") for c in (*PAGE, *g.SIDES)])
    x, y = (F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2
    on = [F.col(c) == F.col(f"_{c}") for c in PAGE] + [g.contains_point(g.box(), x, y)]
    by = images.join(w, on).groupBy(*PAGE, *g.SIDES).agg(F.count("*").alias("n"), F.sum(g.area(g.box("_"))).alias("covered"))
    return by.where((F.col("n") >= 4) & (F.col("covered") >= 0.015 * g.area(g.box()))).select(*PAGE, *g.SIDES)


def ocr_areas(pages: DataFrame, images: DataFrame, words: DataFrame) -> DataFrame:
    """(paper_id, page, box, mode): what to read by OCR. A page without text of its own is read whole;
    on others, big pictures (over 25 % of the width, 3 % of the height) that are pictures of text.

    pages(paper_id, page, width, height, has_text), images(box), words(word, box), as a first reading of
    the pictures gives them."""
    full = pages.where("not has_text").select(*PAGE, F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"), F.lit("full").alias("mode"))
    big = images.join(pages.where("has_text"), PAGE).where((g.width(g.box()) > 0.25 * F.col("width")) & (g.height(g.box()) > 0.03 * F.col("height"))).select(*PAGE, *g.SIDES)
    return full.unionByName(text_pictures(big, words).withColumn("mode", F.lit("partial")))


def in_areas(boxes: DataFrame, areas: DataFrame, how: str = "left_semi") -> DataFrame:
    """Boxes of which some area covers over half (or, left_anti, those of which none does)."""
    a = areas.select(*[F.col(c).alias(f"_{c}") for c in (*PAGE, *g.SIDES)])
    return boxes.join(a, [F.col(c) == F.col(f"_{c}") for c in PAGE] + [g.overlap_fraction(g.box("_"), g.box()) > 0.5], how)


def page_text(lines: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.bround("y0", 1).alias("y"), "x0", "text")))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def lines_of_spans(spans: DataFrame) -> DataFrame:
    """Lines from spans(paper_id, page, line, ord, text, font, flags, size, box): text with a space
    where spans are over 0.2 sizes apart, box, size, the first span's text, box and weight.

    Spans of drawing fonts and blank lines go. Lines are numbered in reading order (n)."""
    w = Window.partitionBy(*PAGE, "line").orderBy("ord")
    rows = spans.where(~F.coalesce(F.col("font"), F.lit("")).rlike(DRAWING_FONT)).withColumn("text", tx.clean_text(F.col("text")))
    apart = (F.col("x0") - F.lag("x1").over(w) > 0.2 * F.col("size")) & ~F.lag("text").over(w).rlike(r"\s\z") & ~F.col("text").rlike(r"^\s")
    rows = rows.withColumn("piece", F.when(apart, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    first = F.when(F.trim("text") != "", F.struct("ord", "text", *g.SIDES, ((F.col("flags").bitwiseAND(16) != 0) | F.col("font").rlike(BOLD_FONT)).alias("bold")))
    held = F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda r: r["piece"])
    by = rows.groupBy(*PAGE, "line").agg(
        F.regexp_replace(F.trim(F.array_join(held, "")), r"[ \t]+", " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("size").alias("size"), F.min(first).alias("f"),
    )
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.bround("y0", 1), "x0", "line"))
    return by.where("text <> ''").select(*PAGE, n.alias("n"), "text", *g.SIDES, "size", F.trim("f.text").alias("first_text"), *[F.col(f"f.{s}").alias(f"first_{s}") for s in g.SIDES], F.col("f.bold").alias("first_bold"))


def furniture(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines that are running heads, feet or page numbers.

    A head or foot is a shape of text (digits alike) at one height on at least three pages and half of
    them. A page number is a bare number in the top or bottom 9 %, not at the left, that stands alone."""
    key = [F.regexp_replace(F.lower("text"), "[0-9]+", "#").alias("shape"), F.bround(F.col("y0") / 6).alias("at")]
    rows = lines.select("*", *key)
    count = pages.groupBy("paper_id").agg(F.count_distinct("page").alias("n_pages"))
    fair = rows.where(~F.col("text").rlike(NUMBER_ONLY) & ~F.col("text").rlike(QUESTION_START) & ~F.col("text").rlike(LABEL))
    seen = fair.groupBy("paper_id", "shape", "at").agg(F.count_distinct("page").alias("seen")).join(count, "paper_id")
    running = seen.where((F.col("n_pages") >= 3) & (F.col("seen") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") * 0.5 + 0.5)))).select("paper_id", "shape", "at")
    repeated = rows.where(~F.col("text").rlike(QUESTION_START)).join(running, ["paper_id", "shape", "at"], "left_semi").drop("shape", "at").select(lines.columns)
    margin = (F.col("y1") < F.col("height") * 0.09) | (F.col("y0") > F.col("height") * 0.91)
    numbers = lines.where(F.col("text").rlike(NUMBER_ONLY)).join(pages.select(*PAGE, "width", "height"), PAGE).where(margin & (F.col("x0") > F.col("width") * 0.25)).select(lines.columns)
    o = lines.where(~F.col("text").rlike(NUMBER_ONLY)).select(*[F.col(c).alias(f"_{c}") for c in (*PAGE, *g.SIDES)])
    h = F.greatest(g.height(g.box()), F.lit(1.0))
    beside = (F.least("y1", "_y1") - F.greatest("y0", "_y0") > 0.2 * h) & (F.col("_x0") - F.col("x1") < 3 * h) & (F.col("x0") - F.col("_x1") < 3 * h)
    alone = numbers.join(o, [F.col(c) == F.col(f"_{c}") for c in PAGE] + [beside], "left_anti")
    return repeated.unionByName(alone).distinct()


def content(lines: DataFrame, pages: DataFrame) -> DataFrame:
    return lines.join(furniture(lines, pages).select(*PAGE, "n"), [*PAGE, "n"], "left_anti").select(lines.columns)


def blank_pages(content_lines: DataFrame, graphics: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, page, blank): all of a page's text says so; or it has neither text nor graphics and
    under 0.2 % of its pixels are dark (pages.dark, null where it was not drawn)."""
    by = content_lines.groupBy(*PAGE).agg(F.bool_and(F.col("text").rlike(r"(?i)\bblank\s+page\b|\bpage\s+(?:is\s+)?(?:intentionally\s+)?(?:left\s+)?blank\b")).alias("says"))
    rows = pages.join(by, PAGE, "left").join(graphics.select(*PAGE).distinct().withColumn("drawn", F.lit(True)), PAGE, "left")
    empty = F.col("drawn").isNull() & (F.coalesce("dark", F.lit(0.0)) < 0.002)
    return rows.select(*PAGE, F.coalesce("says", empty).alias("blank"))


def content_boxes(content_lines: DataFrame, graphics: DataFrame) -> DataFrame:
    both = content_lines.select(*PAGE, *g.SIDES).unionByName(graphics.select(*PAGE, *g.SIDES))
    return both.groupBy(*PAGE).agg(*[(F.min if s[1] == "0" else F.max)(s).alias(s) for s in g.SIDES])


def _flat(i: Column) -> Column:
    return (i["kind"] == "re") | ((i["kind"] == "l") & (F.abs(i["y0"] - i["y1"]) < 0.3))


def bars(drawings: DataFrame) -> DataFrame:
    """Thin horizontal lines (fraction bars, root bars) as (paper_id, page, x0, x1, y), from drawings(
    paper_id, page, box, items array of (kind, x0, y0, x1, y1)): a drawing that is one itself, or the
    bars of a small drawing that holds nothing slanted."""
    thin = (g.height(g.box()) <= 1.6) & (g.width(g.box()) >= 2.0)
    plain = F.forall("items", lambda i: i["kind"].isin("l", "re", "qu"))
    whole = drawings.where(thin & plain).select(*PAGE, "x0", "x1", ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    group = drawings.where(~thin & (g.height(g.box()) <= 40) & (F.size("items") <= 8) & F.forall("items", _flat)).select(*PAGE, F.explode("items").alias("i"))
    x0, x1, high = F.least("i.x0", "i.x1"), F.greatest("i.x0", "i.x1"), F.abs(F.col("i.y1") - F.col("i.y0"))
    return whole.unionByName(group.where((high <= 1.6) & (x1 - x0 >= 2.0)).select(*PAGE, x0.alias("x0"), x1.alias("x1"), ((F.col("i.y0") + F.col("i.y1")) / 2).alias("y")))


def drawn_roots(drawings: DataFrame) -> DataFrame:
    """(paper_id, page, box, bar_x0, bar_x1, bar_y) of root signs that are drawn: lines only, a bar along
    the top, all else left of the bar, and something that reaches the bottom."""
    lines = drawings.where((F.size("items") >= 2) & F.forall("items", lambda i: i["kind"] == "l") & (g.height(g.box()) >= 4) & (g.width(g.box()) >= 4))
    level = F.filter("items", lambda i: (F.abs(i["y0"] - i["y1"]) < 0.4) & (F.abs(i["x0"] - i["x1"]) > 2))
    top = F.element_at(F.array_sort(F.transform(level, lambda i: F.struct(i["y0"].alias("y"), i.alias("i")))), 1)["i"]
    rows = lines.where(F.size(level) > 0).withColumn("top", top)
    x0, x1 = F.least("top.x0", "top.x1"), F.greatest("top.x0", "top.x1")
    others = F.filter("items", lambda i: i != F.col("top"))
    sign = (F.abs(F.col("top.y0") - F.col("y0")) <= 1) & (F.size(others) > 0) & F.forall(others, lambda i: F.greatest(i["x0"], i["x1"]) <= x0 + 1) & F.exists(others, lambda i: F.greatest(i["y0"], i["y1"]) > F.col("y1") - 1)
    return rows.where(sign).select(*PAGE, *g.SIDES, x0.alias("bar_x0"), x1.alias("bar_x1"), F.col("top.y0").alias("bar_y"))


def dash_bars(glyphs: DataFrame, size: Column) -> tuple[DataFrame, DataFrame]:
    """(bars, glyphs without them): runs of dashes that OCR read for a bar, at one height (2 points)
    with no gap over 1.5, at least 1.2 body sizes wide."""
    cy = (F.col("y0") + F.col("y1")) / 2
    dash = F.col("ocr") & F.col("ch").isin(list(DASHES))
    order = Window.partitionBy(*PAGE).orderBy(F.bround("cy"), "x0", "gid")
    rows = glyphs.where(dash).select("*", cy.alias("cy"), size.alias("body"))
    new = (F.abs(F.col("cy") - F.lag("cy").over(order)) > 2) | (F.col("x0") - F.lag("x1").over(order) > 1.5)
    rows = rows.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    by = rows.groupBy(*PAGE, "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.avg("cy").alias("y"), F.max("body").alias("body"))
    wide = by.where(F.col("x1") - F.col("x0") >= 1.2 * F.col("body"))
    used = rows.join(wide.select(*PAGE, "run"), [*PAGE, "run"], "left_semi").select(*PAGE, "gid")
    return wide.select(*PAGE, "x0", "x1", "y"), glyphs.join(used, [*PAGE, "gid"], "left_anti").select(glyphs.columns)


def graphics(pages: DataFrame, clusters: DataFrame, images: DataFrame, areas: DataFrame, blobs: DataFrame, lines: DataFrame) -> DataFrame:
    """Boxes of drawings and pictures: clusters of drawings; images that are no pictures of text; in
    those, the blobs of ink of which text covers under half. Bars, page frames and bands are left out."""
    box_ = [*PAGE, *g.SIDES]
    texts = lines.select(*[F.col(c).alias(f"_{c}") for c in box_])
    covered = blobs.select(*box_).distinct().join(texts, [F.col(c) == F.col(f"_{c}") for c in PAGE] + [~g.is_empty(g.intersect(g.box(), g.box("_")))], "left")
    covered = covered.groupBy(*box_).agg(F.coalesce(F.sum(F.when(F.col("_x0").isNotNull(), g.area(g.intersect(g.box(), g.box("_"))))), F.lit(0.0)).alias("covered"))
    drawn = covered.where(F.col("covered") < 0.5 * g.area(g.box())).select(*box_)
    rows = clusters.select(*box_).unionByName(in_areas(images.select(*box_), areas, "left_anti")).unionByName(drawn).join(pages.select(*PAGE, "width", "height"), PAGE)
    page_box = {"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.col("width"), "y1": F.col("height")}
    rows = rows.select(*PAGE, "width", "height", *[c.alias(s) for s, c in g.clamp(g.box(), page_box).items()])
    w, h = g.width(g.box()), g.height(g.box())
    wide = w > F.col("width") * 0.92
    return rows.where((w > 0) & (h > 0) & (F.least(w, h) >= 3.0) & ~(wide & (h > F.col("height") * 0.8)) & ~(wide & (h < 12))).select(*box_)


def plausible(c: Column) -> Column:
    """Whether a text layer's character is one that a paper can hold: no control, private, unassigned or
    replacement character, and none of scripts that mark a broken encoding."""
    return c.rlike(r"^[\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}]\z") & (c != "\ufffd") & ~c.rlike(r"[\p{Co}\p{Cs}\p{Cn}]") & (F.ascii(c) < 0x20000)


def repaired(chars: DataFrame, trace: DataFrame, fonts: DataFrame) -> DataFrame:
    """chars(paper_id, page, gid, c, x, y, font) with c put right where it is not plausible.

    trace(paper_id, page, ord, x, y, font, glyph) is what was drawn: it is matched on the origin in
    quarters of a point, the last of equal places wins. fonts(font, glyph, c) gives a glyph's character;
    what none gives becomes U+FFFD. As only broken characters are joined, the join is small."""
    at = lambda: [F.bround(F.col("x") * 4).cast("long").alias("qx"), F.bround(F.col("y") * 4).cast("long").alias("qy")]
    ok = plausible(F.col("c")) | F.col("c").rlike(r"^\s?\z") | F.col("c").isin(list(tx.ZERO_WIDTH))
    drawn = trace.select(*PAGE, *at(), "ord", F.col("font").alias("drawn"), "glyph").groupBy(*PAGE, "qx", "qy").agg(F.max_by(F.struct("drawn", "glyph"), "ord").alias("d"))
    found = drawn.select(*PAGE, "qx", "qy", F.col("d.drawn").alias("drawn"), F.col("d.glyph").alias("glyph")).join(fonts.select(F.col("font").alias("drawn"), "glyph", F.col("c").alias("real")), ["drawn", "glyph"])
    broken = chars.where(~ok).select("*", *at()).join(found.select(*PAGE, "qx", "qy", "real"), [*PAGE, "qx", "qy"], "left")
    return chars.where(ok).unionByName(broken.withColumn("c", F.coalesce("real", F.lit("\ufffd"))).select(chars.columns))


def glyphs_of(chars: DataFrame) -> DataFrame:
    """Glyphs from chars(paper_id, page, gid, c, font, flags, size, base, box): white space, characters
    without width and drawing fonts go; ch is the character in its compatibility form, but for raised and
    lowered ones; bold, italic, math_font and ocr come from the font; space_before tells of white space
    between a glyph and the one before."""
    font = F.coalesce(F.col("font"), F.lit(""))
    rows = chars.where(~font.rlike(DRAWING_FONT))
    is_space = F.col("c").rlike(r"^[\s\u00a0]\z")
    order = Window.partitionBy(*PAGE).orderBy("gid")
    rows = rows.withColumn("_space", F.when(is_space, F.col("gid"))).withColumn("_seen", F.when(~is_space, F.col("gid")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last_space, last_seen = F.max("_space").over(before), F.max("_seen").over(before)
    rows = rows.withColumn("space_before", F.coalesce(last_space > F.coalesce(last_seen, F.lit(-1)), F.lit(False)))
    rows = rows.where(~is_space & (F.col("c") != "") & ~F.col("c").isin(list(tx.ZERO_WIDTH)) & ((F.col("x1") - F.col("x0") > 0.01) | (F.col("y1") - F.col("y0") > 0.01)))
    raised = F.col("c").rlike(r"[²³¹⁰-ₜ]")
    ocr = F.contains(font, F.lit("GlyphLess"))
    flag = lambda bit, pattern: ~ocr & ((F.col("flags").bitwiseAND(bit) != 0) | font.rlike(pattern))
    ch = F.when(F.col("c") == "−", "-").when(raised, F.col("c")).otherwise(tx.nfkc(F.col("c")))
    return rows.select(
        *PAGE, "gid", *g.SIDES, "base", "size", ch.alias("ch"), F.col("c").alias("raw"), "font", flag(16, BOLD_FONT).alias("bold"), flag(2, ITALIC_FONT).alias("italic"),
        (~ocr & font.rlike(MATH_FONT)).alias("math_font"), (F.col("c") != "\ufffd").alias("known"), ocr.alias("ocr"), "space_before",
    )


def body_size(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size): the most frequent size, to a tenth, of letters and digits, else of all; ties go to
    the one seen first."""
    rows = glyphs.select(*keys, F.bround("size", 1).alias("size"), "gid", F.col("ch").rlike(r"^[\p{L}\p{N}]\z").alias("word"))
    by = rows.groupBy(*keys, "size").agg(F.count_if("word").alias("words"), F.count("*").alias("n"), F.min(F.when(F.col("word"), F.col("gid"))).alias("first_word"), F.min("gid").alias("first"))
    has = F.max("words").over(Window.partitionBy(*keys)) > 0
    score = F.when(has, F.struct(F.col("words").alias("n"), (-F.coalesce("first_word", F.lit(2**62))).alias("o"))).otherwise(F.struct(F.col("n"), (-F.col("first")).alias("o")))
    return by.withColumn("score", score).groupBy(*keys).agg(F.max_by("size", "score").alias("size"))


#: The schema of a drawing's items, for sources that read them.
ITEMS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(s, T.DoubleType()) for s in g.SIDES]]))
