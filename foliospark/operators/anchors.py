"""Question numbers and option labels: candidates by joins and gaps, runs by ordered folds.

A fold runs over the candidates of one paper (numbers) or one question (labels), which are few; all
lines and glyphs are only filtered, joined by page or read through windows over one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import geometry as g
from foliospark.operators.layout import densest
from foliospark.operators.pagelayer import PAGE

# Fixed value: the letters of options.
LABELS = "ABCDEFGHIJ"
_NUMBER = r"^([0-9]{1,3})[.):]?(?:\s|\z)"
_WORDED = r"^(?:Question|Q)\s*([0-9]{1,3})(?![0-9])[.):]?"


def number_candidates(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, page, n, number, box, bold, edge): lines that begin with a number in the left quarter
    of the page and are first on their height; edge marks bare numbers that are a page's first or last
    line. lines as pagelayer.lines_of_spans makes them, without furniture."""
    every = Window.partitionBy(*PAGE)
    number = F.coalesce(F.nullif(F.regexp_extract("first_text", _NUMBER, 1), F.lit("")), F.nullif(F.regexp_extract("text", _WORDED, 1), F.lit("")))
    at_edge = (F.col("y0") == F.min("y0").over(every)) | (F.col("y1") == F.max("y1").over(every))
    rows = lines.withColumns({"number": number.try_cast("int"), "edge": at_edge & F.trim("text").rlike(r"^[0-9]{1,3}\z")})
    rows = rows.where("number is not null").join(pages.select(*PAGE, "width"), PAGE).where(F.col("first_x0") <= F.col("width") * 0.25)
    o = lines.select(*[F.col(c).alias(f"_{c}") for c in (*PAGE, "n", *g.SIDES)])
    overlap = F.least("y1", "_y1") - F.greatest("y0", "_y0")
    before = (F.col("n") != F.col("_n")) & (F.col("_x1") <= F.col("first_x0") + 1) & (overlap > 0.5 * F.least(F.col("y1") - F.col("y0"), F.col("_y1") - F.col("_y0")))
    rows = rows.join(o, [F.col(c) == F.col(f"_{c}") for c in PAGE] + [before], "left_anti")
    return rows.select(*PAGE, "n", "number", *[F.col(f"first_{s}").alias(s) for s in g.SIDES], F.coalesce("first_bold", F.lit(False)).alias("bold"), "edge")


def without_page_numbers(candidates: DataFrame) -> DataFrame:
    """candidates but for page numbers in their column: edge numbers that go up by one a page, on three
    pages or more, half of which have another candidate. Of equally long series the first one counts."""
    edges = candidates.where("edge").withColumn("off", F.col("number") - F.col("page"))
    by = edges.groupBy("paper_id", "off").agg(F.count("*").alias("c"), F.min(F.struct("page", "n")).alias("first"))
    top = by.withColumn("r", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("c"), "first"))).where("r = 1 and c >= 3").select("paper_id", "off")
    series = edges.join(top, ["paper_id", "off"], "left_semi").select(*PAGE, "n")
    others = candidates.join(series, [*PAGE, "n"], "left_anti").select(*PAGE).distinct().withColumn("other", F.lit(1))
    shared = series.select(*PAGE).distinct().join(others, PAGE, "left").groupBy("paper_id").agg((F.sum(F.coalesce("other", F.lit(0))) >= 0.5 * F.count("*")).alias("drop"))
    gone = series.join(shared.where("drop").select("paper_id"), "paper_id", "left_semi")
    return candidates.join(gone, [*PAGE, "n"], "left_anti").select(candidates.columns)


def question_anchors(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, number, page, box): the numbers 1, 2, 3, ... of a paper's questions.

    Candidates are dealt into columns of 8 points and their neighbours; in each the run 1, 2, 3, ... is
    taken greedily in reading order; the longest run wins, then the bolder, then the left one."""
    c = without_page_numbers(number_candidates(lines, pages)).withColumn("col", F.bround(F.col("x0") / 8).cast("int"))
    columns = c.select("paper_id", "col").distinct()
    dealt = c.withColumn("col", F.explode(F.array(F.col("col") - 1, F.col("col"), F.col("col") + 1))).join(columns, ["paper_id", "col"], "left_semi")
    held = F.array_sort(F.collect_list(F.struct("page", "y0", "n", "number", "x0", "x1", "y1", F.col("bold").cast("int").alias("bold"))))
    by = dealt.groupBy("paper_id", "col").agg(held.alias("a"))
    none = F.filter("a", lambda x: F.lit(False))
    start = F.struct(F.lit(0).alias("len"), F.lit(0).alias("bold"), none.alias("run"))

    def take(acc: Column, x: Column) -> Column:
        more = F.struct((acc["len"] + 1).alias("len"), (acc["bold"] + x["bold"]).alias("bold"), F.concat(acc["run"], F.array(x)).alias("run"))
        return F.when(x["number"] == acc["len"] + 1, more).otherwise(acc)

    runs = by.select("paper_id", "col", F.aggregate("a", start, take).alias("r")).where("r.len > 0")
    best = runs.groupBy("paper_id").agg(F.max_by("r.run", F.struct("r.len", "r.bold", -F.col("col"))).alias("run"))
    return best.select("paper_id", F.explode("run").alias("a")).select("paper_id", "a.number", "a.page", "a.x0", "a.y0", "a.x1", "a.y1")


def label_candidates(glyphs: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """(keys, line, k, label, last, strong, ...): letters A to J written A, (A), A. or A) that stand apart.

    glyphs(keys, line, k, ch, math_font, bold, ocr, x0, x1): k counts the glyphs of a line from the left.
    strong says whether the space after the label tells it from a word."""
    w = Window.partitionBy(*keys, "line").orderBy("k")
    held = F.struct("ch", "x0", "x1", "math_font")
    at = lambda n: F.lead(held, n).over(w)
    rows = glyphs.withColumns({"before": F.lag("x1").over(w), "g0": held, "g1": at(1), "g2": at(2), "g3": at(3), "_s": size})
    s = F.col("_s")
    is_ = lambda c, chars: F.coalesce(F.col(f"{c}.ch").isin(list(chars)) & ~F.col(f"{c}.math_font"), F.lit(False))
    paren = is_("g0", "(")
    close = F.when(paren, is_("g2", ")")).otherwise(is_("g1", ").") )
    letter = F.when(paren, F.when(is_("g1", LABELS), F.col("g1"))).when(is_("g0", LABELS), F.col("g0"))
    shut = F.when(close, F.when(paren, F.col("g2")).otherwise(F.col("g1")))
    end = F.coalesce(shut, letter)
    nxt = F.when(paren, F.col("g3")).when(close, F.col("g2")).otherwise(F.col("g1"))
    rows = rows.withColumns({"label": letter["ch"], "close": close, "gap": F.coalesce(nxt["x0"] - end["x1"], 99 * s), "lead": F.coalesce(F.col("x0") - F.col("before"), 99 * s), "tight": ~F.coalesce(shut["x0"] - letter["x1"] > 0.3 * s, F.lit(False)), "last": F.col("k") + F.when(paren, 2).when(close, 1).otherwise(0)})
    free = F.col("lead") >= F.when(F.col("close") | (F.col("gap") < 0.45 * s), 0.5 * s).otherwise(s)
    whole = F.col("label").isNotNull() & (F.col("close") | ~paren) & F.col("tight") & free
    after = F.when(F.col("close"), F.col("gap") >= 0.1 * s).otherwise(F.col("gap") >= 0.12 * s)
    strong = F.col("close") | (F.col("gap") >= 0.45 * s)
    return rows.where(whole & after).select(*keys, "line", "k", "label", "last", strong.alias("strong"))


def label_chain(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The run A, B, C, ... that marks the options: the longest, of equally long ones the latest; labels
    that are not all strong need three."""
    held = F.array_sort(F.collect_list(F.struct("line", "k", "label", "last", "strong")))
    by = candidates.groupBy(*keys).agg(held.alias("_c"))
    wanted = lambda run: F.char(F.lit(65) + F.size(run))
    add = lambda run, x: F.when((F.size(run) < len(LABELS)) & (x["label"] == wanted(run)), F.concat(run, F.array(x))).otherwise(run)

    def run_from(i: Column) -> Column:
        run = F.aggregate(F.slice("_c", i + 1, F.size("_c")), F.filter("_c", lambda x: F.lit(False)), add)
        return F.when(F.forall(run, lambda r: r["strong"]) | (F.size(run) >= 3), run).otherwise(F.filter(F.slice(run, 1, 1), lambda r: r["strong"]))

    starts = F.filter(F.transform("_c", lambda x, i: F.when(x["label"] == "A", i)), lambda i: i.isNotNull())
    runs = F.array_sort(F.transform(starts, lambda i: F.struct(F.size(run_from(i)).alias("n"), i.alias("i"), run_from(i).alias("run"))))
    best = F.get(runs, F.size(runs) - 1)["run"]
    return by.select(*keys, F.explode(best).alias("_r")).select(*keys, "_r.*")


def split_options(glyphs: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """glyphs with their segment: null for the stem, else the label of the option; labels' own glyphs go.

    Labels come from the chain. After A, the next letter also counts if it begins a line in A's column
    (0.3 sizes) and looks like it, jammed against its text or not."""
    chain = label_chain(label_candidates(glyphs, keys, size), keys).select(*keys, "line", "k", F.col("label").alias("hit"), "last")
    first = (F.col("k") == F.min("k").over(Window.partitionBy(*keys, "line"))) & F.col("ch").isin(list(LABELS)) & ~F.col("math_font")
    events = glyphs.withColumns({"first": first, "_s": size}).join(chain, [*keys, "line", "k"], "left").where("hit is not null or first")
    one = F.struct("line", "k", "hit", "last", "ch", "x0", "bold", "ocr", "first", "_s")
    by = events.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_e"))
    taken = F.expr("cast(array() as array<struct<line:int,k:int,label:string,last:int>>)")
    start = F.struct(taken.alias("out"), F.lit(None).cast("double").alias("col"), F.lit(False).alias("bold"))

    def step(a: Column, x: Column) -> Column:
        want = F.char(F.lit(65) + F.size(a["out"]))
        beside = x["first"] & (x["ch"] == want) & F.coalesce(F.abs(x["x0"] - a["col"]) < 0.3 * x["_s"], F.lit(False)) & (x["ocr"] | (x["bold"] == a["bold"]))
        accept = (F.size(a["out"]) < len(LABELS)) & (F.coalesce(x["hit"] == want, F.lit(False)) | beside)
        is_a = F.size(a["out"]) == 0
        row = F.struct(x["line"].cast("int").alias("line"), x["k"].cast("int").alias("k"), want.alias("label"), F.coalesce(F.when(x["hit"] == want, x["last"]), x["k"]).cast("int").alias("last"))
        after = F.struct(F.concat(a["out"], F.array(row)).alias("out"), F.when(is_a, x["x0"]).otherwise(a["col"]).alias("col"), F.when(is_a, x["bold"]).otherwise(a["bold"]).alias("bold"))
        return F.when(accept, after).otherwise(a)

    labels = by.select(*keys, F.explode(F.aggregate("_e", start, step, lambda a: a["out"])).alias("_l")).select(*keys, F.col("_l.line").alias("line"), F.col("_l.k").alias("k"), F.col("_l.label").alias("label"), F.col("_l.last").alias("last"))
    w = Window.partitionBy(*keys).orderBy("line", "k").rowsBetween(Window.unboundedPreceding, 0)
    rows = glyphs.join(labels, [*keys, "line", "k"], "left").withColumn("_own", F.last(F.when(F.col("label").isNotNull(), F.struct("line", "last", "label")), True).over(w))
    inside = F.coalesce((F.col("_own.line") == F.col("line")) & (F.col("k") <= F.col("_own.last")), F.lit(False))
    return rows.withColumn("segment", F.col("_own.label")).where(~inside).select(*glyphs.columns, "segment")


def cut_last_option(lines: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """lines(keys, segment, line, page, y0, y1) without what follows, in the last option, a gap of over
    2.5 sizes or a change of page."""
    last = F.col("segment").eqNullSafe(F.max("segment").over(Window.partitionBy(*keys))) & F.col("segment").isNotNull()
    w = Window.partitionBy(*keys, "segment").orderBy("line")
    cut = last & ((F.col("page") != F.lag("page").over(w)) | (F.col("y0") - F.lag("y1").over(w) > 2.5 * size))
    rows = lines.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    return rows.withColumn("_cut", F.max("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_cut")


def label_rows(blobs: DataFrame, letters: DataFrame, keys: list[str], size: float) -> DataFrame:
    """(keys, pos, label, page, box): labels in a picture by their ink, even where OCR misreads them.

    The label column is where most letters(keys, x0) are, within 3 points, two at least. A label is a
    blob(keys, page, box) of a letter's size in that column with free space after it; the first ten in
    reading order are A to J."""
    col = densest(letters.select(*keys, F.bround("x0").cast("long").alias("x0")), keys, "x0", 2).select(*keys, F.col("densest").cast("double").alias("col"))
    rows = blobs.join(col, keys)
    w, h = g.width(g.box()), g.height(g.box())
    marks = rows.where((F.abs(F.col("x0") - F.col("col")) < 0.35 * size) & h.between(0.4 * size, 1.4 * size) & w.between(0.3 * size, 1.3 * size))
    o = blobs.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "page", *g.SIDES)])
    beside = (F.col("_x0") < F.col("x1") + 0.45 * size) & (F.col("_x1") > F.col("x1")) & (F.least("y1", "_y1") - F.greatest("y0", "_y0") > 0.3 * h)
    same = F.forall(F.array(*[F.col(s) == F.col(f"_{s}") for s in g.SIDES]), lambda x: x)
    free = marks.join(o, [F.col(c) == F.col(f"_{c}") for c in (*keys, "page")] + [beside & ~same], "left_anti")
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("page", "y0", "x0"))
    return free.withColumn("pos", pos).where(F.col("pos") <= len(LABELS)).select(*keys, "pos", F.char(F.lit(64) + F.col("pos")).alias("label"), "page", *g.SIDES)


def owners(items: DataFrame, rows: DataFrame, keys: list[str], size: float) -> DataFrame:
    """items(keys, page, y) with the label of the last row that begins at or above them (as-of): one
    sorted pass over both, no join."""
    both = items.select("*", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("owner")).unionByName(
        rows.select(*keys, "page", (F.col("y0") - 0.35 * size).alias("y"), F.lit(0).alias("_kind"), F.col("label").alias("owner")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy("page", "y", "_kind", "owner").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("owner", F.last("owner", True).over(w)).where("_kind = 1").drop("_kind")
