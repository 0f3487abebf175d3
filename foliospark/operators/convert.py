"""Papers from the tables of the page layer: numbers, regions, figures, options, text, checks, JSON, report.

All papers go through every step together; a step is a join or a window by paper and question, so that
nothing waits for a single paper, and what fails for one question or paper is a row of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import geometry as g
from foliospark.functions import text as tx
from foliospark.operators import anchors, assemble, figures, layout, mathbuild, metadata, pagelayer, validate
from foliospark.operators.anchors import LABELS
from foliospark.operators.pagelayer import PAGE
from foliospark.session import cut
from foliospark.sources import papers as src

QUESTION = ["paper_id", "number"]
#: Glyphs are on one line if their base lines are so near, as a share of the body size.
LINE_STEP = mathbuild.LINE_STEP


@dataclass
class Layer:
    """What the page layer knows of all papers.

    papers(paper_id, file, ocr), pages(paper_id, page, width, height, png, dark), lines as
    pagelayer.lines_of_spans makes them, glyphs as pagelayer.glyphs_of makes them, bars(paper_id, page, x0,
    x1, y), graphics and images(paper_id, page, box)."""

    papers: DataFrame
    pages: DataFrame
    lines: DataFrame
    glyphs: DataFrame
    bars: DataFrame
    graphics: DataFrame
    images: DataFrame


@dataclass
class Converted:
    """questions(paper_id, number, stem, options, images, source_page, needs_review, review_reasons),
    papers(paper_id, file_name, json), issues as validate.paper_issues, reports(paper_id, file_name, json),
    failures(paper_id, error)."""

    questions: DataFrame
    papers: DataFrame
    issues: DataFrame
    reports: DataFrame
    failures: DataFrame


def _centre(axis: str) -> Column:
    return (F.col(f"{axis}0") + F.col(f"{axis}1")) / 2


def _in_regions(rows: DataFrame, regions: DataFrame, y: Column) -> DataFrame:
    """rows with the number of the question in whose region on their page y is."""
    r = regions.select(*[F.col(c).alias(f"_{c}") for c in PAGE], "number", "top", "bottom")
    on = [F.col(c) == F.col(f"_{c}") for c in PAGE] + [(y >= F.col("top")) & (y < F.col("bottom"))]
    return rows.join(r, on).select(*rows.columns, "number")


def question_marks(content: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, number, page, box, printed): printed numbers; of papers without any, pages as questions,
    from the top of the page."""
    printed = anchors.question_anchors(content, pages).withColumn("printed", F.lit(True))
    rest = content.join(printed.select("paper_id").distinct(), "paper_id", "left_anti")
    whole = layout.page_anchors(rest.select(*PAGE, "text"))
    return printed.unionByName(whole.select("paper_id", "number", "page", *[F.lit(0.0).alias(s) for s in g.SIDES], F.lit(False).alias("printed")))


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """glyphs with body (their question's size), line and k: lines by base in reading order, smaller glyphs
    on the nearest line, glyphs of a line from the left."""
    body = pagelayer.body_size(glyphs, QUESTION).withColumnRenamed("size", "body")
    rows = glyphs.join(body, QUESTION).withColumn("_full", F.col("size") >= mathbuild.SCRIPT_SIZE * F.col("body"))
    order = Window.partitionBy(*QUESTION).orderBy("page", "base", "x0", "gid")
    full = rows.where("_full")
    step = (F.col("page") != F.lag("page").over(order)) | (F.col("base") - F.lag("base").over(order) > LINE_STEP * F.col("body"))
    full = full.withColumn("line", F.sum(F.coalesce(step, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = full.select(*QUESTION, "page", "base", "line").distinct()
    small = layout.nearest(rows.where("not _full"), at, [*QUESTION, "page"], "base", "line").withColumn("line", F.coalesce("line", F.lit(0)))
    k = F.row_number().over(Window.partitionBy(*QUESTION, "line").orderBy("x0", "gid")) - 1
    return full.unionByName(small.select(full.columns)).drop("_full").withColumn("k", k.cast("int"))


def drop_own_number(glyphs: DataFrame) -> DataFrame:
    """Lined glyphs without the question's own number where it is printed again at the start of the stem: the
    glyphs side by side that the first line begins with, if they are that number, alone or after Q."""
    stem = F.col("segment").isNull()
    first = (F.col("line") == F.min(F.when(stem, F.col("line"))).over(Window.partitionBy(*QUESTION))) & stem
    order = Window.partitionBy(*QUESTION, "line", "segment").orderBy("k")
    apart = F.coalesce(F.col("x0") - F.lag("x1").over(order) >= 0.4 * F.col("body"), F.lit(False)).cast("int")
    rows = glyphs.withColumns({"_first": first, "_apart": apart}).withColumn("_run", F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lead = rows.where("_first and _run = 0").groupBy(*QUESTION).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "ch"))), lambda x: x["ch"]), "").alias("_said"))
    again = lead.where(F.col("_said").rlike(r"^(?:Q|Question)?[0-9]+[.):]?\z") & (F.regexp_extract("_said", "([0-9]+)", 1).cast("int") == F.col("number"))).select(*QUESTION, F.lit(True).alias("_again"))
    rows = rows.join(again, QUESTION, "left").where(~(F.coalesce("_again", F.lit(False)) & F.col("_first") & (F.col("_run") == 0)))
    return rows.select(glyphs.columns)


def without_tail(glyphs: DataFrame) -> DataFrame:
    """Lined glyphs but for what follows the last option after a wide gap or on another page."""
    by = glyphs.groupBy(*QUESTION, "segment", "line").agg(F.min("page").alias("page"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.max("body").alias("body"))
    kept = anchors.cut_last_option(by, QUESTION, F.col("body")).select(*[F.col(c).alias(f"_{c}") for c in (*QUESTION, "segment", "line")])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*QUESTION, "segment", "line")]
    return glyphs.join(kept, same, "left_semi")


def texts(glyphs: DataFrame, bars: DataFrame) -> DataFrame:
    """(paper_id, number, segment, text, problems, error) of lined glyphs with their segment. A bar belongs to
    the segment of the nearest glyph over or under it."""
    near = bars.select(*QUESTION, F.col("page").alias("_page"), F.monotonically_increasing_id().alias("rid"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), "y")
    pairs = near.join(glyphs.select(*QUESTION, "page", "x0", "x1", "base", "body", "segment"), QUESTION).where((F.col("page") == F.col("_page")) & (F.col("x0") < F.col("bx1") + 1) & (F.col("x1") > F.col("bx0") - 1) & (F.abs(F.col("base") - F.col("y")) < 3 * F.col("body")))
    owned = pairs.groupBy(*QUESTION, "_page", "rid", "bx0", "bx1", "y").agg(F.min_by(F.coalesce("segment", F.lit("")), F.struct(F.abs(F.col("base") - F.col("y")), "x0")).alias("segment"))
    question = F.concat_ws(":", F.col("number").cast("string"), F.coalesce("segment", F.lit("")))
    rules = owned.select("paper_id", question.alias("question"), "rid", F.col("bx0").alias("x0"), F.col("bx1").alias("x1"), "y", F.col("_page").alias("page"))
    built = mathbuild.rebuild(glyphs.withColumn("question", question), rules)
    part = F.split("question", ":")
    return built.select("paper_id", part[0].cast("int").alias("number"), F.nullif(part[1], F.lit("")).alias("segment"), "text", "problems", "error")


def figure_options(labels: DataFrame) -> DataFrame:
    """(paper_id, number, options) from labels(paper_id, number, page, y0, x0, ch) inside figures: the letters
    A, B, C, ... in reading order, two at least, each standing for its graph."""
    held = F.array_sort(F.collect_list(F.struct("page", (F.bround(F.col("y0") / 4)).alias("row"), "x0", "ch")))
    run = F.aggregate(F.transform(held, lambda x: x["ch"]), F.lit(0), lambda n, ch: F.when(ch == F.char(F.lit(65) + n), n + 1).otherwise(n))
    rows = labels.groupBy(*QUESTION).agg(F.least(run, F.lit(len(LABELS))).alias("n")).where("n >= 2")
    options = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.char(F.lit(65) + i).alias("label"), F.concat(F.lit("Graph "), F.char(F.lit(65) + i)).alias("content")))
    return rows.select(*QUESTION, options.alias("graphs"))


def questions_of(layer: Layer) -> DataFrame:
    """(paper_id, number, stem, options, images, source_page, reasons, regions): every question of every paper."""
    content = cut(pagelayer.content(layer.lines, layer.pages))
    blank = pagelayer.blank_pages(content, layer.graphics, layer.pages)
    box = pagelayer.content_boxes(content, layer.graphics).select(*PAGE, F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    pages = layer.pages.select(*PAGE, "width", "height").join(blank, PAGE).join(box, PAGE, "left")
    marks = cut(question_marks(content, layer.pages))
    regions = cut(layout.question_regions(marks, pages, "paper_id", layer.images))

    in_text = _in_regions(layer.glyphs, regions, _centre("y"))
    number_box = marks.where("printed").select(*QUESTION, *[F.col(c).alias(f"_{c}") for c in ("page", *g.SIDES)])
    of_number = [F.col(c) == F.col(f"__{c}") for c in QUESTION] + [(F.col("page") == F.col("_page")) & g.contains_point(g.box("_"), _centre("x"), _centre("y"))]
    in_text = in_text.join(number_box.withColumnsRenamed({c: f"__{c}" for c in QUESTION}), of_number, "left_anti")
    in_text = cut(in_text)
    bars = _in_regions(layer.bars, regions, F.col("y"))

    drawn = _in_regions(layer.graphics.unionByName(layer.images), regions, _centre("y"))
    rough = layout.merge_boxes(drawn.select("paper_id", "page", "number", *g.SIDES), ["paper_id", "page", "number"], 12.0)
    crops = cut(figures.crops(cut(rough), layer.pages, layer.graphics, content)).where("crop.png is not null")
    crop_box = crops.select(*[F.col(c).alias(f"_{c}") for c in ("paper_id", "page", "number")], *[F.col(f"crop.{s}").alias(f"_{s}") for s in g.SIDES])
    inside = [F.col(c) == F.col(f"_{c}") for c in ("paper_id", "page", "number")]
    in_crop = inside + [g.contains_point(g.box("_"), _centre("x"), _centre("y"))]
    labels = in_text.where(F.col("ch").isin(list(LABELS)) & (F.col("bold") | F.col("ocr")) & ~F.col("math_font")).join(crop_box, in_crop, "left_semi")
    in_text = cut(in_text.join(crop_box, in_crop, "left_anti"))
    bars = bars.join(crop_box, inside + [g.contains_point(g.expand(g.box("_"), 1.0), _centre("x"), F.col("y"))], "left_anti")

    lined = cut(glyph_lines(in_text))
    split = cut(anchors.split_options(lined, QUESTION, F.col("body")))
    split = cut(drop_own_number(without_tail(split)))
    built = cut(texts(split, bars))
    said = F.coalesce("text", F.lit(""))
    options = built.where("segment is not null").groupBy(*QUESTION).agg(F.array_sort(F.collect_list(F.struct(F.col("segment").alias("label"), tx.numeric_as_maths(said).alias("content")))).alias("options"))
    stems = built.where("segment is null").select(*QUESTION, said.alias("stem"))
    trouble = built.select(*QUESTION, F.explode(F.concat("problems", F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("could not be rebuilt: "), F.col("error")))).otherwise(F.expr("cast(array() as array<string>)")))).alias("reason"))
    trouble = trouble.groupBy(*QUESTION).agg(F.array_sort(F.collect_set("reason")).alias("problems"))
    alt = F.concat(F.lit("Diagram for question "), F.col("number").cast("string"), F.lit(", cropped from page "), F.col("page").cast("string"), F.lit(" of the paper"))
    images = crops.groupBy(*QUESTION).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page", "crop.y0", "crop.x0", src.data_uri(F.col("crop.png")).alias("src"), alt.alias("alt")))), lambda x: F.struct(x["src"].alias("src"), x["alt"].alias("alt"))).alias("images"),
        F.max(F.size("crop.edges_cutting_ink") > 0).alias("cut"),
    )
    ocr = in_text.groupBy(*QUESTION).agg(F.max("ocr").alias("ocr"), F.count("*").alias("n_glyphs"))
    check = assemble.cross_check(split.where("known").select(*QUESTION, F.col("ch").alias("text")), built.select(*QUESTION, said.alias("text")), QUESTION)
    where = regions.groupBy(*QUESTION).agg(F.array_sort(F.collect_list(F.struct("page", "top", "bottom"))).alias("regions"))
    rows = marks.select(*QUESTION, F.col("page").alias("source_page"), "printed")
    for part in (where, stems, options, figure_options(labels), images, trouble, ocr, check):
        rows = rows.join(part, QUESTION, "left")
    none = F.expr(f"cast(array() as {src.OPTION})")
    rows = rows.withColumns({"stem": F.coalesce("stem", F.lit("")), "options": F.coalesce("options", none), "images": F.coalesce("images", F.expr(f"cast(array() as {src.IMAGE})"))})
    rows = rows.withColumn("options", F.when(F.size("options") >= 2, F.col("options")).otherwise(F.coalesce("graphs", "options")))
    flag = lambda when, what: F.when(when, what if isinstance(what, Column) else F.lit(what))
    empty = F.filter("options", lambda o: F.trim(o["content"]) == "")
    reasons = F.concat(
        F.array(
            flag(F.col("n_glyphs").isNull(), "no text found for this question"), flag(F.col("ocr"), "read from a picture: check the maths against it"), flag(F.col("cut"), "a figure may be cut off"),
            flag(F.size("options") < 2, "no answer options were found"), flag(F.trim("stem") == "", "the question text is empty"), flag(~F.col("printed"), "no numbers were found: this question is a whole page"),
            flag(F.coalesce("missing", F.lit(0)) > 0, F.concat(F.col("missing").cast("string"), F.lit(" printed characters are missing"))), flag(F.coalesce("extra", F.lit(0)) > 0, F.concat(F.col("extra").cast("string"), F.lit(" characters are not in the print"))),
        ),
        F.transform(empty, lambda o: F.concat(F.lit("option "), o["label"], F.lit(" is empty"))), F.coalesce("problems", F.expr("cast(array() as array<string>)")),
    )
    return rows.select(*QUESTION, "stem", "options", "images", "source_page", F.array_distinct(F.filter(reasons, lambda r: r.isNotNull())).alias("reasons"), "regions")


def paper_rows(questions: DataFrame, meta: DataFrame) -> DataFrame:
    """(paper_id, file_name, json) of questions(paper_id, number, stem, options, images, source_page, reasons)
    and final metadata; questions in order, numbered as they are."""
    one = F.struct(F.col("number").cast("int").alias("number"), "stem", "options", "images", F.col("source_page").cast("int").alias("sourcePage"), (F.size("reasons") > 0).alias("needsReview"))
    by = questions.groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("questions"))
    rows = by.join(meta.drop("questions"), "paper_id")
    names = assemble.unique_names(rows.select("paper_id", F.regexp_replace("file_name", r"\.json\z", "").alias("base")), "base", "paper_id").select("paper_id", F.concat("file_name", F.lit(".json")).alias("unique_name"))
    paper = F.struct(F.lit(1).alias("formatVersion"), "id", "title", "paper", "year", "durationMinutes", "questions")
    return rows.join(names, "paper_id").select("paper_id", F.col("unique_name").alias("file_name"), src.pretty_json(paper).alias("json"))


def convert(layer: Layer, title: str | None = None, paper: str | None = None, year: str | None = None, minutes: int | None = None) -> Converted:
    """All papers of a layer. Validation errors of a question become review reasons, and the paper is
    written again with them; a paper without text or questions is a failure and stops no other."""
    front = layer.lines.where("page <= 2").groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "n", "text"))), lambda x: x["text"]), "\n").alias("first"))
    read = metadata.read_metadata(layer.papers.join(front, "paper_id", "left"), layer.lines)
    meta = cut(metadata.final_metadata(read, title, paper, year, minutes))
    questions = cut(questions_of(layer))
    first = cut(validate.paper_issues(cut(paper_rows(questions, meta))))
    errors = first.where("level = 'error' and question is not null").groupBy("paper_id", F.col("question").alias("number")).agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", F.concat_ws(": ", F.lit("validation"), "code", "message").alias("m")))), lambda x: x["m"]).alias("found"))
    questions = questions.join(errors, QUESTION, "left").withColumn("reasons", F.array_distinct(F.concat("reasons", F.coalesce("found", F.expr("cast(array() as array<string>)"))))).drop("found")
    questions = cut(questions)
    papers = cut(paper_rows(questions, meta))
    issues = cut(validate.paper_issues(papers))
    done = papers.select("paper_id")
    has_text = layer.lines.select("paper_id").distinct().withColumn("_text", F.lit(True))
    failed = layer.papers.select("paper_id").join(done, "paper_id", "left_anti").join(has_text, "paper_id", "left")
    failures = failed.select("paper_id", F.when(F.col("_text"), "no questions were found").otherwise("no text could be read").alias("error"))
    return Converted(questions, papers, issues, reports(questions, papers, issues, meta), failures)


def reports(questions: DataFrame, papers: DataFrame, issues: DataFrame, meta: DataFrame) -> DataFrame:
    """(paper_id, file_name, json): beside each paper its counts, issues, notes, and what was found of each question."""
    counted = validate.summary(issues, ["paper_id"])
    listed = issues.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "level", "code", "message", "question", "field"))), lambda x: x.dropFields("ord")).alias("issues"))
    one = F.struct("number", F.col("source_page").alias("sourcePage"), (F.size("reasons") > 0).alias("needsReview"), F.col("reasons").alias("reviewReasons"), "regions")
    detail = questions.groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("questions"), F.count_if(F.size("reasons") > 0).alias("flagged"))
    rows = papers.select("paper_id", "file_name").join(detail, "paper_id").join(counted, "paper_id", "left").join(listed, "paper_id", "left").join(meta.select("paper_id", "notes", F.col("questions").alias("stated")), "paper_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    mismatch = F.when(F.col("stated") != F.size("questions"), F.concat(F.lit("the paper says "), F.col("stated").cast("string"), F.lit(" questions, found were "), F.size("questions").cast("string")))
    notes = F.filter(F.concat(F.coalesce("notes", F.expr("cast(array() as array<string>)")), F.array(mismatch)), lambda n: n.isNotNull())
    body = F.struct(F.col("file_name").alias("paper"), F.size("questions").alias("questionCount"), "flagged", zero("errors"), zero("warnings"), F.coalesce("ok", F.lit(True)).alias("ok"), notes.alias("notes"), "issues", F.col("questions").alias("detail"))
    return rows.select("paper_id", F.regexp_replace("file_name", r"\.json\z", ".report.json").alias("file_name"), src.pretty_json(body).alias("json"))
