"""A paper's title, name, year, duration and number of questions, from its first pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import text as tx

# What a paper has that states nothing.
DEFAULT_MINUTES, DEFAULT_PAPER, DEFAULT_YEAR = 75, "Paper 1", "Unknown"
_TIMING = r"(?i)^[0-9\s]*(?:hours?|hrs?|minutes?|mins?)\b|^(?:time allowed|instructions|please read)\b"


def titles(lines: DataFrame) -> DataFrame:
    """(paper_id, title): of the first page's lines(paper_id, page, n, text, size) the first three that are
    at least 80 % of the biggest, down to where the timing or the instructions begin."""
    rows = lines.where((F.col("page") == 1) & (F.length("text") > 1))
    order = Window.partitionBy("paper_id").orderBy("n")
    rows = rows.withColumn("biggest", F.max("size").over(Window.partitionBy("paper_id")))
    stop = F.max(F.trim("text").rlike(_TIMING).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    big = rows.withColumn("stop", stop).where((F.col("stop") == 0) & (F.col("size") >= 0.8 * F.col("biggest")))
    top = F.slice(F.array_sort(F.collect_list(F.struct("n", F.trim("text").alias("t")))), 1, 3)
    return big.groupBy("paper_id").agg(F.trim(F.regexp_replace(F.array_join(F.transform(top, lambda r: r["t"]), " "), r"\s+", " ")).alias("title"))


def _first(pattern: str, *places: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")) for p in places])


def read_metadata(papers: DataFrame, lines: DataFrame) -> DataFrame:
    """(paper_id, title, paper, year, minutes, questions), null where the print does not say.

    papers(paper_id, file, first, ocr): the file's name, the text of the first two pages, and whether
    the cover is a picture. The file's name stands in for a title that is missing, too long, or a picture
    with fewer than two words."""
    name = F.regexp_replace(F.element_at(F.split("file", r"[\\/]"), -1), r"\.[^.]*\z", "")
    stem = F.regexp_replace(F.regexp_replace(name, r"^[0-9]{2}_", ""), "[_-]", " ")
    rows = papers.join(titles(lines), "paper_id", "left").withColumns({"stem": stem, "first": F.coalesce("first", F.lit(""))})
    poor = F.col("ocr") & (F.regexp_count("title", F.lit("[A-Za-z]{3,}")) < 2)
    title = F.when(F.col("title").isNull() | (F.col("title") == "") | (F.length("title") > 120) | poor, F.col("stem")).otherwise(F.col("title"))
    both = F.concat_ws(" ", "first", "stem")
    paper = F.concat(F.lit("Paper "), _first(r"(?i)\bPaper\s*([0-9]+|[IVX]+)\b", both))
    year = F.coalesce(_first(r"\b(19[89][0-9]|20[0-9]{2})\b", F.col("first"), F.col("stem")), _first(r"(?i)\b((?:Set|Mock|Practice)\s*[0-9]+|Specimen)\b", both))
    return rows.select("paper_id", title.alias("title"), paper.alias("paper"), year.alias("year"), tx.parse_duration(F.col("first")).alias("minutes"), tx.parse_question_count(F.col("first")).alias("questions"))


def final_metadata(meta: DataFrame, title: str | None = None, paper: str | None = None, year: str | None = None, minutes: int | None = None) -> DataFrame:
    """meta with what the caller says first, what was read next and the defaults last; notes tells which
    defaults stand. id and file_name come from title and paper."""
    said = lambda value, column: F.coalesce(F.lit(value or None), F.nullif(F.col(column), F.lit("")))
    length = F.coalesce(F.lit(minutes or None), F.when(F.col("minutes") > 0, F.col("minutes")))
    note = lambda when, what: F.when(when, F.lit(what))
    name = said(paper, "paper")
    notes = F.filter(F.array(note(length.isNull(), "no time is stated: minutes are a default"), note(name.isNull(), "the paper is not named: its name is a default")), lambda n: n.isNotNull())
    rows = meta.select(
        "paper_id", said(title, "title").alias("title"), F.coalesce(name, F.lit(DEFAULT_PAPER)).alias("paper"), F.coalesce(said(year, "year"), F.lit(DEFAULT_YEAR)).alias("year"),
        F.coalesce(length, F.lit(DEFAULT_MINUTES)).cast("int").alias("durationMinutes"), "questions", notes.alias("notes"),
    )
    plain = tx.nfkd_ascii(F.coalesce("title", F.lit("")))
    return rows.withColumns({"id": tx.paper_id(plain, F.col("paper")), "file_name": tx.paper_filename(plain, F.col("paper"))})


def plain_questions(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stem, options) of questions as plain text, where the layout cannot be read: lines(keys, n,
    text) that begin with the next letter A, B, C, ... begin an option, others go on what is open."""
    held = F.array_sort(F.collect_list(F.struct("n", "text")))
    none = F.expr("cast(array() as array<struct<label:string,content:string>>)")
    start = F.struct(F.lit("").alias("stem"), none.alias("options"))
    glue = lambda a, b: F.trim(F.concat(a, F.lit(" "), b))

    def step(a: Column, row: Column) -> Column:
        text, n = F.trim(row["text"]), F.size(a["options"])
        label = F.regexp_extract(text, r"^\(?([A-J])(?:[).]|\s|\z)", 1)
        rest = F.trim(F.regexp_replace(text, r"^\(?[A-J][).]*", ""))
        new = F.struct(label.alias("label"), rest.alias("content"))
        last = F.get(a["options"], n - 1)
        longer = F.concat(F.slice(a["options"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.struct(last["label"].alias("label"), glue(last["content"], text).alias("content"))))
        begun = F.struct(a["stem"].alias("stem"), F.concat(a["options"], F.array(new)).alias("options"))
        in_stem = F.struct(glue(a["stem"], text).alias("stem"), a["options"].alias("options"))
        return F.when((label != "") & (label == F.char(F.lit(65) + n)), begun).when(n == 0, in_stem).otherwise(F.struct(a["stem"].alias("stem"), longer.alias("options")))

    return lines.groupBy(*keys).agg(F.aggregate(held, start, step).alias("_q")).select(*keys, "_q.stem", "_q.options")
