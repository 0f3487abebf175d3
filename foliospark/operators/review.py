"""The review of converted papers: what is shown, what is filtered, what may be saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import latex
from foliospark.operators import validate

#: Issues of a paper's form: a paper that has one is not saved.
FORM = [
    "root", "missing-keys", "extra-keys", "answer-leak", "format-version", "type", "duration", "questions", "question-type", "question-keys", "numbering", "options", "option-type",
    "option-keys", "option-label", "images", "image-type", "image-keys", "image-src", "source-page", "needs-review",
]


def paragraphs(text: Column) -> Column:
    """An array of the parts of a text between blank lines, of which those in display maths do not count."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(?:\$\$.*?(?:\$\$|\z)|(?!\n[^\S\n]*(?:\n|\z)).)++"), F.lit(0))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^(?:[^\S\n]*\n)+", "")), lambda p: p.rlike(r"\S"))


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def rich_text(text: Column) -> Column:
    """A text as HTML paragraphs, its maths as it is, for the renderer."""
    return F.array_join(F.transform(paragraphs(text), lambda p: F.concat(F.lit("<p>"), F.replace(escaped(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "")


def leftover(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, near): rows whose text has a dollar sign or a command that no delimiters make maths of, with the
    place of the first one."""
    held = rows.select(*keys, latex.math_parts(F.col(text)).alias("_m"))
    plain = F.filter("_m.segments", lambda s: (s["kind"] == "text") & s["text"].rlike(r"\$|\\[A-Za-z]+"))
    first = F.get(plain, F.lit(0))["text"]
    near = F.regexp_extract(first, r"(?s)(.{0,10}(?:\$|\\[A-Za-z]).{0,29})", 1)
    return held.where(F.size(plain) > 0).select(*keys, near.alias("near"))


def to_review(questions: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """questions(keys, needs_review) that are flagged or have an error or a warning."""
    found = issues.where("level <> 'info'").select(*keys).distinct().withColumn("_found", F.lit(True))
    return questions.join(found, keys, "left").where(F.coalesce("needs_review", F.lit(False)) | F.col("_found")).drop("_found")


def counts(questions: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, questions, flagged, with_images): numbers per paper, with_images as the questions' own in order."""
    pictured = F.array_sort(F.collect_list(F.when(F.size("images") > 0, F.col("number"))))
    return questions.groupBy(key).agg(F.count("*").alias("questions"), F.count_if("needs_review").alias("flagged"), pictured.alias("with_images"))


def gate(papers: DataFrame, key: str = "paper_id", text: str = "json") -> tuple[DataFrame, DataFrame]:
    """(papers that may be saved, (key, reasons) of those that may not): edited papers must have the form of a
    paper; other issues do not keep them."""
    bad = validate.paper_issues(papers, key, text).where((F.col("level") == "error") & F.col("code").isin(FORM))
    reasons = bad.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "code"))), lambda x: x["code"]).alias("reasons"))
    return papers.join(reasons, key, "left_anti"), reasons
