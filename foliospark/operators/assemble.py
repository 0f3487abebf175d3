"""Papers from questions: flags, combining, names, cross-checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.functions import text as tx
from foliospark.operators.layout import bag_difference


def visible_characters(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, ch): the letters and digits that a reader sees, LaTeX commands taken away."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), r"\\(?:begin|end)\{[^{}]*\}", " "), r"\\[A-Za-z]+", " "), r"[\s$]", "")
    return rows.select(*keys, F.explode(F.split(F.lower(tx.nfkc(bare)), "")).alias("ch")).where(F.col("ch").rlike(r"^[\p{L}\p{N}]\z"))


def cross_check(printed: DataFrame, rebuilt: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, missing, extra): how many characters of the print the output lacks, and has too many."""
    diff = bag_difference(visible_characters(printed, keys, text), visible_characters(rebuilt, keys, text), keys, "ch")
    return diff.groupBy(*keys).agg(F.sum("missing").alias("missing"), F.sum("extra").alias("extra"))


def flag(questions: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """questions with needs_review and review_reasons, each reason once, in order of issue."""
    first = issues.where("level = 'error'").groupBy(*keys, "code").agg(F.min("ord").alias("o"))
    reasons = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "code"))), lambda x: x["code"]).alias("review_reasons"))
    return questions.join(reasons, keys, "left").withColumn("review_reasons", F.coalesce("review_reasons", F.expr("cast(array() as array<string>)"))).withColumn("needs_review", F.size("review_reasons") > 0)


def combine(questions: DataFrame, papers: DataFrame, title: str) -> tuple[DataFrame, DataFrame]:
    """(paper, questions): all papers as one, in order of papers.pos, questions numbered through, minutes
    added up. ValueError if there is none."""
    if papers.isEmpty():
        raise ValueError("there is no paper to combine")
    order = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "year", "paper").alias("name"))))
    head = papers.agg(F.sum("durationMinutes").alias("durationMinutes"), F.array_join(F.transform(order, lambda x: x["name"]), " + ").alias("year"))
    head = head.select(F.lit(title).alias("title"), tx.paper_id(F.lit(title), F.lit(None).cast("string")).alias("id"), "year", "durationMinutes")
    counts = questions.groupBy("paper_id").agg(F.count("*").alias("n")).join(papers.select("paper_id", "pos"), "paper_id")
    held = F.array_sort(F.collect_list(F.struct("pos", "paper_id", "n")))  # one row per paper of one collection
    ahead = F.transform("c", lambda x, i: F.struct(x["paper_id"].alias("paper_id"), F.aggregate(F.slice("c", F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("ahead")))
    offsets = counts.agg(held.alias("c")).select(F.inline(ahead))
    own = F.row_number().over(Window.partitionBy("paper_id").orderBy("number"))
    numbered = questions.withColumn("number", own).join(offsets, "paper_id").withColumn("number", (F.col("number") + F.col("ahead")).cast("int"))
    return head, numbered.select(questions.columns)


def unique_names(names: DataFrame, name: str, order: str) -> DataFrame:
    """names with file_name: in order, a name that is used already gets the first of _2, _3, ... that is
    not used so far.

    Names can only clash with names of the same stem, numbers at the end taken away. Where a stem has one
    name, its copies are numbered by a window, which spills; only stems that have names like a, a_2 and
    copies of them are folded in memory, names and orders alone, a stem at a time. A null name stays.
    """
    stem = F.regexp_replace(F.col(name), r"(?:_[0-9]+)+\z", "")
    rows = names.select("*", stem.alias("_stem"))
    kinds = rows.groupBy("_stem").agg((F.min(name) != F.max(name)).alias("_mixed"))
    rows = rows.join(kinds.where("_mixed"), "_stem", "left")
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    plain = rows.where("_mixed is null").withColumn("file_name", F.when((n == 1) | F.col(name).isNull(), F.col(name)).otherwise(F.concat(name, F.lit("_"), n.cast("string"))))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        used: set[str] = set()
        upto: dict[str, int] = {}
        found = []
        for base in group[name]:
            got, k = base, upto.get(base, 2)
            while got in used:
                got, k = f"{base}_{k}", k + 1
            upto[base] = k
            used.add(got)
            found.append(got)
        return group.assign(file_name=found)

    kind = T.StructType([*names.schema.fields, T.StructField("_stem", T.StringType()), T.StructField("file_name", T.StringType())])
    mixed = rows.where("_mixed").select(*names.columns, "_stem").groupBy("_stem").applyInPandas(fold, kind)
    return plain.select(*names.columns, "file_name").unionByName(mixed.drop("_stem"))


def group_inputs(files: DataFrame, path: str = "path", pos: str = "pos") -> DataFrame:
    """(input, paths): one row per input paper; all pictures are one, at the place of the first."""
    picture = F.lower(F.col(path)).rlike(r"\.(png|jpe?g|gif|bmp|webp|tiff?)\z")
    by = files.withColumn("_k", F.when(picture, "pictures").otherwise(F.concat(F.lit("file:"), path)))
    rows = by.groupBy("_k").agg(F.min(pos).alias("input"), F.transform(F.array_sort(F.collect_list(F.struct(pos, path))), lambda x: x[path]).alias("paths"))
    return rows.select("input", "paths")
