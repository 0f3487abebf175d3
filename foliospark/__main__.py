"""``python -m foliospark validate PATH``: issues of JSON papers, one line each; exit code 1 on errors.

``python -m foliospark convert LAYER OUT``: papers from the tables of the page layer (LAYER/papers.parquet
and so on, see operators.convert.Layer), written under OUT/papers and OUT/reports in a folder for each
file name; one line per failure; exit code 1 if there is one or a paper has errors, 2 if nothing was converted.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliospark.operators import convert, validate
from foliospark.sources.papers import read_papers


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliospark")
    commands = parser.add_subparsers(dest="command", required=True)
    validate_ = commands.add_parser("validate")
    validate_.add_argument("path", help="a JSON paper, or a folder or pattern of them")
    validate_.add_argument("--questions", type=int, help="how many questions the print states")
    validate_.add_argument("--minutes", type=int, help="the time that the print states")
    convert_ = commands.add_parser("convert")
    convert_.add_argument("layer", help="the folder of the page layer's tables")
    convert_.add_argument("out", help="a folder that does not hold papers yet")
    for name in ("title", "paper", "year"):
        convert_.add_argument(f"--{name}")
    convert_.add_argument("--minutes", type=int)
    said = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("foliospark").getOrCreate()
    return _validate(spark, said) if said.command == "validate" else _convert(spark, said)


def _validate(spark: SparkSession, said: argparse.Namespace) -> int:
    papers = read_papers(spark, said.path)
    issues = validate.paper_issues(papers, expected_questions=said.questions, expected_duration=said.minutes)
    place = F.concat_ws(" ", F.concat(F.lit("question "), F.col("question").cast("string")), "field")
    lines = issues.orderBy("paper_id", "ord").select("level", F.concat_ws(": ", "paper_id", F.concat_ws(" ", "level", "code"), F.nullif(place, F.lit("")), "message").alias("line"))
    counts: dict[str, int] = {}
    for row in lines.toLocalIterator():  # a partition at a time, whatever their number
        print(row.line)
        counts[row.level] = counts.get(row.level, 0) + 1
    print(f"{counts.get('error', 0)} errors, {counts.get('warning', 0)} warnings")
    return 1 if counts.get("error") else 0


def _convert(spark: SparkSession, said: argparse.Namespace) -> int:
    layer = convert.Layer(**{f.name: spark.read.parquet(f"{said.layer}/{f.name}.parquet") for f in dataclasses.fields(convert.Layer)})
    done = convert.convert(layer, said.title, said.paper, said.year, said.minutes)
    for table, name in ((done.papers, "papers"), (done.reports, "reports")):
        table.select(F.col("json").alias("value"), "file_name").write.partitionBy("file_name").text(f"{said.out}/{name}")
    failures = 0
    for row in done.failures.orderBy("paper_id").toLocalIterator():
        print(f"{row.paper_id}: {row.error}")
        failures += 1
    n, errors, flagged = done.papers.count(), done.issues.where("level = 'error'").count(), done.questions.where("size(reasons) > 0").count()
    print(f"{n} papers, {failures} failures, {errors} errors, {flagged} questions to review")
    return 2 if not n else 1 if failures or errors else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
