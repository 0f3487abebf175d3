"""Reading and writing papers, layers, pictures."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPLOAD_BYTES = 80 << 20
OPTION = "array<struct<label:string,content:string>>"
IMAGE = "array<struct<src:string,alt:string>>"
QUESTIONS = f"array<struct<number:int,stem:string,options:{OPTION},images:{IMAGE},sourcePage:int,needsReview:boolean>>"
PAPER = f"formatVersion int, id string, title string, paper string, year string, durationMinutes int, questions {QUESTIONS}"


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, json) of JSON files as they are, for the validator; paper_id is the path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("paper_id"), F.col("value").alias("json"))


def typed(papers: DataFrame) -> DataFrame:
    """Validated papers in the fixed schema."""
    return papers.select("paper_id", F.from_json("json", PAPER).alias("p")).select("paper_id", "p.*")


def kind_of(content: Column) -> Column:
    """The kind of a file by its first bytes, null for others."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when(head == "89504E47", "png").when(head.startswith("FFD8FF"), "jpeg").when(head == "47494638", "gif").when(head.startswith("424D"), "bmp")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length) of files that are PDF or pictures by their first bytes and not too long."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", kind_of(F.col("content")).alias("kind"), "length").where((F.col("length") <= UPLOAD_BYTES) & F.col("kind").isNotNull())


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures by the JVM's reader, for pixel operators."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def data_uri(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(png), r"\s+", ""))  # base64 may break lines


def decode_data_uri(src: Column) -> Column:
    """The bytes of a PNG data URI, null if it is none."""
    head = "data:image/png;base64,"
    return F.when(F.startswith(src, F.lit(head)), F.try_to_binary(F.substring(src, len(head) + 1, 2**30), F.lit("base64")))


@F.pandas_udf(T.StringType())
def _pretty(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in rows:
        yield x.map(lambda s: json.dumps(json.loads(s), ensure_ascii=False, indent=2))


def pretty_json(struct: Column) -> Column:
    """A struct as JSON in the file format: two spaces, non-ASCII kept, keys in their order, nulls written."""
    return _pretty(F.to_json(struct, {"ignoreNullFields": "false"}))


def paper_text(papers: DataFrame) -> DataFrame:
    """(id, json) in the file format: two spaces, non-ASCII kept, keys in their order."""
    names = [f.split(" ")[0] for f in PAPER.split(", ")[:6]] + ["questions"]
    return papers.select("id", pretty_json(F.struct(*names)).alias("json"))


def write_papers(papers: DataFrame, path: str) -> None:
    """One JSON text per line group under path, in a folder for each paper."""
    paper_text(papers).select(F.col("json").alias("value"), "id").write.partitionBy("id").text(path)
