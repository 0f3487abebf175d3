"""A stream of paper files to issues, and an incremental job log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.validate import paper_issues


def issue_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of JSON papers as they arrive in a folder."""
    files = spark.readStream.format("text").option("wholetext", True).schema("value string").load(folder)
    return paper_issues(files.select(F.col("_metadata.file_path").alias("paper_id"), F.col("value").alias("json")))


def log_from(log: DataFrame, job: str, offset: int) -> DataFrame:
    """The entries of a job's log from an offset on."""
    return log.where((F.col("job") == job) & (F.col("offset") >= offset)).orderBy("offset")
