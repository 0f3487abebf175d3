"""Connected components of a links table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, comp) for every id in links(a, b); comp is the smallest id reachable.

    Null ends and self links count for nothing. Every step writes a table of one row per linked id;
    the number of steps is logarithmic in the longest path.
    """
    both = links.where("a is not null and b is not null and a <> b")
    edges = stage(
        spark,
        both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stage(spark, edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").select(F.col("a").alias("id"), "comp")
        least = near.unionByName(labels).groupBy("id").agg(F.min("comp").alias("up"))
        jumped = least.join(labels.select(F.col("id").alias("up"), F.col("comp").alias("top")), "up", "left")
        old = labels.select("id", F.col("comp").alias("was"))
        new = stage(
            spark,
            jumped.select("id", F.least("up", "top").alias("comp")).join(old, "id").select("id", "comp", (F.col("comp") != F.col("was")).alias("moved")),
            "labels",
        )
        labels = new.select("id", "comp")
        if new.where("moved").isEmpty():
            return labels
