"""A session with the settings that this library expects."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", shuffle_partitions)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys over some tasks a core: for work that is heavy for each row, as the scan of a small
    table has one task or few."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the cluster's shared folder (spark.checkpoint.dir), so that what uses it twice
    does not compute it twice. Where none is named, in a folder of our own, on one machine only."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="shared-"))
    return df.checkpoint()
