"""Parquet tables as DataFrames, spread over the cluster's cores."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table whose rows are costly to process: one with fewer splits than cores is dealt out by a hash of ``key``.

    A table of many files, as any large one, is read as it is and not shuffled.
    """
    table = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores, F.col(key)) if table.rdd.getNumPartitions() < cores else table


def shared_folder(spark: SparkSession) -> str:
    """A new folder path below ``spark.checkpoint.dir``; where that is unset, below a temporary one, if everything runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tamarisk-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def ensure(spark: SparkSession, path: str, schema: str, *partitions: str) -> None:
    """Makes the folder of a Parquet table without touching what it holds, so that it can be read before its first row."""
    writer = spark.createDataFrame([], schema).write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_bucketed(df: DataFrame, path: str, keys: tuple[str, ...], buckets: int, dealt: bool = False) -> DataFrame:
    """Writes ``df`` below ``path``, bucketed and sorted by ``keys``, and reads it again as a table that joins on them without a shuffle. ``dealt``: its rows are where ``repartition(buckets, *keys)`` puts them."""
    name = f"tamarisk_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)
