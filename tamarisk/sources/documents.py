"""Document folders as DataFrames, and question sets from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".md", ".markdown", ".txt", ".rst")


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text) of every document below a folder, one row per file, source being its base name.

    A missing folder raises FileNotFoundError.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(folder)
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    named = files.select(F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    suffix = F.lower(F.regexp_extract("source", r"(\.[^.]*)$", 1))
    return named.where(suffix.isin(*SUFFIXES)).orderBy("path").select("source", "text")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, expected_source, expected_keywords) from a JSON object with a list ``questions``."""
    schema = "questions array<struct<id:string, question:string, expected_source:string, expected_keywords:array<string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("questions"))
