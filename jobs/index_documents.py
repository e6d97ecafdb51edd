"""Keeps the lexical index of a growing folder of documents up to date.

    python -m jobs.index_documents --config jobs/index_documents.json

Every run reads the files that came since the last one (a file stream with a checkpoint), indexes the
passages whose content is not indexed yet, and writes the lexicon (term, df, idf) anew from the counts
that the batches stored. A run that finds nothing new, or repeats one that was cut off, leaves the
same index. Paths may be anything that Spark reads and writes.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.growing_index import GrowingIndex

log = logging.getLogger("jobs.index_documents")
#: Terms with the most postings whose weights go to every task; the postings of the others are shuffled to theirs.
FREQUENT_TERMS = 1 << 16


def index_documents(
    spark: SparkSession, documents: str, index: str, checkpoint: str,
    id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", files_per_batch: int = 1000, shards: int = 16,
) -> dict[str, int]:
    """Indexes what is new below ``documents`` (Parquet); returns how many rows were read, passages added, and terms the lexicon has."""
    schema = spark.read.parquet(documents).schema
    # a stream takes a folder by its path but a single file by a pattern only; one that matches just this name takes either
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]")
    rows = stream.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.lit("").alias("heading"), F.col(text_column).alias("text"))
    grown = GrowingIndex(spark, index)
    done = {"read": 0, "added": 0}

    def add(batch: DataFrame, number: int) -> None:
        read, added = batch.count(), grown.add(batch, number)
        done["read"], done["added"] = done["read"] + read, done["added"] + added
        log.info("batch %d: read %d rows from %s, wrote %d new passages to %s", number, read, documents, added, index)

    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    lexicon = grown.bm25().idf.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
    lexicon.repartition("shard").sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{index}/lexicon")
    done["terms"] = _lexicon(spark, index).count()
    log.info("read %d rows and added %d passages in all; wrote %d terms to %s/lexicon", done["read"], done["added"], done["terms"], index)
    return done


def _lexicon(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema("term string, df long, idf double, shard int").parquet(f"{index}/lexicon")


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """(id, content_hash, term, tf, dl, df, idf): every posting with its passage and its term's weight."""
    postings = GrowingIndex(spark, index).table("postings").select("id", "content_hash", "term", "tf", "dl")
    weights = _lexicon(spark, index).select("term", "df", "idf")
    frequent = weights.orderBy(F.desc("df"), "term").limit(FREQUENT_TERMS)
    found = postings.join(F.broadcast(frequent), "term", "left")  # most postings have their weight here and stay where they are
    columns = ("id", "content_hash", "term", "tf", "dl", "df", "idf")
    rare = found.where("df IS NULL").select("id", F.unhex("content_hash").alias("content_hash"), "term", "tf", "dl").join(weights, "term")
    return found.where("df IS NOT NULL").select(*columns).unionByName(rare.withColumn("content_hash", F.lower(F.hex("content_hash"))).select(*columns))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--config", help="JSON file with the parameters of index_documents")
    for name in ("documents", "index", "checkpoint"):
        parser.add_argument(f"--{name}", help=f"path, instead of the one in the config file: {name}")
    given = vars(parser.parse_args(arguments))
    settings = {}
    if path := given.pop("config"):
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
    settings |= {k: v for k, v in given.items() if v}
    if missing := [k for k in ("documents", "index", "checkpoint") if k not in settings]:
        parser.error(f"no path given: {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("index_documents").getOrCreate()
    try:
        index_documents(spark, **settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
