"""Continuous ingestion: new files become chunks, and each micro-batch appends what the index lacks."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.chunking import chunk_documents
from ..operators.backends import Backend
from ..plans.pipeline import embed_chunks
from ..sources.documents import SUFFIXES
from ..sources.store import Store


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text) of files as they appear below a folder."""
    files = spark.readStream.option("recursiveFileLookup", True).option("wholetext", True).format("text").load(folder)
    named = files.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
    return named.where(F.lower(F.regexp_extract("source", r"(\.[^.]*)$", 1)).isin(*SUFFIXES))


def stream_ingest(docs: DataFrame, store: Store, backend: Backend, checkpoint: str, size: int = 900, overlap: int = 150, once: bool = False) -> StreamingQuery:
    """Starts a query over streaming (source, text) rows. A batch is one of the store's, named by checkpoint and number: run again, it replaces itself."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, number: int) -> None:
        store.add_chunks(embed_chunks(chunk_documents(batch, size, overlap), backend), f"{name}-{number}")

    writer = docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
