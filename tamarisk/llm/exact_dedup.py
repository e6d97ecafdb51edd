"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. A batch is
reduced to one row per digest, sort-merge anti-joined with the index, and what is new is
appended. The text itself never crosses the network: only 32-byte digests are shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, union_all

#: Numbers of code points at which a whole table is cut into batches.
STEPS = (4096, 512)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, the digest of the text without white space, its code points, a row number.

    Null text counts as empty; a null id is kept. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(text, f"{SPACE_CLASS}+", ""), 256)).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    )


class DigestIndex:
    """A bucketed table ``(digest, doc_id, n_chars, batch)``, sorted by digest within each bucket.

    ``location`` makes it an external table that a later session can open again; without it the
    warehouse holds it. ``buckets`` is fixed for the life of the index and set by its final size.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, location: str | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not spark.catalog.tableExists(name):
            place = f"LOCATION '{location}'" if location else ""
            spark.sql(
                f"CREATE TABLE {name} (digest BINARY, doc_id BIGINT, n_chars BIGINT, batch STRING) USING parquet"
                f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {place}"
            )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame, batch: str) -> None:
        rows = new.select("digest", F.col("keep_id").cast("long").alias("doc_id"), F.col("keep_chars").alias("n_chars"), F.lit(batch).alias("batch"))
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Decides on every row of ``docs`` and appends what is new.

        Of equal texts in the batch the longest original stays, then the smallest id (null last),
        then the first row; if the index has the digest already, none stays and ``keep_id`` is the
        entry's. Result: doc_id, keep_id, group_size (rows of the batch), kept, text_sha256.
        An empty batch gives an empty result and leaves the index as it is. A batch that names
        itself can be ingested again after a failure: what the index has from it does not count
        against it and is not appended twice.
        """
        rows = materialise(digests(docs, id_col, text_col), "digests")
        return judged(rows, self.decide(rows, batch))

    def decide(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Appends the digests of ``rows`` that the index lacks; (digest, keep_id, keep_row, group_size) of every one, keep_row null where the index had it."""
        best = F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", "row"))
        groups = materialise(
            rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
            .select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.a")).alias("keep_chars"),
                    F.col("best.row").alias("keep_row"), "group_size"),
            "groups",
        )
        index = self.entries().where(F.col("batch") != F.lit(batch or "")).select("digest", F.col("doc_id").alias("old_id"))
        new = materialise(groups.join(index.hint("merge"), "digest", "left_anti"), "new")
        old = groups.join(index.hint("merge"), "digest").select("digest", F.col("old_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), "group_size")
        decided = materialise(new.select("digest", "keep_id", "keep_row", "group_size").unionByName(old), "decided")
        own = self.entries().where(F.col("batch") == F.lit(batch)).select("digest") if batch else None
        self.append(new if own is None else materialise(new.join(own.hint("merge"), "digest", "left_anti"), "unseen"), batch or uuid.uuid4().hex)
        return decided


def judged(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The decision on every row. An ordinary shuffled join: adaptive execution splits the partition of a hot digest."""
    return rows.join(decided, "digest").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: tuple[int, ...] = STEPS) -> DataFrame:
    """A whole table against an index of its own, which goes once all is decided.

    Texts go in as batches of falling length, cut at ``steps``: an entry of the index is never
    displaced, so whatever a batch finds there is longer, and stays. Of equal texts in a batch the
    longest stays, then the smallest id (null last), then the first row. Nulls, repeated rows and an
    empty table are as in ``DigestIndex.ingest``.
    """
    spark = docs.sparkSession
    rows = materialise(digests(docs, id_col, text_col), "digests")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    decided = []
    for low, high in zip((*steps, 0), (None, *steps), strict=True):
        some = rows.where(F.col("n_chars") >= low)
        decided.append(index.decide(some if high is None else some.where(F.col("n_chars") < high), f"from {low}"))
    whole = union_all(decided).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("keep_row").alias("keep_row"), F.sum("group_size").alias("group_size"))
    index.drop()
    return judged(rows, whole)
