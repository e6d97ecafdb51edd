"""A lexical index that grows by batches: each batch adds its own postings and counts, and nothing that is stored is counted again.

Document frequencies and lengths add up over batches, so the statistics that scores need are sums of
what the batches stored. A batch is a partition of every table and is replaced whole when it is run
again: a batch that was cut off, or is repeated, leaves the same index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import counted_terms
from ..sources.store import content_hash, first_of_each
from ..sources.tables import ensure
from .lexical import BM25Index

PASSAGES = "id long, content_hash string, dl long, batch long"
#: A posting has the hash and length of its text too, which are equal for all rows of a text and so cost little where they lie.
POSTINGS = "term string, id long, tf long, content_hash string, dl long, batch long"
COUNTS = "term string, df long, batch long"
SIZES = "n long, tokens long, terms binary, sources binary, batch long"
#: Precision of the sketches: 2^14 registers, a relative error of 0.8 %.
REGISTERS = 14
TABLES = {"passages": PASSAGES, "postings": POSTINGS, "counts": COUNTS, "sizes": SIZES}


class GrowingIndex:
    """Tables below one folder, each partitioned by batch: passages, postings, and per batch document frequencies (counts), totals and sketches of the terms and sources (sizes)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in TABLES.items():
            ensure(spark, f"{self.path}/{name}", schema, "batch")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def add(self, passages: DataFrame, batch: int) -> int:
        """Adds the (id, source, heading, text) rows whose content no other batch has, the least id of equal ones, and returns their number.

        Null sources, headings and texts count as empty; rows without an id are left out.
        """
        blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "heading", "text")}
        rows = passages.where("id IS NOT NULL").select(F.col("id").cast("long"), *blank.values())
        hashed = rows.select("id", content_hash(F.col("source"), F.col("heading"), F.col("text")).alias("content_hash"))
        # the batch's hashes meet the stored ones; texts are shuffled only if they have to be, by the join with the ids that stay
        fresh = first_of_each(hashed, "content_hash", "id").join(self.table("passages").where(F.col("batch") != batch).select("content_hash"), "content_hash", "left_anti")
        folder = lambda name: f"{self.path}/{name}/batch={batch}"
        fresh.select("id", "content_hash").write.mode("overwrite").parquet(f"{self.path}/fresh/batch={batch}")
        fresh = self.spark.read.schema("id long, content_hash string").parquet(f"{self.path}/fresh/batch={batch}")
        lexical = F.when(F.col("heading") != "", F.concat("heading", F.lit("\n"), "text")).otherwise(F.col("text"))
        counted = rows.join(fresh.select("id"), "id", "left_semi").select("id", content_hash(F.col("source"), F.col("heading"), F.col("text")).alias("content_hash"), counted_terms(lexical).alias("terms"))
        counted = counted.select("id", "content_hash", "terms", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + t["n"]).alias("dl")).select("id", "content_hash", "dl", F.inline("terms"))
        counted.select("term", "id", F.col("n").cast("long").alias("tf"), "content_hash", "dl").write.mode("overwrite").parquet(folder("postings"))
        postings = self.spark.read.schema("term string, id long, tf long").parquet(folder("postings"))
        lengths = postings.groupBy("id").agg(F.sum("tf").alias("dl"))
        fresh.join(lengths, "id", "left").select("id", "content_hash", F.coalesce("dl", F.lit(0)).alias("dl")).write.mode("overwrite").parquet(folder("passages"))
        postings.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(folder("counts"))
        own = self.spark.read.schema("id long, dl long").parquet(folder("passages")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
        terms = self.spark.read.schema("term string").parquet(folder("counts")).agg(F.hll_sketch_agg("term", F.lit(REGISTERS)).alias("terms"))
        sources = rows.join(fresh.select("id"), "id", "left_semi").agg(F.hll_sketch_agg("source", F.lit(REGISTERS)).alias("sources"))
        own.crossJoin(terms).crossJoin(sources).coalesce(1).write.mode("overwrite").parquet(folder("sizes"))
        return self.spark.read.schema("n long, tokens long").parquet(folder("sizes")).first().n

    def estimates(self) -> DataFrame:
        """One row (passages, tokens, terms, sources): the numbers of distinct terms and sources are estimates from one sketch a batch, so no posting is read."""
        joined = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return self.table("sizes").agg(total("n").alias("passages"), total("tokens").alias("tokens"), joined("terms").alias("terms"), joined("sources").alias("sources"))

    def bm25(self) -> BM25Index:
        """The index of all batches; statistics are sums over the batches' own, so no posting is read for them."""
        corpus = self.table("sizes").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("tokens").alias("tokens"))
        corpus = corpus.select("n", F.coalesce(F.try_divide("tokens", "n"), F.lit(0.0)).alias("avgdl"))
        df = self.table("counts").groupBy("term").agg(F.sum("df").alias("df"))
        return BM25Index(self.table("postings").select("term", "id", "tf"), self.table("passages").select("id", "dl"), BM25Index.weights(df, corpus), corpus)
