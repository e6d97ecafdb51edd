"""The index on storage: a Parquet table of chunks and one of key-value metadata.

Chunks are bucketed and sorted by content hash, with a partition for each batch that was added. A batch
meets what is stored without a shuffle of it, and is written by one job into its own partition, which
replaces what an earlier try of the same batch left there.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dense import assert_uniform_dim
from .tables import ensure

CHUNKS = "id long, source string, chunk_index int, heading string, content string, content_hash string, embedding array<float>, dim int"
STORED = CHUNKS + ", batch string"
META = "key string, value string"
META_KEYS = ("embedding_signature", "chunk_size", "chunk_overlap", "backend", "document_count")


class IndexUnusable(RuntimeError):
    """The index can't answer questions."""


class EmptyIndex(IndexUnusable):
    """The index has no chunk."""


class IndexMismatch(IndexUnusable):
    """The index was made with another embedding."""

    def __init__(self, stored: str, current: str):
        super().__init__(f"index was made with {stored}, the backend is {current}")
        self.stored, self.current = stored, current


def content_hash(source: Column, heading: Column, text: Column) -> Column:
    """Identity of a passage: its source, heading and text, not its position."""
    zero = F.lit("\x00")
    return F.sha2(F.concat(source, zero, heading, zero, text), 256)


def first_of_each(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key; its hash is partially aggregated, so a hot key is not gathered."""
    columns = [c for c in rows.columns if c != key]
    packed = F.min(F.struct(*order, F.struct(*columns).alias("__row")))
    return rows.groupBy(key).agg(packed.alias("__m")).select(key, "__m.__row.*").select(*rows.columns)


def new_rows(rows: DataFrame, stored: DataFrame, key: str = "content_hash", order: str = "chunk_index") -> DataFrame:
    """Insert-or-ignore: rows whose key is not stored yet, the first of each key."""
    return first_of_each(rows, key, order).join(stored.select(key), key, "left_anti").select(*rows.columns)


def upsert(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value rows after ``changes`` (key, value, seq); the change with the highest seq wins."""
    last = changes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return stored.join(last, "key", "left_anti").select("key", "value").unionByName(last)


def get_meta(meta: DataFrame, key: str, default: str | None = None) -> str | None:
    row = meta.where(F.col("key") == key).select("value").first()
    return default if row is None else row.value


class Scratch:
    """Tables written below a folder that all executors see, and read again: their plans start anew, and a lost executor costs a task."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{uuid.uuid4().hex}"
        self._n = itertools.count()

    def keep(self, table: DataFrame) -> DataFrame:
        path = f"{self.path}/{next(self._n)}"
        table.write.parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def clear(self) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Store:
    """Chunks and metadata below one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        """``buckets`` is how many buckets the chunks of a new store get; a store that has chunks keeps its number."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.spark, self.buckets = spark, buckets
        self.path = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        exists = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if exists else self.spark.createDataFrame([], schema)

    def scratch(self) -> Scratch:
        return Scratch(self.spark, f"{self.path}/_scratch")

    def chunks(self) -> DataFrame:
        return self._read("chunks", STORED).drop("batch")

    def batches(self) -> DataFrame:
        """(batch, n): what each batch added."""
        return self._read("chunks", STORED).groupBy("batch").agg(F.count("*").alias("n"))

    def meta(self) -> DataFrame:
        """The last value of each key: the log of changes is append-only."""
        return self._read("meta", META + ", seq long").groupBy("key").agg(F.max_by("value", "seq").alias("value"))

    @contextmanager
    def bucketed(self) -> Iterator[DataFrame]:
        """The chunks, with ``batch``, as a table that joins on content_hash as it lies; its name, ``self.table``, is gone afterwards, its files stay."""
        ensure(self.spark, f"{self.path}/chunks", STORED, "batch")
        if not (known := get_meta(self.meta(), "chunk_buckets")):
            self.set_meta({"chunk_buckets": self.buckets})
        place = f"{self.path}/chunks".replace("\\", "\\\\").replace("'", "\\'")
        self.table = f"tamarisk_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.table} ({STORED}) USING parquet PARTITIONED BY (batch) CLUSTERED BY (content_hash) SORTED BY (content_hash) INTO {known or self.buckets} BUCKETS LOCATION '{place}'"
        )
        try:
            self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")
            yield self.spark.table(self.table)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def fresh(self, rows: DataFrame, stored: DataFrame) -> DataFrame:
        """The rows that are new by content hash, of equal ones the first, laid out like the stored ones, which stay where they are."""
        first = first_of_each(rows, "content_hash", "chunk_index", "source")
        buckets = int(get_meta(self.meta(), "chunk_buckets", str(self.buckets)))
        # as an outer join with a mark: an anti-join would move below the aggregation and the repartitioning, and repeated rows would be shuffled
        known = stored.select("content_hash", F.lit(True).alias("__known"))
        return first.repartition(buckets, "content_hash").join(known, "content_hash", "left").where("__known IS NULL").select(*rows.columns)

    def add_chunks(self, rows: DataFrame, batch: str | None = None) -> int:
        """Adds the rows that are new by content hash as one batch and returns their number.

        Ids go on without a gap from the highest, in the order of source and index. A batch that is
        given again replaces its own rows, so a try that was cut off, or a repetition, adds nothing twice;
        without a name it is a new one. One writer at a time: files have no lock.
        """
        scratch = self.scratch()
        with self.bucketed() as stored:
            batch = uuid.uuid4().hex if batch is None else batch
            others = stored.where(F.col("batch") != batch)
            start = others.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            order = ("source", "chunk_index", "content_hash")
            placed = self.fresh(rows, others).repartitionByRange(*order).sortWithinPartitions(*order)
            staged = scratch.keep(placed.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() % (1 << 33)))
            sizes = staged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition of one shuffle
            before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
            numbered = staged.join(F.broadcast(before), "part").withColumn("id", F.lit(start + 1) + F.col("before") + F.col("place"))
            columns = [c.split()[0] for c in CHUNKS.split(", ")]
            buckets = int(get_meta(self.meta(), "chunk_buckets"))
            written = numbered.select(*columns).repartition(buckets, "content_hash")
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = :batch) SELECT {', '.join(columns)} FROM {{rows}}", {"batch": batch}, rows=written)
            added = staged.count()
        scratch.clear()
        return added

    def set_meta(self, values: dict[str, str]) -> None:
        seq = self._read("meta", META + ", seq long").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        rows = [(k, str(v), seq + i) for i, (k, v) in enumerate(values.items(), 1)]
        self.spark.createDataFrame(rows, META + ", seq long").write.mode("append").parquet(f"{self.path}/meta")

    def reset(self) -> None:
        for name, schema in (("chunks", STORED), ("meta", META + ", seq long")):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def verify(self, signature: str) -> None:
        """Raises unless there are chunks of one width and the stored signature, if any, is ``signature``."""
        chunks = self.chunks()
        if chunks.isEmpty():
            raise EmptyIndex(f"no chunks in {self.path}")
        assert_uniform_dim(chunks)
        stored = get_meta(self.meta(), "embedding_signature")
        if stored is not None and stored != signature:
            raise IndexMismatch(stored, signature)

    def sources(self) -> DataFrame:
        return self.chunks().select("source").distinct().orderBy("source")
