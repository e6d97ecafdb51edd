"""Shared plumbing of the training-data operators: tables, scratch space, packed arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.tables import read_spread, read_table

#: The white space that the contracts name: space and U+0009 to U+000D. ``bytes.split()`` splits on the same set.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_spread(spark, sf_dir, name, "doc_id") if name == "documents" else read_table(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder path below ``spark.checkpoint.dir``; a temporary one only where that is unset and everything runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tamarisk-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialise`` made, once nothing reads it."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table. They go over as Arrow: pickled rows are read on the executors by Python workers, which then stay there."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while (found := f"_{name}_{uuid.uuid4().hex[:8]}") in taken:
        pass
    return found


def crc_mod(column: str, modulus: int):
    """crc32 of the column's decimal text modulo ``modulus``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _weights() -> np.ndarray:
    """Of each byte: its lower-case (A-Z) value plus one, or zero for white space."""
    w = np.arange(1, 257, dtype=np.uint64)
    w[65:91] += np.uint64(32)
    w[[9, 10, 11, 12, 13, 32]] = 0
    return w


_BYTE = _weights()
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and byte lengths of the lower-cased (A-Z) words of UTF-8 ``texts``, in order, and the number of words of each text.

    Words are hashed as polynomials modulo 2**64 by a few vectorised passes over blocks that are cut
    at white space, so that one very long text needs no more memory than many short ones.
    """
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    limits = np.cumsum([len(t) + 1 for t in texts])
    # made anew for each batch: as a global of this module it would travel with every function sent to executors
    size = min(len(data), 2 * _BLOCK)
    tables = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    found, begun, sizes, at = [], [], [], 0
    while at < len(data):
        to = at + _BLOCK
        if to >= len(data):
            to = len(data)
        else:
            while not len(gap := np.flatnonzero(_BYTE[data[to : to + 1024]] == 0)):
                to += 1024
            to += int(gap[0]) + 1
        hashes, starts, lengths = _hash_block(data[at:to], *tables)
        found.append(hashes)
        begun.append(starts + at)
        sizes.append(lengths)
        at = to
    counts = np.diff(np.concatenate(([0], np.searchsorted(np.concatenate(begun), limits))))
    return np.concatenate(found), np.concatenate(sizes), counts


def _hash_block(data: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and lengths of the words in a block that ends with white space."""
    value = _BYTE[data]
    word = np.zeros(len(data) + 1, dtype=bool)
    word[1:] = value != 0
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(data) > len(up):  # a word of more than a block
        up, down = _powers(_BASE, len(data)), _powers(pow(_BASE, -1, 1 << 64), len(data))
    value *= up[: len(data)]
    total = np.cumsum(value, out=value)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix64((total[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends - starts


def chunks(batch, size: int = 4_000_000):
    """Row ranges of an Arrow string column that hold about ``size`` bytes each; a longer text is a range by itself."""
    start = used = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch), 0).to_pylist()):
        if used and used + n > size:
            yield start, i
            start, used = i, 0
        used += n
    if start < len(batch):
        yield start, len(batch)
