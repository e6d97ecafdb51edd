"""Dense search: every question against every vector.

``search_top_k`` takes the questions in blocks of bounded size and scans the vectors once a block by
matrix products; a task keeps the k best of each question and returns nothing else, but for pairs
that are asked for. ``cosine_scores`` gives the scores of all pairs, for checks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Questions whose vectors are sent to the executors at a time, and vectors that meet them at a time.
QUESTION_BLOCK, VECTOR_BLOCK = 4096, 1024
#: Rows of either side that meet in one matrix product where the scores of all pairs are wanted, and about how many pairs a task gives at most.
PAIR_BLOCK, TASK_PAIRS = 512, 1 << 25
MISMATCH = "dimension mismatch: query and index need the same embedding"


def assert_uniform_dim(vectors: DataFrame, column: str = "embedding") -> int | None:
    """The width that all vectors share; None for an empty table; ValueError if they differ."""
    row = vectors.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
    if row.low != row.high:
        raise ValueError(f"vectors of different widths: {row.low} to {row.high}")
    return row.low


def _packed(rows: DataFrame, id_col: str, v_col: str) -> DataFrame:
    """(ids, width, cells): ``PAIR_BLOCK`` rows at most in one, their components side by side."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, PAIR_BLOCK):
                part = batch.slice(a, PAIR_BLOCK)
                widths = set(pa.compute.list_value_length(part.column(1)).to_pylist())
                if len(widths) > 1:
                    raise ValueError(MISMATCH)
                cells = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([widths.pop()], pa.int32()), pa.array([cells], pa.binary())], names=["ids", "width", "cells"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, v_col).mapInArrow(run, f"ids array<{kind}>, width int, cells binary")


def cosine_scores(questions: DataFrame, vectors: DataFrame, digits: int | None = None) -> DataFrame:
    """(qid, id, score) for questions (qid, q) and vectors (id, v); one question set against all rows, null where a vector or a component is.

    Both sides are packed into blocks, the blocks are paired, and a pair of blocks is one matrix
    product: the pairs of rows exist in its result only, so a task holds two blocks at a time. Scores
    are rounded to ``digits`` if given, halves away from zero.

    The result grows with the square of the tables, so its rows are ordered for who stores them:
    by question and row, which leaves the score as what takes room. Parquet's writers keep a
    dictionary of a column if its first page repeats itself; scores of five digits do so in millions
    of rows but not in a page of them, so the first pair of blocks of a task comes by score.
    """
    whole = lambda c: F.coalesce(~F.exists(c, lambda x: x.isNull()), F.lit(False))
    q, v = whole(F.col("q")), whole(F.col("v"))
    parts = max(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-questions.count() * vectors.count() // TASK_PAIRS))
    # a product of two tables has a task for each pair of their partitions: the questions, the fewer, are in few
    left = _packed(vectors.where(v), "id", "v").repartition(parts)
    right = _packed(questions.where(q), "qid", "q").repartition(4).toDF("qids", "qwidth", "qcells")
    qid, key = (t.schema[c].dataType.simpleString() for t, c in ((questions, "qid"), (vectors, "id")))

    def run(batches):
        first = True
        for batch in batches:
            for r in range(batch.num_rows):
                ids, width, cells, qids, qwidth, qcells = (batch.column(c)[r] for c in range(6))
                if width.as_py() != qwidth.as_py():
                    raise ValueError(MISMATCH)
                m, a = (np.frombuffer(x.as_py(), "<f8").reshape(len(i.values), width.as_py()) for x, i in ((cells, ids), (qcells, qids)))
                product = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(m, axis=1))
                score = np.where(product == 0, 0.0, (a @ m.T) / np.where(product == 0, 1.0, product))
                if digits is not None:
                    score = np.copysign(np.floor(np.abs(score) * 10.0**digits + 0.5) / 10.0**digits, score) + 0.0  # no negative zero
                x, y = np.divmod(np.arange(score.size), len(m))
                score = score.ravel()
                if first:
                    order, first = np.argsort(score, kind="stable"), False
                    x, y, score = x[order], y[order], score[order]
                yield pa.RecordBatch.from_arrays([qids.values.take(pa.array(x)), ids.values.take(pa.array(y)), pa.array(score)], names=["qid", "id", "score"])

    scored = left.crossJoin(right).mapInArrow(run, f"qid {qid}, id {key}, score double")
    unknown = F.lit(None).cast("double").alias("score")
    none = vectors.where(~v).crossJoin(questions).unionByName(vectors.where(v).crossJoin(questions.where(~q)))
    return scored.unionByName(none.select("qid", "id", unknown))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column; zero vectors stay zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = set(column.value_lengths().to_pylist())
    if len(widths) > 1:
        raise ValueError("vectors of different widths")
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def best_of_each(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each question, by score and then id, grouped by question."""
    order = np.lexsort((ids, -score, q))
    first = np.concatenate(([True], q[order][1:] != q[order][:-1])) if len(order) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


class Best:
    """The k best rows of each of n questions that a task has met, by score and then id."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.q, self.ids, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        able = score >= self.floor[q]
        q, ids, score = np.concatenate((self.q, q[able])), np.concatenate((self.ids, ids[able])), np.concatenate((self.score, score[able]))
        kept = best_of_each(q, ids, score, self.k)
        self.q, self.ids, self.score = q[kept], ids[kept], score[kept]
        full = np.flatnonzero(np.bincount(self.q, minlength=len(self.floor)) == self.k)
        self.floor[full] = self.score[np.searchsorted(self.q, full, side="right") - 1]


def pair_block(pairs: DataFrame | None, own, place: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids, in order, and places of the questions of a block's pairs (qid, id)."""
    found = sorted((r.id, place[r.qid]) for r in pairs.where(own).select("qid", "id").collect() if r.qid in place) if pairs is not None else []
    both = np.array(found, dtype=np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def asked_of(pair_id: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``own`` and in the sorted ``pair_id`` of the ids that are asked for."""
    low, high = np.searchsorted(pair_id, own), np.searchsorted(pair_id, own, side="right")
    sizes = high - low
    return np.repeat(np.arange(len(own)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)


def _scan(questions: DataFrame, vectors: DataFrame, k: int, also: DataFrame | None, digits: int | None) -> DataFrame:
    """(qid, id, score, asked): each task's k best, and the pairs ``also`` (asked)."""
    spark = questions.sparkSession
    numbered = questions.select("qid", "q")
    n = numbered.count()
    blocks = -(-n // QUESTION_BLOCK) if n else 0
    schema, found = "qid long, id long, score double, asked boolean", []
    for block in range(blocks):
        own = F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block
        rows = numbered.where(own).toArrow()
        ids = rows["qid"].to_numpy()
        place = {i: at for at, i in enumerate(ids.tolist())}
        shared = spark.sparkContext.broadcast((ids, _matrix(rows["q"]), *pair_block(also, own, place)))

        def run(batches, shared=shared):
            ids, q, pair_id, pair_q = shared.value
            best = Best(len(ids), k)
            for batch in batches:
                for a in range(0, batch.num_rows, VECTOR_BLOCK):
                    part = batch.slice(a, VECTOR_BLOCK)
                    v, own = _matrix(part.column(1)), part.column(0).to_numpy()
                    if v.shape[1] != q.shape[1]:
                        raise ValueError(MISMATCH)
                    score = q @ v.T
                    if digits is not None:
                        score = np.round(score, digits)
                    x, y = np.nonzero(score >= best.floor[:, None])
                    best.add(x, own[y], score[x, y])
                    column, at = asked_of(pair_id, own)
                    if len(at):
                        yield scored_rows(ids[pair_q[at]], own[column], score[pair_q[at], column], True)
            if len(best.q):
                yield scored_rows(ids[best.q], best.ids, best.score, False)

        found.append(vectors.select("id", "v").mapInArrow(run, schema))
    return together(spark, found, schema)


def together(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    """The rows of all parts; without a part, an empty table. Rows of the driver would start Python workers of their own, so none are added to the parts."""
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def scored_rows(qid: np.ndarray, ids: np.ndarray, score: np.ndarray, asked: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qid), pa.array(ids), pa.array(score), pa.array(np.full(len(ids), asked))], names=["qid", "id", "score", "asked"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_top_k(questions: DataFrame, vectors: DataFrame, k: int = 4, min_similarity: float = 0.0, digits: int | None = None) -> DataFrame:
    """(qid, rank, id, score): the k nearest of each question, then those that reach the threshold; scores rounded to ``digits`` if given."""
    return _ranked(_scan(questions, vectors, k, None, digits), k).where(F.col("score") >= min_similarity).select("qid", "rank", "id", "score")


def search_with_pairs(questions: DataFrame, vectors: DataFrame, k: int, pairs: DataFrame, digits: int | None = None) -> DataFrame:
    """(qid, id, score) of the k nearest of each question and of the given pairs (qid, id), from one scan.

    A block of questions sends its pairs with it, so they are few for a question: a pool, not a result.
    """
    found = _scan(questions, vectors, k, pairs, digits)
    return with_asked(found, k)


def with_asked(found: DataFrame, k: int) -> DataFrame:
    """(qid, id, score): the k best of each question of a scan, and what it was asked for. The scan stands in the plan once, as it would be made for each time."""
    w = Window.partitionBy("qid", "asked").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("asked") | (F.col("rank") <= k)).select("qid", "id", "score").dropDuplicates(["qid", "id"])
