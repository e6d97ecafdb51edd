"""Exact nearest neighbours by cosine from an inverted file: vectors lie in the cell of their nearest pivot.

Angles obey the triangle inequality, so a question at angle a from a pivot is at least |a - b| away
from a vector at angle b from it. A cell's smallest and largest angle bound the cosine of all its
vectors; cells that cannot reach the k-th best cosine found so far are not read, and of a cell that is
read, vectors outside the ring of angles that can are skipped before any product. The result is that
of a full scan, whatever the pivots; how much is read depends on how clustered the vectors are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dense import VECTOR_BLOCK, _matrix, assert_uniform_dim, best_of_each

#: Most pivots of an index, questions that are asked at a time, and cells that give a question its first scores.
PIVOTS, QUESTIONS, SEEDS = 1024, 4096, 3
#: What rounding may take off a bound of a cosine.
SLACK = 1e-6


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


@dataclass
class PivotIndex:
    """vectors (cell, angle, id, v), sorted by cell and angle; cells (cell, n, low, high: angles); pivots, a matrix of PIVOTS rows at most."""

    vectors: DataFrame
    cells: DataFrame
    pivots: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, keep: Callable[[DataFrame], DataFrame], most: int = PIVOTS, parts: int | None = None) -> PivotIndex:
        """From (id, v); ``keep`` stores a table and reads it again. Rows without an id or vector are left out; vectors of different widths raise ValueError.

        Pivots are vectors chosen by a hash of their id, the square root of the number of vectors at
        most. A vector without direction (all zeros) is at a right angle to every pivot.
        """
        rows = vectors.where("id IS NOT NULL AND v IS NOT NULL").select("id", F.col("v").cast("array<double>").alias("v"))
        assert_uniform_dim(rows, "v")
        count = rows.count()
        chosen = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(max(1, min(most, int(count**0.5)))).select("v").toArrow()
        pivots = _matrix(chosen["v"]) if count else np.zeros((1, 0))
        shared = vectors.sparkSession.sparkContext.broadcast(pivots)

        def place(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, VECTOR_BLOCK):
                    part = batch.slice(a, VECTOR_BLOCK)
                    v = _matrix(part.column(1))
                    angles = _angles(v, shared.value)
                    cell = np.argmin(angles, axis=1)
                    own = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64())) if v.shape[1] else part.column(1)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(v)), cell]), part.column(0), own], names=["cell", "angle", "id", "v"])

        placed = rows.mapInArrow(place, "cell int, angle double, id long, v array<double>")
        # ranges of (cell, angle): a cell with many vectors is spread over several files, and a filter on cells skips the others
        parts = parts or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        stored = keep(placed.repartitionByRange(parts, "cell", "angle", "id").sortWithinPartitions("cell", "angle", "id"))
        return cls(stored, keep(stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))), pivots)

    def _scan(self, ids: np.ndarray, q: np.ndarray, to_pivot: np.ndarray, alive: np.ndarray, floor: np.ndarray, k: int, digits: int | None) -> DataFrame:
        """(qid, id, score, read): each task's k best of every question among the cells that are ``alive`` for it, and how many vectors it multiplied (qid null)."""
        cells = np.flatnonzero(alive.any(axis=0)).tolist()
        shared = self.vectors.sparkSession.sparkContext.broadcast((ids, q, to_pivot, alive, np.arccos(np.clip(floor - SLACK, -1.0, 1.0))))

        def run(batches):
            ids, q, to_pivot, alive, widest = shared.value
            best_q, best_id, best, read = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), 0
            for batch in batches:
                cell, angle, own = (batch.column(c).to_numpy() for c in range(3))
                v = batch.column(3).flatten().to_numpy().reshape(len(cell), -1)
                for c in np.unique(cell):
                    asked = np.flatnonzero(alive[:, c])
                    at = np.flatnonzero(cell == c)
                    for a in range(0, len(at), VECTOR_BLOCK):
                        some = at[a : a + VECTOR_BLOCK]
                        inside = np.abs(to_pivot[asked, c][:, None] - angle[some][None, :]) <= widest[asked][:, None]
                        rows, columns = np.flatnonzero(inside.any(axis=1)), np.flatnonzero(inside.any(axis=0))
                        score = q[asked[rows]] @ v[some[columns]].T
                        read += score.size
                        if digits is not None:
                            score = np.round(score, digits)
                        x, y = np.nonzero(inside[np.ix_(rows, columns)])
                        best_q, best_id, best = np.concatenate((best_q, asked[rows][x])), np.concatenate((best_id, own[some[columns]][y])), np.concatenate((best, score[x, y]))
                        kept = best_of_each(best_q, best_id, best, k)
                        best_q, best_id, best = best_q[kept], best_id[kept], best[kept]
            names = ["qid", "id", "score", "read"]
            if read:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.float64()), pa.array([read])], names=names)
            if len(best):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best_q]), pa.array(best_id), pa.array(best), pa.nulls(len(best), pa.int64())], names=names)

        return self.vectors.where(F.col("cell").isin(cells)).mapInArrow(run, "qid long, id long, score double, read long")

    def search(self, questions: DataFrame, keep: Callable[[DataFrame], DataFrame], k: int = 4, digits: int | None = None) -> DataFrame:
        """(qid, id, score, read): what ``top_k`` ranks, and the number of products that each task made."""
        spark = self.vectors.sparkSession
        asked = questions.where("qid IS NOT NULL AND q IS NOT NULL").select("qid", F.col("q").cast("array<double>").alias("q"))
        count = asked.count()
        cells = self.cells.toArrow()  # PIVOTS rows at most
        cell, n, low, high = (cells[c].to_numpy() for c in ("cell", "n", "low", "high"))
        out = spark.createDataFrame([], "qid long, id long, score double, read long")
        blocks = -(-count // QUESTIONS) if len(cell) else 0
        for block in range(blocks):
            rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow()
            ids, q = rows["qid"].to_numpy(), _matrix(rows["q"])
            if not len(ids):
                continue
            if q.shape[1] != self.pivots.shape[1]:
                raise ValueError("dimension mismatch: query and index need the same embedding")
            to_pivot = _angles(q, self.pivots)
            bound = np.full(to_pivot.shape, -np.inf)
            bound[:, cell] = np.cos(np.maximum(0.0, np.maximum(to_pivot[:, cell] - high, low - to_pivot[:, cell])))
            nearest = np.argsort(-bound[:, cell], axis=1, kind="stable")
            enough = np.cumsum(n[nearest], axis=1) < k
            first = np.zeros(to_pivot.shape, bool)
            seeds = np.arange(nearest.shape[1])[None, :] < np.maximum(SEEDS, enough.sum(axis=1) + 1)[:, None]
            first[np.nonzero(seeds)[0], cell[nearest[seeds]]] = True
            floor = np.full(len(ids), -1.0)
            found = keep(self._scan(ids, q, to_pivot, first, floor, k, None))
            place = {i: at for at, i in enumerate(ids.tolist())}
            kth = _ranked(found.where("qid IS NOT NULL"), k).where(F.col("n") == k).select("qid", "score").collect()  # a row a question
            for r in kth:
                floor[place[r.qid]] = r.score
            second = bound >= (floor - SLACK)[:, None]
            out = out.unionByName(self._scan(ids, q, to_pivot, second, floor, k, digits)).unionByName(found.where("qid IS NULL"))
        return out

    def top_k(self, questions: DataFrame, keep: Callable[[DataFrame], DataFrame], k: int = 4, min_similarity: float = 0.0, digits: int | None = None) -> DataFrame:
        """(qid, rank, id, score): the k nearest of each question (qid, q), then those that reach the threshold; ties by id, scores rounded to ``digits`` (6 at most) if given."""
        found = _ranked(self.search(questions, keep, k, digits).where("qid IS NOT NULL"), k)
        return found.where(F.col("score") >= min_similarity).select("qid", F.col("n").alias("rank"), "id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
