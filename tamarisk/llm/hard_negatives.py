"""Hard negatives for contrastive training: of each anchor and positive, the best rows of other labels below the positive.

Vectors are quantised to integers, so scores are exact and the same on every machine. Anchors are a
stated query set: blocks of them go to the executors, where each tile of rows gives the scores of every
anchor as one matrix product. An anchor's scores are sorted in full, by score and id at once in one
integer key; the upper limit of each of its positives is found by binary search, and the next rows down
to the lower limit are read. Tiles hand on a few rows an anchor and positive, never a list of scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, union_all

#: Anchors that are sent to the executors at a time; rows of a tile; scores that are sorted at a time.
ANCHORS, TILE, SCORES = 8192, 1 << 14, 1 << 21
#: Bounds of sums of products that doubles add exactly, and of scores that a key has room for.
EXACT, KEYED = 1 << 53, 1 << 48


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null, infinite or no number."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(doubles, lambda x: F.floor(x * scale)))


def usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, label, q): rows with an id, a label and a finite vector; of rows that share an id the least (label, q)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("q")).dropna()
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")


def _by_width(batch: pa.RecordBatch):
    """(ids, labels, q) of each tile of rows whose vectors are equally wide, ids rising."""
    ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    sizes = batch.column(2).value_lengths().to_numpy()
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        at = at[np.argsort(ids[at], kind="stable")]
        for a in range(0, len(at), TILE):
            some = at[a : a + TILE]
            yield ids[some], labels[some], batch.column(2).take(pa.array(some)).flatten().to_numpy().reshape(len(some), width)


def products(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; OverflowError where one could need more than 63 bits."""
    largest = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    bound = largest(a) * largest(v) * a.shape[1]
    if bound >= 2.0**62:
        raise OverflowError("components are too large for scores of 64 bits")
    if bound >= EXACT:
        return a @ v.T
    return (a.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)


class Tile:
    """Keys of the scores of some anchors against rows of a tile, ids rising: by rising key the score falls, then the id rises.

    A key is a score and a place in the tile; scores that are too large for that are replaced by their ranks.
    """

    def __init__(self, anchors: np.ndarray, ids: np.ndarray, q: np.ndarray):
        self.ids, self.n, self.ranked = ids, len(ids), None
        score = products(anchors, q)
        if np.abs(score).max(initial=0) >= KEYED:
            self.ranked, place = np.unique(score, return_inverse=True)
            score = place.reshape(score.shape)
        self.keys = (-score << 15) | np.arange(self.n)

    def scores(self, keys: np.ndarray) -> np.ndarray:
        return -(keys >> 15) if self.ranked is None else self.ranked[-(keys >> 15)]

    def from_score(self, most: np.ndarray) -> np.ndarray:
        """The least key that a score of ``most`` or less can have."""
        return -(most if self.ranked is None else np.searchsorted(self.ranked, most, side="right") - 1) << 15

    def rows(self, keys: np.ndarray) -> np.ndarray:
        return self.ids[keys & ((1 << 15) - 1)]


def _groups(anchor_label: np.ndarray, n: int):
    """Places of anchors with one label, as many at a time as give SCORES scores with ``n`` rows."""
    order = np.argsort(anchor_label, kind="stable")
    step = max(1, SCORES // max(n, 1))
    for some in np.split(order, np.flatnonzero(np.diff(anchor_label[order])) + 1):
        for a in range(0, len(some), step):
            yield some[a : a + step]


def _stack(parts: list[tuple]) -> pa.RecordBatch:
    names = ("anchor", "target", "id", "score")
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=list(names))


def _scan(rows: DataFrame, block: list, visit) -> DataFrame:
    """(anchor, target, id, score) that ``visit`` finds in each tile: it takes (anchors, labels, q, ids of the tile, its labels, its q)."""
    by_width: dict[int, list] = {}
    for r in block:
        by_width.setdefault(len(r.q), []).append(r)
    packed = {w: (np.array([r.id for r in b]), np.array([r.label for r in b]), np.array([r.q for r in b], np.int64).reshape(len(b), w), [r.asked for r in b]) for w, b in by_width.items()}
    shared = rows.sparkSession.sparkContext.broadcast(packed)  # ANCHORS vectors

    def run(batches):
        for batch in batches:
            for ids, labels, q in _by_width(batch):
                if q.shape[1] in shared.value:
                    parts = [p for p in visit(*shared.value[q.shape[1]], ids, labels, q) if len(p[0])]
                    if parts:
                        yield _stack(parts)

    return rows.select("id", "label", "q").mapInArrow(run, "anchor long, target long, id long, score long")


def nearest(k: int):
    """The ``k`` best rows of an anchor's own label in a tile, but for the anchor itself."""

    def visit(anchor, label, vectors, asked, ids, labels, q):
        for some in _groups(label, len(ids)):
            own = np.flatnonzero(labels == label[some[0]])
            if not len(own):
                continue
            tile = Tile(vectors[some], ids[own], q[own])
            few = min(k + 1, tile.n)
            keys = np.sort(np.partition(tile.keys, few - 1, axis=1)[:, :few], axis=1)
            who = np.repeat(anchor[some], few)
            found, score = tile.rows(keys).ravel(), tile.scores(keys).ravel()
            other = found != who
            yield who[other], who[other], found[other], score[other]

    return visit


def below(k: int, lower: tuple[int, int], upper: tuple[int, int]):
    """The first ``k`` rows of other labels in a tile whose score is within the limits of each (positive, score) in ``asked``."""

    def visit(anchor, label, vectors, asked, ids, labels, q):
        for some in _groups(label, len(ids)):
            other = np.flatnonzero(labels != label[some[0]])
            if not len(other):
                continue
            tile = Tile(vectors[some], ids[other], q[other])
            tile.keys.sort(axis=1)
            for at, keys in zip(some, tile.keys, strict=True):
                if not asked[at]:
                    continue
                positive, score = (np.array(x, np.int64) for x in zip(*asked[at], strict=True))
                most, least = score * upper[0] // upper[1], -(-score * lower[0] // lower[1])
                first = np.searchsorted(keys, tile.from_score(most))
                place = first[:, None] + np.arange(k)
                read = keys[np.minimum(place, tile.n - 1)]
                good = (place < tile.n) & (tile.scores(read) >= least[:, None])
                target = np.repeat(positive, k).reshape(-1, k)[good]
                yield np.full(len(target), anchor[at]), target, tile.rows(read[good]), tile.scores(read[good])

    return visit


def hard_negatives(
    vectors: DataFrame, every: int, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding",
    positives: int = 5, k: int = 3, lower: tuple[int, int] = (50, 100), upper: tuple[int, int] = (95, 100),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, ids divisible by ``every``.

    An anchor's positives are its best rows of the same label; of each, the ``k`` best rows of other
    labels whose score is between the shares ``lower`` and ``upper`` of the positive's are returned.
    Higher scores come first, ties by smaller id. Rows without an id, with a null label or vector or a
    component that is null or not finite take no part; of rows that share an id, the one with the least
    label and then vector does; vectors of different widths do not meet. Components so
    large that a score could leave 62 bits raise OverflowError. An anchor without a positive, and
    a positive without such a row, give no row, and neither does an empty table. Other columns are ignored.
    """
    label = F.col("label") if label is None else label
    rows = materialise(usable(vectors, id_col, label, vector_col), "quantised")
    anchors = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-anchors.count() // ANCHORS))  # of an empty table too: it gives an empty result
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    first = Window.partitionBy("anchor", "target").orderBy(F.desc("score"), "id")
    found = []
    for b in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        block = own.withColumn("asked", F.array().cast("array<struct<id:long,score:long>>")).collect()  # about ANCHORS rows
        mine = _scan(rows, block, nearest(positives)).withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
        mine = materialise(mine.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score")), "positives")
        asked = mine.groupBy("anchor").agg(F.collect_list(F.struct(F.col("positive").alias("id"), F.col("positive_score").alias("score"))).alias("asked"))
        block = own.join(asked, own.id == asked.anchor).select("id", "label", "q", "asked").collect()
        ranked = _scan(rows, block, below(k, lower, upper)).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        of = ranked.join(mine, (ranked.anchor == mine.anchor) & (ranked.target == mine.positive)).select(ranked.anchor, "positive", "rank", "id", "positive_score", "score")
        found.append(materialise(of, "negatives"))
        discard(mine)
    discard(rows)
    named = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return union_all(found).toDF(*named)
