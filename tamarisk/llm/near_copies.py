"""Near copies of documents down to a Jaccard similarity of their word shingles.

Documents within three bits of a 64-bit SimHash are linked as in ``simhash_dedup``. That reaches
nearly equal texts only; so documents that share one of 20 bands of four MinHash values each are
compared by a 128-bit SimHash with a budget that pairs of the required similarity keep to, and then
by their shingles themselves. A pair at 0.8 shares a band with a probability of 0.99997.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, materialise, mix64, word_hashes
from .components import connected_components
from .line_dedup import SALT, candidates, deal_out, linked
from .simhash_dedup import fingerprints, majority, near_components, one_of_each, text_key

BANDS, BAND_ROWS, BAND_BITS = 20, 4, 26
#: Bits of 128 in which a pair may differ: at similarity 0.8 about 19 do, with a deviation of 4.
BUDGET = 40


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each text, text by text, and their number; a shorter text is one shingle."""
    words, _, counts = word_hashes(texts)
    found, at = [], 0
    for n in counts.tolist():
        own, at = words[at : at + n], at + n
        if not n:
            found.append(own)
            continue
        k = min(width, n)
        total = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            total = mix64(total + own[i : n - k + 1 + i])
        found.append(np.unique(total))
    return np.concatenate(found) if found else words, np.array([len(x) for x in found], dtype=np.int64)


def _bands(shingles: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each band: its value of each set, band number included."""
    draw = np.random.default_rng(9).integers(0, 2**63, (BANDS, BAND_ROWS, 2), dtype=np.uint64)
    out = []
    for band in range(BANDS):
        value = np.zeros(len(starts), dtype=np.uint64)
        for a, b in draw[band]:
            value = mix64(value + np.minimum.reduceat((shingles ^ b) * (a | np.uint64(1)), starts))
        out.append((value >> np.uint64(64 - BAND_BITS)).astype(np.int64) + (band << BAND_BITS))
    return out


def prints_of(rows: DataFrame, width: int) -> DataFrame:
    """(id, h, s0, s1, bands) of every text of ``rows`` (id, h, text) that has a word."""

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch.column(2), 1_000_000):
                shingles, counts = shingle_sets([t.as_py() or b"" for t in batch.column(2)[a:b]], width)
                full = np.flatnonzero(counts)
                if not len(full):
                    continue
                n = counts[full]
                bands = np.stack(_bands(shingles, np.cumsum(n) - n), axis=1)
                s0, s1 = majority(shingles, n), majority(mix64(shingles ^ SALT), n)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b].take(pa.array(full)), batch.column(1)[a:b].take(pa.array(full)), pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64)), values],
                    names=["id", "h", "s0", "s1", "bands"],
                )

    return rows.select("id", "h", F.col("text").cast("binary")).mapInArrow(run, "id long, h long, s0 long, s1 long, bands array<long>")


def near_roots(rows: DataFrame, width: int = 5, least: float = 0.8, small: int = 32, limit: int = 8192) -> DataFrame:
    """(node, root): the components of texts (id, h, text) whose shingles have a similarity of ``least``; nodes are h."""
    prints = materialise(prints_of(rows, width), "prints")
    distinct = materialise(prints.groupBy("h").agg(*(F.first(c).alias(c) for c in ("s0", "s1", "bands"))), "distinct")
    discard(prints)
    found = materialise(candidates(deal_out(distinct, F.col("bands"), limit), BUDGET, small, distinct.count() * BANDS), "candidates")

    def alike(x: bytes, y: bytes) -> bool:
        shingles, (n, m) = shingle_sets([x, y], width)
        both = len(np.intersect1d(shingles[:n], shingles[n:], assume_unique=True))
        return both >= least * (n + m - both)

    return linked(found, rows.select("h", F.col("text").cast("binary").alias("text")), alike, BUDGET)


def near_dedup(docs: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, by SimHash or by shingles: the one with the smallest id (null last).

    Rows are told apart by id and text; those that are equal in both share one fate.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    bits = near_components(materialise(fingerprints(rows, width, id_col="h"), "bits"))
    near = near_roots(rows, width, least)
    links = bits.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).unionByName(near.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return one_of_each(docs, connected_components(links), id_col, text_col)
