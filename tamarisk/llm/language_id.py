"""Language identification with a blended-spectrum string kernel.

The kernel of two windows of text is the mean, over n-gram lengths, of the cosine of their sets of
distinct character n-grams; a whole text is the mean of its windows, weighted by their length, so
that a passage in another language counts as much as it is long. Landmarks give a Nyström approximation, in which one-versus-rest kernel ridge
regression is solved on the driver from a bounded sample of labelled rows. The values of all
classes are linear in the kernels to the landmarks, and those are sparse-by-dense products with
the landmarks' presence matrix; as matrix products associate, that matrix is multiplied with the
ridge coefficients once, and each batch of texts is then one sparse-by-dense product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks

UNKNOWN = "und"
LENGTHS = (1, 2, 3)
WINDOW = 500
#: Character classes that a model may tell apart; rarer characters share the classes above KNOWN.
KNOWN, CLASSES = 200, 256
#: Windows of a labelled text that the model may be fitted on; texts are scored whole.
FIT_WINDOWS = 40


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))




def class_table(texts: list[str]) -> np.ndarray:
    """The class of each code point below 65,536: own classes for the commonest characters of ``texts``."""
    counts = np.zeros(65536, dtype=np.int64)
    for t in texts:
        found, n = np.unique(_points(t), return_counts=True)
        counts[found[found < 65536]] += n[found < 65536]
    table = (KNOWN + np.arange(65536) % (CLASSES - KNOWN)).astype(np.uint32)
    common = np.argsort(-counts, kind="stable")[: min(KNOWN, int((counts > 0).sum()))]
    table[common] = np.arange(len(common))
    return table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def ngrams(text: str, table: np.ndarray) -> list[np.ndarray]:
    """For each length: the distinct (window << 32 | n-gram code) of a whole text, sorted; the length is part of the code.

    An n-gram belongs to the window in which it starts.
    """
    points = _points(text)
    c = np.where(points < 65536, table[points & 65535], KNOWN + points % (CLASSES - KNOWN)).astype(np.uint64)
    window = (np.arange(len(c), dtype=np.uint64) // np.uint64(WINDOW)) << np.uint64(32)
    out, code = [], c
    for n in LENGTHS:
        if n > 1:
            code = code[: len(c) - n + 1] * np.uint64(CLASSES) + c[n - 1 :] if len(c) >= n else c[:0]
        out.append(_distinct(code | np.uint64(n << 24) | window[: len(code)]))
    return out


def _distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    return codes[np.concatenate(([True], codes[1:] != codes[:-1]))] if len(codes) else codes


def matches(text: str, table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text, with the weights that make their sum the mean over windows and lengths."""
    places, scales = [np.empty(0, np.intp)], [np.empty(0)]
    chars = len(_points(text))
    for keys in ngrams(text, table):
        if len(keys):
            window = (keys >> np.uint64(32)).astype(np.intp)
            size = np.minimum(WINDOW, chars - WINDOW * np.arange(window[-1] + 1))
            scale = size / chars / (len(LENGTHS) * np.sqrt(np.bincount(window)).clip(1))
            code = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            ok = codes[at] == code
            places.append(at[ok])
            scales.append(scale[window[ok]])
    return np.concatenate(places), np.concatenate(scales)


@dataclass
class Model:
    """``weights`` (features by classes) is presence times coefficients; ``codes`` are the sorted features."""

    table: np.ndarray
    codes: np.ndarray
    weights: np.ndarray
    langs: list[str]

    def values(self, texts: list[str]) -> np.ndarray:
        """Ridge values of every class for each text: one sparse-by-dense product for the batch."""
        found = [matches(t, self.table, self.codes) for t in texts]
        sizes = np.array([len(at) for at, _ in found])
        out = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(sizes)
        if len(full):
            at, scale = (np.concatenate(x) for x in zip(*(found[i] for i in full), strict=True))
            starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            out[full] = np.add.reduceat(self.weights[at] * scale[:, None], starts, axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.langs else []
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            values = self.values([texts[i] for i in known])
            best = values.argmax(axis=1)
            for i, k, v in zip(known, best, values[np.arange(len(best)), best], strict=True):
                langs[i], scores[i] = self.langs[k], float(min(1.0, max(0.0, v)))
        return langs, scores


def fit(texts: list[str], labels: list[str], landmarks: int = 64, ridge: float = 1e-3) -> Model:
    """Fits on the windows of labelled texts; landmarks are the first windows of the first texts of each label."""
    langs = sorted(set(labels))
    if not langs:
        return Model(np.zeros(65536, np.uint32), np.empty(0, np.uint32), np.empty((0, 0)), [])
    rows = [(t[i : i + WINDOW], x, i == 0) for t, x in zip(texts, labels, strict=True) for i in range(0, len(t), WINDOW)]
    seen: dict[str, int] = dict.fromkeys(langs, 0)
    chosen = []
    for k, (_, x, first) in enumerate(rows):
        if first and seen[x] < landmarks:
            seen[x] += 1
            chosen.append(k)
    table = class_table([rows[k][0] for k in chosen])
    marks = [[(g & np.uint64(0xFFFFFFFF)).astype(np.uint32) for g in ngrams(rows[k][0][:WINDOW], table)] for k in chosen]
    codes = np.unique(np.concatenate([g for m in marks for g in m]))
    presence = np.zeros((len(codes), len(chosen)))
    for j, m in enumerate(marks):
        for g in m:
            presence[np.searchsorted(codes, g), j] = 1 / np.sqrt(max(1, len(g)))
    kernel = np.zeros((len(rows), len(chosen)))
    for i, (t, _, _) in enumerate(rows):
        at, scale = matches(t, table, codes)
        kernel[i] = scale @ presence[at]
    target = np.array([[float(x == k) for k in langs] for _, x, _ in rows])
    left = kernel.T @ kernel + ridge * len(rows) * kernel[chosen] + 1e-8 * np.eye(len(chosen))
    return Model(table, codes, presence @ np.linalg.solve(left, kernel.T @ target), langs)


def sample_rows(docs: DataFrame, per_label: int, id_col: str, text_col: str, lang_col: str) -> list:
    """At most ``per_label`` labelled rows of each language, chosen by a hash of the id. Only ids are ranked."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = (
        docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label)
    )
    wanted = sorted({r.id for r in ids.select("id").collect()})
    if not wanted:
        return []
    rows = docs.where(F.col(id_col).isin(wanted)).select(F.col(id_col).alias("id"), F.substring(text_col, 1, WINDOW * FIT_WINDOWS).alias("text"), F.col(lang_col).alias("lang")).dropDuplicates(["id", "lang"]).collect()
    return sorted((r for r in rows if r.lang is not None and r.text), key=lambda r: (r.lang, r.id, r.text))


def learn(docs: DataFrame, per_label: int = 200, landmarks: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most ``per_label`` rows of each language of ``docs``, and ``FIT_WINDOWS`` windows of each."""
    rows = [r for r in sample_rows(docs, per_label, id_col, text_col, lang_col) if has_letter(r.text)]
    return fit([r.text for r in rows], [r.lang for r in rows], landmarks)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row's whole text; ``und`` and 0 without a letter.

    Rows with a null id are predicted like others. Repeated rows are repeated, other columns ignored,
    an empty table gives an empty result. Without any labelled row everything is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks' n-grams

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for a, b in chunks(batch.column(1), 1_000_000):
                found = shared.value.predict(batch.column(1)[a:b].to_pylist())
                langs += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
