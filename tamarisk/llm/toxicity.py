"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digit and symbol substitutions, punctuation, zero-width
characters) and scanned once by an Aho-Corasick automaton whose patterns are lexicon entries at word
starts and exception phrases. Hits inside an exception phrase don't count. The sum of the weights,
normalised by a power of the length, goes through a logistic function. Lexicon, weights, exceptions
and calibration are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks, local_table, materialise, word_hashes

# Characters that look like a Latin letter, and digits and symbols used for one.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Characters of the longest lexicon entry.
ENTRY = 40
INVISIBLE = "​‌‍⁠﻿­"


class _Fold(dict):
    """What each character folds to, worked out when it is first met: compatibility forms and letters with marks to plain ones, marks to nothing."""

    def __missing__(self, point: int) -> str | None:
        c = chr(point)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if unicodedata.combining(c):
            found = None
        elif not c.isalnum():
            found = " "
        elif plain.isalnum():
            found = "".join(LOOKALIKES.get(x, x) for x in plain)
        else:
            found = c
        self[point] = found
        return found


LOOKALIKES = HOMOGLYPHS | SUBSTITUTES
FOLD = _Fold({ord(k): v for k, v in LOOKALIKES.items()} | {ord(k): None for k in INVISIBLE})


def fold(text: str) -> str:
    """Folded words with one space before and after each."""
    return f" {' '.join(text.lower().translate(FOLD).split())} "


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # folded entry, with a space before (and after, for whole words)
    exceptions: list[str] = field(default_factory=list)  # folded phrases with a space before and after
    power: float = 0.5
    intercept: float = -10.0
    slope: float = 1.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found: dict[str, list] = {k: [w, False] for k, w in self.weights.items()}
        for phrase in self.exceptions:
            found.setdefault(phrase, [0.0, False])[1] = True
        if not found:
            return None
        made = ahocorasick.Automaton()
        for k, (w, exempt) in found.items():
            made.add_word(k, (len(k), w, exempt))
        made.make_automaton()
        return made

    def probability(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = self.intercept + self.slope * total / np.maximum(words, 1) ** self.power
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def hits(text: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) in the folded text of every hit outside exception phrases.

    Of hits at one word start only the heaviest counts.
    """
    best: dict[int, tuple[int, float]] = {}
    exempt: list[tuple[int, int]] = []
    for end, (size, weight, exception) in automaton.iter(text):
        start = end - size + 1
        if exception:
            exempt.append((start, end))
        if weight and weight > best.get(start, (0, 0.0))[1]:
            best[start] = (end, weight)
    if exempt and best:
        exempt.sort()
        starts = np.array([s for s, _ in exempt])
        reach = np.maximum.accumulate(np.array([e for _, e in exempt]))
        for start in list(best):
            k = int(np.searchsorted(starts, start, side="right")) - 1
            if k >= 0 and reach[k] >= best[start][0] - 1:
                del best[start]
    return [(s, e, w) for s, (e, w) in sorted(best.items())]


def score_texts(texts: list[str | None], automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of weights, number of hits and number of words of each whole text."""
    total, count, words = (np.zeros(len(texts)) for _ in range(3))
    for i, t in enumerate(texts):
        folded = fold(t or "")
        words[i] = max(0, folded.count(" ") - 1)
        if automaton is not None:
            found = hits(folded, automaton)
            total[i], count[i] = sum(w for _, _, w in found), len(found)
    return total, count, words


def _first_prints(texts) -> list[int]:
    """The least 5-word shingle hash of each text: equal for most near copies."""
    out = []
    for t in texts:
        h, _, _ = word_hashes([t.as_py() or b""])
        if len(h) > 4:
            h = h[:-4] * np.uint64(3) + h[1:-3] * np.uint64(5) + h[2:-2] * np.uint64(7) + h[3:-1] * np.uint64(11) + h[4:] * np.uint64(13)
        out.append(int(h.min() >> np.uint64(1)) if len(h) else 0)
    return out


def sample_rows(docs: DataFrame, labels: DataFrame, toxic: int, clean: int, id_col: str, text_col: str) -> DataFrame:
    """(text, label): at most ``toxic`` and ``clean`` labelled rows, chosen by a hash of the id, without near copies."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), (F.col("toxic") >= 1).cast("int").alias("label"))
    order = (F.xxhash64("id"), F.col("id"))
    ids: dict = {}
    for value, most in ((0, clean), (1, toxic)):
        ids.update((r.id, value) for r in known.where(F.col("label") == value).orderBy(*order).limit(most).collect())
    wanted = local_table(docs.sparkSession, list(ids.items()), "id long, label int")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows = rows.join(F.broadcast(wanted), "id").select("text", "label")  # toxic + clean rows at most

    def prints(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_first_prints(b.column(0).cast(pa.binary())), pa.int64())], names=["text", "label", "print"])

    return materialise(rows.mapInArrow(prints, "text string, label int, print long").dropDuplicates(["print", "label"]), "labelled").select("text", "label")


def _prefixes(batches, shortest: int):
    """(entry, n): the number of texts in which each word prefix of at least ``shortest`` characters occurs."""
    counts: Counter = Counter()
    for b in batches:
        for t in b.column(0):
            found = set()
            for w in set(fold(t.as_py()).split()):
                w = f" {w} " if len(w) <= ENTRY else f" {w[:ENTRY]}"  # of a longer word only prefixes, which don't end it
                found.update(w[:k] for k in range(min(shortest + 1, len(w)), len(w) + 1))
            counts.update(found)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["entry", "n"])


def _passing(toxic: int, clean: int, evidence: float, precision: float):
    """The condition of ``select_entries`` on columns t and c, a hair wider than its floating-point numbers."""
    t, c, e, prior = F.col("t"), F.col("c"), 1e-12, toxic / (toxic + clean)
    share = t / toxic / (t / toxic + c / clean)
    g = 2 * (t * F.log((t + e) / ((t + c) * prior)) + c * F.log((c + e) / ((t + c) * (1 - prior))))
    return (share >= precision - 1e-9) & (g >= evidence - 1e-6)


def select_entries(counts: dict[str, tuple[int, int]], toxic: int, clean: int, evidence: float, precision: float) -> dict[str, float]:
    """The lexicon: the shortest prefixes that are precise and well evidenced, lengthened as long as they lose no text."""
    good: dict[str, float] = {}
    prior = toxic / (toxic + clean)
    for k, (t, c) in counts.items():
        share = t / toxic / (t / toxic + c / clean) if clean else 1.0
        n, e = t + c, 1e-12
        g = 2 * (t * np.log((t + e) / (n * prior)) + c * np.log((c + e) / (n * (1 - prior)))) if 0 < prior < 1 else 0
        if share >= precision and g >= evidence:
            good[k] = float(np.log((t + 0.5) / (toxic - t + 0.5)) - np.log((c + 0.5) / (clean - c + 0.5)))
    longer: dict[str, list[str]] = {}
    for k in good:
        longer.setdefault(k[:-1], []).append(k)
    chosen: dict[str, float] = {}
    for k in sorted(good, key=len):
        if any(k[:i] in chosen for i in range(2, len(k) + 1)) or k[:-1] in good:
            continue
        while nxt := max((x for x in longer.get(k, ()) if counts[x][0] >= 0.9 * counts[k][0]), key=lambda x: counts[x][0], default=None):
            k = nxt
        chosen[k] = good[k]
    return chosen


def calibrate(model: Model, total: np.ndarray, words: np.ndarray, label: np.ndarray) -> Model:
    """The power of the length and the logistic's coefficients with the least regularised loss."""
    best = None
    for power in (0.25, 0.5, 0.75):
        x = total / np.maximum(words, 1) ** power
        scale = x.std() or 1.0
        a, b = -1.0, 1.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a + b * x / scale, -40, 40)))
            r, q = p - label, np.maximum(p * (1 - p), 1e-9)
            grad = np.array([r.sum() + 0.01 * a, (r * x / scale).sum() + 0.01 * b])
            hess = np.array([[q.sum() + 0.01, (q * x / scale).sum()], [(q * x / scale).sum(), (q * (x / scale) ** 2).sum() + 0.01]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0] / max(1, abs(step).max() / 2), b - step[1] / max(1, abs(step).max() / 2)
        p = np.clip(1 / (1 + np.exp(-np.clip(a + b * x / scale, -40, 40))), 1e-12, 1 - 1e-12)
        loss = -(label * np.log(p) + (1 - label) * np.log(1 - p)).sum()
        if best is None or loss < best[0]:
            best = (loss, power, float(a), float(b / scale))
    return Model(model.weights, model.exceptions, *best[1:])


def learn(docs: DataFrame, labels: DataFrame, toxic: int = 3000, clean: int = 9000, shortest: int = 3,
          evidence: float = 22.0, precision: float = 0.98, exceptions: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most ``toxic`` and ``clean`` labelled rows; only entries of enough precision and evidence reach the driver.

    Without labelled rows of both kinds, every text gets the same score: 1 if there are toxic rows only, else 0.
    """
    sample = sample_rows(docs, labels, toxic, clean, id_col, text_col)
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not n.get(1) or not n.get(0):
        return Model(intercept=40.0 if n.get(1) else -40.0)

    def counted(label: int, name: str) -> DataFrame:
        return sample.where(F.col("label") == label).mapInArrow(lambda b: _prefixes(b, shortest), "entry string, n long").groupBy("entry").agg(F.sum("n").alias(name))

    both = counted(1, "t").where("t >= 3").join(counted(0, "c"), "entry", "left").select("entry", "t", F.coalesce("c", F.lit(0)).alias("c"))
    weights = select_entries({r.entry: (r.t, r.c) for r in both.where(_passing(n[1], n[0], evidence, precision)).collect()}, n[1], n[0], evidence, precision)
    known = [fold(x) for x in exceptions]
    model = Model(weights, known + _learn_exceptions(sample, Model(weights, known)))

    def scored(batches):
        automaton = model.automaton()
        for b in batches:
            total, _, words = score_texts(b.column(0).to_pylist(), automaton)
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(words), b.column(1)], names=["total", "words", "label"])

    fitted = sample.mapInArrow(scored, "total double, words double, label int").toPandas()
    fitted = fitted.sort_values(["label", "total", "words"])
    return calibrate(model, fitted.total.to_numpy(), fitted.words.to_numpy(), fitted.label.to_numpy(dtype=float))


def _learn_exceptions(sample: DataFrame, model: Model) -> list[str]:
    """Two-word phrases around a hit that several clean texts of the sample have and no toxic one."""

    def phrases(batches):
        automaton, seen = model.automaton(), Counter()
        for b in batches:
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded, own = fold(t), set()
                for start, end, _ in hits(folded, automaton) if automaton is not None else ():
                    stop = folded.index(" ", end) if folded[end] != " " else end
                    before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
                    own.update([folded[before : stop + 1]] if before >= 0 else [])
                    own.update([folded[start : after + 1]] if after > 0 else [])
                seen.update((p, label) for p in own)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in seen]), pa.array([x for _, x in seen], pa.int32()), pa.array(seen.values(), pa.int64())], names=["phrase", "label", "n"]
            )

    counted = sample.mapInArrow(phrases, "phrase string, label int, n long").groupBy("phrase").pivot("label", [0, 1]).sum("n")
    return sorted(r.phrase for r in counted.where("`0` >= 3 AND coalesce(`1`, 0) = 0").collect())  # bounded by the sample


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if the score is at least 0.5), hits of every row's whole text.

    Null text counts as empty and is scored by the intercept alone. Rows with a null id are scored
    like others. Repeated rows are repeated, other columns ignored; an empty table gives an empty result.
    """

    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            score, hit = [np.empty(0)], [np.empty(0)]
            for a, b in chunks(batch.column(1), 1_000_000):
                total, count, words = score_texts(batch.column(1)[a:b].to_pylist(), automaton)
                score.append(model.probability(total, words))
                hit.append(count)
            p = np.concatenate(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(np.concatenate(hit).astype(np.int64))],
                names=["doc_id", "score", "predicted", "hits"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, hits long")


def is_toxic(model: Model, text: Column) -> Column:
    """Whether a whole text is predicted toxic."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = model.automaton()
        for texts in batches:
            found = [np.empty(0, bool)]
            for a, b in chunks(texts, 1_000_000):
                total, _, words = score_texts(texts[a:b].to_pylist(), automaton)
                found.append(model.probability(total, words) >= 0.5)
            yield pa.array(np.concatenate(found))

    return arrow_udf(run, "boolean")(text.cast("string"))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents predicted toxic. Every row is decided by its own text, so nothing is shuffled; null counts as empty."""
    return docs.where(~is_toxic(model, F.col(text_col)))
