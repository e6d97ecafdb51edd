"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Raking scales the cells in turn to the target
share of each source, language and topic; the inclusion probability of a cell is proportional to
its raked weight over its tokens, capped at 1 with the excess given to the other cells, so that
the expected sample has the wanted number of tokens. Documents are then sampled by a hash of
their id, which makes the sample repeatable and independent of partitioning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, local_table, materialise

DIMENSIONS = ("source", "lang", "topic")
#: Up to this many cells raking is done on the driver and cells are broadcast; beyond it both are distributed.
DRIVER_CELLS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content_topic(text: Column) -> Column:
    """A coarse topic of a whole text, from what it contains; null text counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(F.contains(low, F.lit("@")) | F.contains(low, F.lit("://")), "contact")
        .when(F.contains(low, F.lit("licen")) | F.contains(low, F.lit("copyright")), "legal")
        .when(low.rlike("[0-9]"), "numeric")
        .otherwise("prose")
    )


def uniform(id_col: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) for each id: 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _tempered(cells, dimension: str, alpha: float):
    total = cells.groupby(dimension, dropna=False).tokens.sum()
    weight = np.where(total > 0, total.astype(float) ** alpha, 0.0)
    return dict(zip(total.index, weight / max(weight.sum(), 1e-300), strict=True))


def _cap(ratio: np.ndarray, weight: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """min(1, x * ratio) with x such that the expected tokens are the budget."""
    order = np.argsort(-ratio, kind="stable")
    t, w, r = tokens[order], weight[order], ratio[order]
    t_before = np.cumsum(t) - t
    w_left = np.maximum(np.cumsum(w[::-1])[::-1], 1e-300)
    x = np.maximum(budget - t_before, 0.0) / w_left
    free = np.flatnonzero(x * r <= 1)
    return np.minimum(1.0, (x[free[0]] if len(free) else np.inf) * ratio)


def rake_local(cells, fraction: float, alpha: float, rounds: int, targets: dict | None = None):
    """Adds the inclusion probability ``p`` to a pandas table of cells (source, lang, topic, tokens).

    ``targets`` gives, for any dimension, shares by value; a dimension without them gets its own
    shares raised to ``alpha``. A value without a share gets none; cells without tokens get p = 1.
    """
    cells = cells.copy()
    t = cells.tokens.to_numpy(dtype=float)
    if t.sum() <= 0:
        cells["p"] = 1.0
        return cells
    w = t / t.sum()
    goals, places = [], []
    for d in DIMENSIONS:
        shares = (targets or {}).get(d) or _tempered(cells, d, alpha)
        codes, values = cells[d].factorize(use_na_sentinel=False)
        missing = next((v for k, v in shares.items() if k is None or k != k), 0.0)
        goals.append(np.array([missing if v is None or v != v else shares.get(v, 0.0) for v in values], dtype=float))
        places.append(codes)
    for _ in range(rounds):
        for goal, place in zip(goals, places, strict=True):
            have = np.bincount(place, weights=w, minlength=len(goal))
            w = w * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[place]
    ratio = np.divide(w, t, out=np.zeros_like(w), where=t > 0)
    cells["p"] = np.where(t > 0, _cap(ratio, w, t, fraction * t.sum()), 1.0)
    return cells


def rake_distributed(cells: DataFrame, fraction: float, alpha: float, rounds: int) -> DataFrame:
    """The same for a DataFrame of cells: every scaling is a grouped sum joined back, written and read again."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("p", F.lit(1.0))
    now = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    goals = {}
    for d in DIMENSIONS:
        share = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("t")).select(F.col(d).alias("k"), F.pow("t", F.lit(alpha)).alias("goal"))
        norm = share.agg(F.sum("goal")).first()[0]
        goals[d] = share.withColumn("goal", F.col("goal") / norm)
    for _ in range(rounds):
        for d in DIMENSIONS:
            have = now.groupBy(F.col(d).alias("k")).agg(F.sum("w").alias("have")).join(goals[d].withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")))
            have = have.select("k", F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("f"))
            now = now.join(have, F.col(d).eqNullSafe(F.col("k"))).withColumn("w", F.col("w") * F.col("f")).drop("k", "f")
            now = materialise(now, "raked")  # each scaling reads the last one twice
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    now = now.withColumn("r", ratio)
    # the scale at which the expected tokens meet the budget, by bisection over grouped sums
    low, high = 0.0, 1.0
    spent = lambda x: now.agg(F.sum(F.least(F.lit(1.0), F.col("r") * x) * F.col("tokens"))).first()[0]
    while spent(high) < fraction * total and high < 1e300:
        high *= 16
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if spent(middle) < fraction * total else (low, middle)
    return now.withColumn("p", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("r") * high)).otherwise(1.0)).drop("w", "r")


def cell_probabilities(cells: DataFrame, fraction: float, alpha: float, rounds: int, targets: dict | None = None) -> tuple[DataFrame, bool]:
    """(source, lang, topic, p) and whether it is small enough to broadcast."""
    cells = materialise(cells, "cells")
    small = cells.count() <= DRIVER_CELLS
    if not small and targets is None:
        return rake_distributed(cells, fraction, alpha, rounds).select(*DIMENSIONS, "p"), False
    local = cells.toPandas().sort_values(list(DIMENSIONS), na_position="last", kind="stable")
    done = rake_local(local, fraction, alpha, rounds, targets)
    rows = [tuple(None if v is None or v != v else v for v in r) for r in done[[*DIMENSIONS, "p"]].itertuples(index=False)]
    out = local_table(cells.sparkSession, rows, "source string, lang string, topic string, p double")
    discard(cells)
    return out, small


def _with_p(rows: DataFrame, p: DataFrame, small: bool, keys: dict[str, str]) -> DataFrame:
    p = p.select(*(F.col(d).alias(f"__{d}") for d in DIMENSIONS), "p")
    match = [F.col(keys[d]).eqNullSafe(F.col(f"__{d}")) for d in DIMENSIONS]
    joined = rows.join(F.broadcast(p) if small else p, match[0] & match[1] & match[2])
    return joined.drop(*(f"__{d}" for d in DIMENSIONS))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        (content_topic(text) if topic is None else topic).alias("topic"), n_words(text).alias("n_tokens"),
    )


def mix(docs: DataFrame, fraction: float = 0.5, alpha: float = 0.5, rounds: int = 50, seed: int = 17, targets: dict | None = None,
        id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, probability, sampled.

    ``fraction`` is the share of the corpus' tokens to sample. Null sources, languages and texts are
    values of their own (null text: no token, kept). Rows with equal ids share one fate. Columns
    beyond those named are ignored; an empty table gives an empty result.
    """
    rows = materialise(describe(docs, id_col, text_col, topic), "described")
    p, small = cell_probabilities(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), fraction, alpha, rounds, targets)
    out = _with_p(rows, p, small, {d: d for d in DIMENSIONS})
    return out.select("doc_id", *DIMENSIONS, "n_tokens", F.round("p", 9).alias("probability"), (uniform(F.col("doc_id"), seed) < F.round("p", 9)).alias("sampled"))


def sample_mix(docs: DataFrame, fraction: float = 0.5, alpha: float = 0.5, rounds: int = 50, seed: int = 17, targets: dict | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled rows of ``docs`` with all their columns. Ids decide; texts are not shuffled."""
    rows = materialise(describe(docs, id_col, text_col), "described")
    p, small = cell_probabilities(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), fraction, alpha, rounds, targets)
    discard(rows)
    columns = docs.columns
    topic, share, *keys = (fresh(docs, name) for name in ("topic", "share", *DIMENSIONS))
    marked = docs.withColumn(topic, content_topic(F.col(text_col).cast("string")))
    p = p.select(*(F.col(d).alias(k) for d, k in zip(DIMENSIONS, keys, strict=True)), F.col("p").alias(share))
    own = (F.col("source").cast("string"), F.col("lang").cast("string"), F.col(topic))
    match = [a.eqNullSafe(F.col(k)) for a, k in zip(own, keys, strict=True)]
    kept = marked.join(F.broadcast(p) if small else p, match[0] & match[1] & match[2]).where(uniform(F.col(id_col), seed) < F.round(share, 9))
    return kept.select(*columns)
