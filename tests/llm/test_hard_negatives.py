import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.llm import hard_negatives as H
from tamarisk.llm import queries as llm

SCHEMA = "vec_id long, embedding array<float>, label int, id long, q string, anchor long, score double, r string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows, parts=3):
    """Rows (vec_id, embedding, label) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "x", 2, 0.5, "y") for r in rows], SCHEMA).repartition(parts)


def brute(rows, every, positives=5, k=3):
    """From the definition, with Python's integers."""
    real = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])]
    q: dict = {}
    for i, v, label in real:
        own = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        q[i] = min(own, q.get(i, own))
    out = []
    for a, (label, v) in q.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in q.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            good = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:k]
            out += [(a, p, rank, x[1], -s, -x[0]) for rank, x in enumerate(good, 1)]
    return sorted(out)


def got(spark, rows, every, **kw):
    return sorted(tuple(r) for r in H.hard_negatives(table(spark, rows), every, **kw).collect())


def cloud(n, width=8, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(0.3, 1, width)], int(rng.integers(labels))) for i in rng.permutation(n)]


def test_as_brute_force(spark):
    rows = cloud(400)
    want = brute(rows, 10)
    assert len(want) > 300 and got(spark, rows, 10) == want


@pytest.mark.parametrize("seed", range(3))
def test_ties(spark, seed):
    """Few distinct vectors: nearly all scores are tied, so ids decide."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(0, 3, 3)], int(rng.integers(3))) for i in range(200)]
    assert got(spark, rows, 5) == brute(rows, 5)


def test_small_tiles_and_blocks_change_nothing(spark, monkeypatch):
    rows = cloud(300, seed=2)
    want = brute(rows, 6)
    monkeypatch.setattr(H, "ANCHORS", 7)
    assert got(spark, rows, 6) == want
    ids, labels, q = (np.array(x) for x in zip(*[(i, c, v) for i, v, c in sorted(rows)], strict=True))
    monkeypatch.setattr(H, "SCORES", 300)
    assert max(len(g) for g in H._groups(labels, 100)) == 3


def test_hot_label_and_hot_vector(spark):
    """A third of all rows are one vector, and another third share a label."""
    rows = [(i, [0.5, 0.25, 1.0], i % 3) if i < 200 else (i, v, 0 if i < 400 else c) for (i, v, c) in cloud(600, 3, 3, seed=4)]
    assert got(spark, rows, 20) == brute(rows, 20)


def test_rows_that_take_no_part(spark):
    rows = cloud(60, 3, 2, seed=5) + [
        (None, [1.0, 1.0, 1.0], 0), (100, None, 0), (110, [1.0, None, 1.0], 0), (120, [NAN, 1.0, 1.0], 1), (130, [INF, 0.0, 0.0], 1),
        (140, [1.0, 2.0, 3.0], None), (150, [1.0, 2.0], 0), (151, [1.0, 1.0], 0), (152, [0.7, 0.7], 1), (160, [], 0), (161, [], 0), (162, [], 1),
        (10, [9.0, 9.0, 9.0], 1), (170, [0.0, 0.0, 0.0], 0), (-50, [1.0, 0.5, 0.25], 1),
    ]
    rows += rows[:20]
    want = brute(rows, 10)
    assert got(spark, rows, 10) == want
    assert {150, 160} <= {r[0] for r in want}  # vectors of other widths meet their like
    assert not {r[3] for r in want} & {100, 110, 120, 130, 140}


def test_negative_scores_have_no_negatives(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-0.7, 0.0], 1), (3, [0.0, 1.0], 0), (4, [0.0, 2.0], 1)]
    assert got(spark, rows, 50) == brute(rows, 50) == [(0, 3, 1, 4, 0, 0)]


def test_large_components(spark):
    """Scores beyond what a key holds, and beyond what doubles add exactly, are still exact; larger ones are refused."""
    rows = [(i, [x * 2.0**18 for x in v], c) for i, v, c in cloud(80, 3, 2, seed=6)]
    assert got(spark, rows, 10) == brute(rows, 10)
    with pytest.raises(Exception, match="too large"):
        got(spark, [(i, [x * 2.0**40 for x in v], c) for i, v, c in rows], 10)


def test_empty(spark):
    assert got(spark, [], 10) == []
    assert H.hard_negatives(table(spark, []), 10).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(spark, [(50, [1.0], 1)], 50) == []


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label if r.vec_id % 7 else (r.label + 1) % 10) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = llm.op12_hard_negatives(spark, sf)
    assert dict(found.dtypes)["rank"] == "int"
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 50)


def test_quantised(spark):
    row = spark.createDataFrame([([0.1, -0.1, 1.0, -0.00390625],)], "v array<float>").select(H.quantised(F.col("v")).alias("q")).first()
    assert row.q == [math.floor(256 * float(np.float32(x))) for x in (0.1, -0.1, 1.0, -0.00390625)]
