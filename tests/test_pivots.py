"""Pivot search against the full scan: same rows, fewer products where vectors are clustered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.operators import pivots as P
from tamarisk.operators.dense import search_top_k
from tamarisk.sources.store import Scratch

V, Q = "id long, v array<double>", "qid long, q array<double>"


@pytest.fixture
def keep(spark, tmp_path):
    return Scratch(spark, str(tmp_path)).keep


def clustered(n, centres=20, width=16, spread=0.05, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    return (c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, width))).tolist()


def rows(found):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in found.collect())


def both(spark, keep, vectors, questions, k=4, floor=-2.0):
    v, q = spark.createDataFrame(vectors, V), spark.createDataFrame(questions, Q)
    index = P.PivotIndex.build(v, keep)
    got = rows(index.top_k(q, keep, k, floor, digits=6))
    assert got == rows(search_top_k(q, v, k, floor, digits=6))
    return index, q, got


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_same_as_the_full_scan(spark, keep, spread):
    vectors = list(enumerate(clustered(900, spread=spread)))
    _, _, got = both(spark, keep, vectors, list(enumerate(clustered(40, spread=spread)))[:25], 5)
    assert len(got) == 125


def test_ties_zeros_and_few_vectors(spark, keep):
    vectors = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(100, [0.0, 0.0, 0.0]), (101, [-1.0, 0.0, 0.0]), (102, [0.0, 2.0, 0.0])]
    questions = [(1, [2.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [-1.0, -1.0, 0.0])]
    both(spark, keep, vectors, questions, 3)
    both(spark, keep, vectors[-3:], questions, 10)
    both(spark, keep, vectors, questions, 70)


def test_threshold_and_small_blocks(spark, keep, monkeypatch):
    monkeypatch.setattr(P, "QUESTIONS", 4)
    monkeypatch.setattr(P, "VECTOR_BLOCK", 7)
    vectors = list(enumerate(clustered(200)))
    _, _, got = both(spark, keep, vectors, vectors[:15], 6, 0.9)
    assert got and all(s >= 0.9 for *_, s in got)


def test_nulls_and_empty_tables(spark, keep):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], V)
    q = spark.createDataFrame([(1, [1.0, 1.0]), (None, [1.0, 0.0]), (2, None)], Q)
    assert [r.id for r in P.PivotIndex.build(v, keep).top_k(q, keep, 3).collect()] == [1]
    assert P.PivotIndex.build(v.limit(0), keep).top_k(q, keep, 3).count() == 0
    assert P.PivotIndex.build(v, keep).top_k(q.limit(0), keep, 3).count() == 0


def test_widths(spark, keep):
    v = spark.createDataFrame([(1, [1.0, 0.0])], V)
    with pytest.raises(ValueError, match="mismatch"):
        P.PivotIndex.build(v, keep).top_k(spark.createDataFrame([(1, [1.0])], Q), keep, 3)
    with pytest.raises(ValueError, match="widths"):
        P.PivotIndex.build(v.unionByName(spark.createDataFrame([(2, [1.0])], V)), keep)


def test_products_fall(spark, keep):
    """Of clustered vectors a small share meets a question, and only cells that matter are in the scan."""
    vectors = list(enumerate(clustered(4000, centres=40)))
    index, q, _ = both(spark, keep, vectors, vectors[:30], 4)
    found = index.search(q, keep, 4)
    share = found.agg(F.sum("read")).first()[0] / (4000 * 30)
    assert share < 0.35
    one = index.search(q.limit(1), keep, 4)
    assert one.agg(F.sum("read")).first()[0] / 4000 < 0.35
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PushedFilters")[1].split("]")[0]
