"""Search by blocks against the full search: same rows, fewer postings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.operators import block_max as B
from tamarisk.operators.lexical import BM25Index
from tamarisk.sources.store import Scratch


def corpus(spark, n, seed=0, step=1):
    """Documents of common words and of rare ones that go with ranges of ids."""
    rng = np.random.default_rng(seed)
    rows = [(int(i * step), " ".join([f"ortak{x}" for x in rng.zipf(1.5, 12) % 40] + [f"konu{i // 100}x{x}" for x in rng.integers(0, 9, 3)])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.fixture
def build(spark, tmp_path):
    def make(docs):
        scratch = Scratch(spark, str(tmp_path))
        bm25 = BM25Index.build(docs, "id", F.col("text"), scratch.keep)
        return bm25, B.BlockMaxIndex.build(bm25, f"{scratch.path}/index", scratch.keep)

    return make


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid long, question string")


def rows(found):
    return sorted((r.qid, r["rank"], r.id, r.score) for r in found.collect())


QUESTIONS = ("ortak1 konu3x2 konu3x4", "ortak1 ortak2 ortak1", "konu7x1", "yok", "", "ortak5 ortak6 konu11x3 konu11x5 ortak1", "ortak1")


@pytest.mark.parametrize("step", [1, 1_000_003])
def test_same_as_the_full_search(spark, build, step):
    bm25, blocks = build(corpus(spark, 1500, step=step))
    asked = ask(spark, *QUESTIONS)
    for k in (1, 7):
        want = B.top(bm25.scores(asked, "qid", F.col("question")).withColumn("score", F.round("score", 6)).where("score > 0"), k)
        assert rows(blocks.top_k(asked, "qid", F.col("question"), k, digits=6)) == rows(want)


def test_ties_and_few_documents(spark, build):
    """All documents alike, over many blocks: the least ids win; fewer than k documents are all returned."""
    bm25, blocks = build(spark.createDataFrame([(i, "kedi uyur") for i in range(-300, 300)] + [(900, "kahve"), (901, None)], "id long, text string"))
    got = rows(blocks.top_k(ask(spark, "kedi", "kahve"), "qid", F.col("question"), 3, digits=6))
    assert [r[2] for r in got] == [-300, -299, -298, 900]


def test_nothing_to_search(spark, build):
    _, blocks = build(spark.createDataFrame([(1, "")], "id long, text string"))
    assert rows(blocks.top_k(ask(spark, "kedi"), "qid", F.col("question"), 3)) == []
    _, blocks = build(spark.createDataFrame([], "id long, text string"))
    assert rows(blocks.top_k(ask(spark, "kedi"), "qid", F.col("question"), 3)) == []


def test_postings_read_fall(spark, build):
    """Questions with a rare word read a small part of the postings of their terms, and a smaller one as the corpus grows."""
    asked, share = ask(spark, "ortak1 konu3x2 konu3x4", "ortak1 ortak2 konu5x1 konu5x2"), []
    for n in (800, 3200):
        bm25, blocks = build(corpus(spark, n))
        terms = bm25.postings.join(blocks._asked(asked, "qid", F.col("question")), "term").count()
        share.append(blocks.survivors(asked, "qid", F.col("question"), 3)[0].count() / terms)
    assert share[0] < 0.5 and share[1] < 0.6 * share[0]


def test_hot_terms_are_dealt_out(spark, build, monkeypatch):
    monkeypatch.setattr(B, "SALTED", 2)
    bm25, blocks = build(corpus(spark, 600, step=1 << 11))
    assert blocks.terms.agg(F.max("salts")).first()[0] > 5
    asked = ask(spark, *QUESTIONS)
    want = B.top(bm25.scores(asked, "qid", F.col("question")).withColumn("score", F.round("score", 6)).where("score > 0"), 5)
    assert rows(blocks.top_k(asked, "qid", F.col("question"), 5, digits=6)) == rows(want)


def test_plan_leaves_the_index_where_it_is(spark, build):
    """Joins with the index on its keys shuffle the asked terms, not the index."""
    _, blocks = build(corpus(spark, 300))
    asked = blocks._asked(ask(spark, *QUESTIONS), "qid", F.col("question"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = blocks._postings(asked, blocks._blocks(asked, blocks._ranges(asked)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = [line for line in plan.splitlines() if "FileScan" in line and "postings" in line]
    assert scans and all("Bucketed: true" in line for line in scans)
