"""Scores of the block search: made once in the task of a range, not once for each question that asks."""

import re

import pytest
from pyspark.sql import functions as F

from tamarisk.operators import block_max as B
from tamarisk.operators.lexical import BM25Index

from .test_block_max import QUESTIONS, ask, build, corpus, rows  # noqa: F401


def test_no_posting_is_shuffled_for_a_question(spark, build):  # noqa: F811
    _, blocks = build(corpus(spark, 300))
    plan = blocks.top_k(ask(spark, *QUESTIONS), "qid", F.col("question"), 3)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(qid#\d+L?, id#", plan) and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize(("cells", "full"), [(1, 1), (700, 3), (1 << 20, 50)])
def test_portions_of_questions_and_ranges(spark, build, monkeypatch, cells, full):  # noqa: F811
    """Whatever is scored together, the rows are those of the full search; repeated terms count again."""
    monkeypatch.setattr(B, "CELLS", cells)
    bm25, blocks = build(corpus(spark, 400, step=1000))
    blocks.full = full
    asked = ask(spark, *QUESTIONS)
    want = B.top(bm25.scores(asked, "qid", F.col("question")).withColumn("score", F.round("score", 6)).where("score > 0"), 4)
    assert rows(blocks.top_k(asked, "qid", F.col("question"), 4, digits=6)) == rows(want)


def test_index_of_the_asked_terms(spark, tmp_path):
    from tamarisk.sources.store import Scratch

    scratch, docs = Scratch(spark, str(tmp_path)), corpus(spark, 300)
    asked = ask(spark, "ortak1 konu1x2", "yok", "konu2x4 ortak3")
    bm25 = BM25Index.build(docs, "id", F.col("text"), scratch.keep, asked)
    blocks = B.BlockMaxIndex.build(bm25, f"{scratch.path}/index", scratch.keep)
    assert {r.term for r in blocks.rows.select("term").collect()} == {"ortak1", "konu1x2", "konu2x4", "ortak3"}
    read = blocks.rows.select(F.inline("postings")).groupBy("block").agg(F.max("impact").alias("top")).count()
    assert read == blocks.rows.select(F.inline("tops")).select("block").distinct().count()
    worst = blocks.rows.select(F.explode("tops").alias("t"), "postings").select("t", F.array_max(F.transform(F.filter("postings", lambda p: p["block"] == F.col("t.block")), lambda p: p["impact"])).alias("m")).where("m <> t.top OR m IS NULL")
    assert worst.count() == 0
    want = B.top(BM25Index.build(docs, "id", F.col("text")).scores(asked, "qid", F.col("question")).withColumn("score", F.round("score", 6)).where("score > 0"), 5)
    assert rows(blocks.top_k(asked, "qid", F.col("question"), 5, digits=6)) == rows(want)
