"""Rank fusion of dense and lexical results behind a confidence gate, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import saturate
from .dense import search_with_pairs
from .lexical import BM25Index

RRF_K = 60


def matched_by(dense: Column, lexical: Column) -> Column:
    """Which ranking found a hit: both, words or meaning; meaning also if neither did."""
    return F.when((dense > 0.01) & (lexical > 0), "ikisi").when(lexical > 0, "kelime").otherwise("anlam")


def candidates(scores: DataFrame, pool: int) -> DataFrame:
    """The ``pool`` best positive scores of each question with their rank from 1; ties by id."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scores.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool)


def pooled_scores(index: BM25Index, questions: DataFrame, vectors: DataFrame, pool: int, keep, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(qid, id, score) by meaning and by words, of each question's dense and lexical pool, for questions (qid, question, q).

    No ranking needs more: a candidate of either pool has the score of the other kind too.
    """
    lexical = keep(index.top_k(questions, "qid", F.col("question"), pool, digits).drop("rank"))
    dense = keep(search_with_pairs(questions, vectors, pool, lexical, digits))
    return dense, keep(index.with_pairs(questions, "qid", F.col("question"), pool, dense, digits))


def fuse(dense: DataFrame, lexical: DataFrame, pool: int, k: int = RRF_K) -> DataFrame:
    """(qid, id, fused, dense_rank, lex_rank): sums of 1 / (k + rank) over the two candidate lists."""
    d = candidates(dense, pool).select("qid", "id", F.col("rank").alias("dense_rank"))
    x = candidates(lexical, pool).select("qid", "id", F.col("rank").alias("lex_rank"))
    both = d.join(x, ["qid", "id"], "full")
    share = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    return both.withColumn("fused", share("dense_rank") + share("lex_rank"))


def hybrid_search(dense: DataFrame, lexical: DataFrame, top_k: int = 4, min_similarity: float = 0.30, rrf_k: int = RRF_K, lexical_scale: float = 4.0, candidate_multiplier: int = 5) -> DataFrame:
    """(qid, rank, id, score, dense_score, lexical_score, fused_score, matched_by) from (qid, id, score) tables.

    Candidates are fused by rank; those whose confidence (the larger of the cosine and the saturated
    lexical score) reaches the threshold are taken in fused order until k. Equal fused scores go by
    the dense rank (nulls last), then the lexical one.
    """
    fused = fuse(dense, lexical, max(top_k * candidate_multiplier, top_k), rrf_k)
    with_scores = fused.join(dense.select("qid", "id", F.col("score").alias("dense_score")), ["qid", "id"], "left").join(
        lexical.select("qid", "id", F.col("score").alias("lexical_score")), ["qid", "id"], "left"
    )
    d, x = F.coalesce("dense_score", F.lit(0.0)), F.coalesce("lexical_score", F.lit(0.0))
    gated = with_scores.withColumns({"dense_score": d, "lexical_score": x}).withColumn("score", F.greatest("dense_score", saturate(F.col("lexical_score"), lexical_scale)))
    w = Window.partitionBy("qid").orderBy(F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lex_rank"))
    ranked = gated.where(F.col("score") >= min_similarity).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return ranked.select("qid", "rank", "id", "score", "dense_score", "lexical_score", F.col("fused").alias("fused_score"), matched_by(F.col("dense_score"), F.col("lexical_score")).alias("matched_by"))
