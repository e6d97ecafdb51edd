"""Sentence-level audit of answers against the passages they were given.

Answers are (qid, answer); hits are (qid, rank, source, passage). All joins are on qid: each
question's sentences meet its own passages only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sentences import answer_sentences, is_degenerate
from ..functions.terms import counted_content

SUPPORTED_FROM = 0.45


def sentences(answers: DataFrame) -> DataFrame:
    """(qid, pos, sentence) of every checkable sentence."""
    return answers.select("qid", F.posexplode(answer_sentences(F.col("answer"))).alias("pos", "sentence"))


def passage_terms(hits: DataFrame) -> DataFrame:
    """(qid, rank, term): distinct content terms of each passage."""
    terms = hits.select("qid", "rank", counted_content(F.col("passage")).alias("terms"))
    return terms.select("qid", "rank", F.inline("terms")).select("qid", "rank", "term")


def passage_idf(hits: DataFrame) -> DataFrame:
    """(qid, term, idf, ranks) over a question's passages; ranks are those of the passages that have the term."""
    n = hits.groupBy("qid").agg(F.count("*").alias("n"))
    found = passage_terms(hits).groupBy("qid", "term").agg(F.collect_set("rank").alias("ranks"))
    return found.join(n, "qid").select("qid", "term", F.ln(1 + F.col("n") / (F.size("ranks") + F.lit(0.5))).alias("idf"), "ranks")


def covered_shares(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, pos, rank, score): share of a sentence's weight that a passage of its question covers, where it covers any.

    A term weighs its idf, or the largest idf if no passage has it, at most twice.
    """
    said = sentences(answers).select("qid", "pos", counted_content(F.col("sentence")).alias("terms"))
    terms = said.select("qid", "pos", F.inline("terms"))
    idf = passage_idf(hits)
    top = idf.groupBy("qid").agg(F.max("idf").alias("top"))
    weight = F.least("n", F.lit(2)) * F.coalesce("idf", "top", F.lit(1.0))
    weighted = terms.join(idf, ["qid", "term"], "left").join(top, "qid", "left").select("qid", "pos", weight.alias("w"), "ranks")
    total = F.sum("w").over(Window.partitionBy("qid", "pos"))
    spread = weighted.withColumn("total", total).select("qid", "pos", "w", "total", F.explode("ranks").alias("rank"))
    return spread.groupBy("qid", "pos", "rank").agg((F.sum("w") / F.first("total")).alias("score"))


def support_scores(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, pos, rank, score) of every sentence and passage of a question; 0 where nothing is covered, as in a sentence without content terms."""
    grid = sentences(answers).select("qid", "pos").join(hits.select("qid", "rank"), "qid")
    scored = grid.join(covered_shares(answers, hits), ["qid", "pos", "rank"], "left")
    return scored.select("qid", "pos", "rank", F.coalesce("score", F.lit(0.0)).alias("score"))


def verdicts(answers: DataFrame, hits: DataFrame, threshold: float = SUPPORTED_FROM) -> DataFrame:
    """(qid, pos, sentence, score, supported, best_source): each sentence's best passage, the first of equals; '' if none covers it."""
    best = (
        covered_shares(answers, hits).groupBy("qid", "pos")
        .agg(F.max(F.struct(F.round("score", 12).alias("r"), (-F.col("rank")).alias("k"), "score")).alias("b"))
        .select("qid", "pos", F.col("b.score").alias("score"), (-F.col("b.k")).alias("rank"))
        .join(hits.select("qid", "rank", "source"), ["qid", "rank"])
    )
    found = sentences(answers).join(best.drop("rank"), ["qid", "pos"], "left")
    score = F.coalesce("score", F.lit(0.0))
    reached = F.round(score, 12) >= threshold  # a share of exactly the threshold counts, in whatever order its terms were added up
    return found.select("qid", "pos", "sentence", score.alias("score"), reached.alias("supported"), F.when(score > 0, F.col("source")).otherwise("").alias("best_source"))


def report(answers: DataFrame, hits: DataFrame, threshold: float = SUPPORTED_FROM, judged: DataFrame | None = None) -> DataFrame:
    """One row per answer: qid, score, n_sentences, n_unsupported, degenerate, is_clean, trustworthy, summary.

    Without a checkable sentence the score is 1 and the answer is not called degenerate. ``judged``
    are the answers' verdicts if they are there already.
    """
    sums = (verdicts(answers, hits, threshold) if judged is None else judged).groupBy("qid").agg(
        F.count("*").alias("n"), F.sum(F.col("supported").cast("int")).alias("good")
    )
    joined = answers.join(sums, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("good", F.coalesce("good", F.lit(0)))
    out = joined.select(
        "qid",
        F.when(F.col("n") > 0, F.col("good") / F.greatest("n", F.lit(1))).otherwise(1.0).alias("score"),
        F.col("n").cast("long").alias("n_sentences"),
        (F.col("n") - F.col("good")).cast("long").alias("n_unsupported"),
        ((F.col("n") > 0) & is_degenerate(F.coalesce("answer", F.lit("")))).alias("degenerate"),
    )
    good = F.col("n_sentences") - F.col("n_unsupported")
    line = F.concat(F.format_string("Kaynaklilik: %%%.0f (%d/%d cumle dayanakli)", F.bround(F.col("score") * 100, 0), good, F.col("n_sentences")),
                    F.when(F.col("n_unsupported") > 0, F.format_string(" -- %d cumle bağlamda doğrulanamadı", F.col("n_unsupported"))).otherwise(""),
                    F.when(F.col("degenerate"), " -- [!] cevap kendini tekrar ediyor (dejenere)").otherwise(""))
    return out.select(
        "*", ((F.col("n_unsupported") == 0) & ~F.col("degenerate")).alias("is_clean"), (~F.col("degenerate")).alias("trustworthy"),
        F.when(F.col("n_sentences") == 0, "Denetlenecek cumle yok.").otherwise(line).alias("summary"),
    )
