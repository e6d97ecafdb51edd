"""Answers of recorded conversations and what they may rest on: the turns that came before each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recorded_answers(conversations: DataFrame, answer_role: str = "assistant", passage_role: str = "user", last: int = 4) -> tuple[DataFrame, DataFrame]:
    """Answers (qid, conv_id, turn, answer) and hits (qid, rank, source, passage) of (conv_id, turn, role, text) rows.

    An answer is given the ``last`` passages before it in its conversation, the nearest first, so a
    conversation of any length gives as many hits as it has answers, times ``last``. Turns that share a
    number follow each other by role and text, repeated rows too; null texts count as empty, and rows
    without a conversation, turn or role are left out.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.where(F.col("role").isin(answer_role, passage_role)).select(
        "*", F.row_number().over(w).alias("pos"), F.sum((F.col("role") == passage_role).cast("int")).over(before).alias("passages")
    )
    answers = placed.where(F.col("role") == answer_role).select(F.concat_ws(":", "conv_id", "pos").alias("qid"), "conv_id", "turn", F.col("text").alias("answer"), "passages")
    passages = placed.where(F.col("role") == passage_role).select(
        "conv_id", F.col("passages").alias("number"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("source"), F.col("text").alias("passage")
    )
    wanted = answers.select("qid", "conv_id", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("rank"), (F.col("passages") + 1 - F.col("rank")).alias("number"))
    return answers.drop("passages"), wanted.join(passages, ["conv_id", "number"]).select("qid", "rank", "source", "passage")
