"""A training-corpus pipeline: each stage is one operator, applied to all that the stage before kept.

``STAGES`` names the stages in order; each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's documents. All but the
last return the columns of ``documents``; the last one does too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm.common import materialise, table
from tamarisk.llm.decontaminate import decontaminate
from tamarisk.llm.line_dedup import without_repeated_lines
from tamarisk.llm.mixing import sample_mix
from tamarisk.llm.near_copies import near_dedup
from tamarisk.llm.queries import toxicity_model
from tamarisk.llm.toxicity import reject_toxic

#: Share of the tokens that reach the last stage which the mix keeps.
MIX_FRACTION = 0.5

#: No stage can be put in SQL as a whole; the tests hold each against brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon rejects go."""
    return reject_toxic(docs, toxicity_model(spark, sf_dir))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and similar lines go, and with them texts of which nothing is left."""
    return without_repeated_lines(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup(docs, width=5)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of sources, languages and topics."""
    return sample_mix(docs, fraction=MIX_FRACTION)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's output written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
