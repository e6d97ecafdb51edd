"""Retrieval quality as a figure: the offline backend with the settings as they come, on questions of our own.

The published figures for such a corpus are Recall@4 0.88, MRR 0.793 and refusals 1.0 with both
rankings, and 0.72 and 0.65 by vectors alone.
"""

import pytest

from tamarisk.plans import evaluate as E
from tamarisk.plans.pipeline import RagPipeline, ingest
from tamarisk.plans.settings import Settings

from .quality import DOCUMENTS, QUESTIONS


@pytest.fixture(scope="module")
def opened(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("quality")
    (base / "docs").mkdir()
    for name, text in DOCUMENTS.items():
        (base / "docs" / name).write_text(text, encoding="utf-8")
    settings = Settings(docs_dir=str(base / "docs"), index_dir=str(base / "index"))
    ingest(spark, settings)
    rows = [(f"q{k}", q, source, None) for k, (q, source) in enumerate(QUESTIONS)]
    return settings, spark.createDataFrame(rows, "id string, question string, expected_source string, expected_keywords array<string>")


def test_quality_with_both_rankings(spark, opened):
    settings, questions = opened
    with RagPipeline(spark, settings) as rag:
        results, summary = E.evaluate(rag, questions)
        s = summary.first()
        wrong = [(r.question, r.retrieved_sources, r.top_score) for r in results.where("NOT correct").collect()]
    print(s, wrong)
    assert (s.questions, s.n_answerable) == (33, 25)
    assert s.recall_at_k >= 0.88 and s.mrr >= 0.793 and s.refusal_accuracy == 1.0, wrong
    assert all(r.passed for r in E.quality_gate(summary).collect())
