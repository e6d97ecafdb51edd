import pandas as pd
import pytest

from tamarisk.llm import mixing as M

from .conftest import EDGES

CELLS = pd.DataFrame(
    [("a", "en", "x", 600), ("a", "de", "x", 100), ("b", "en", "y", 100), ("b", "de", "x", 50), ("b", None, "y", 50), ("c", "en", "x", 0)],
    columns=["source", "lang", "topic", "tokens"],
)


def test_marginals_meet_their_targets():
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "de": 0.3, None: 0.1}, "topic": {"x": 0.6, "y": 0.4}}
    done = M.rake_local(CELLS, 0.2, 0.5, 500, targets)
    w = done.p * done.tokens
    assert w.sum() == pytest.approx(0.2 * 900)
    assert (w[done.source == "a"].sum() / w.sum(), w[done.topic == "x"].sum() / w.sum()) == pytest.approx((0.5, 0.6), abs=1e-6)
    assert done.p.iloc[5] == 1.0 and done.p.between(0, 1).all()


def test_distributed_raking_is_the_same(spark):
    frame = spark.createDataFrame([tuple(r) for r in CELLS.astype(object).where(CELLS.notna(), None).itertuples(index=False)], "source string, lang string, topic string, tokens long")
    far = {(r.source, r.lang, r.topic): r.p for r in M.rake_distributed(frame, 0.6, 0.5, 6).collect()}
    near = M.rake_local(CELLS, 0.6, 0.5, 6)
    for r in near.itertuples():
        assert far[r.source, None if r.lang is None or r.lang != r.lang else r.lang, r.topic] == pytest.approx(r.p, abs=1e-9)


def test_sample_follows_probabilities_and_keeps_columns(docs):
    rows = [(i, "word " * (1 + i % 7)) for i in range(400)]
    made = M.mix(docs(rows)).collect()
    assert {r.probability for r in made} == {0.5} and 150 < sum(r.sampled for r in made) < 250
    kept = M.sample_mix(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in made if r.sampled) and kept.columns == docs([]).columns


def test_edges(docs):
    got = M.mix(docs(EDGES, lang=None, source=None)).collect()
    assert len(got) == len(EDGES) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert len({r.sampled for r in got if r.doc_id == 4}) == 1
    assert M.mix(docs([])).count() == 0 and M.sample_mix(docs([])).count() == 0
    assert M.mix(docs([(1, ""), (2, None)])).where("sampled").count() == 2


def test_columns_with_the_names_the_stage_uses(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, "w " * 20, "en", "s") for i in range(50)], "doc_id long, text string, lang string, source string")
    frame = frame.withColumn("__mix_topic", F.lit("t")).withColumn("__mix_p", F.lit("p")).withColumn("p", F.lit("q")).withColumn("topic", F.lit("u"))
    kept = M.sample_mix(frame)
    assert kept.columns == frame.columns and {(r["__mix_topic"], r["__mix_p"], r.p, r.topic) for r in kept.collect()} == {("t", "p", "q", "u")}
