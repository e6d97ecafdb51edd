import pytest

import corpus_pipeline as P
from tamarisk.llm.common import materialise


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents before and after every stage."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in P.STAGES:
        out.append(materialise(stage(spark, out[-1], sf), name.replace(" ", "_")))
    return out


def test_every_stage_keeps_columns_and_only_shrinks(stages):
    for before, after in zip(stages, stages[1:], strict=False):
        assert after.columns == stages[0].columns or set(after.columns) == set(stages[0].columns)
        assert after.join(before, "doc_id", "left_anti").isEmpty() and after.count() == after.select("doc_id").distinct().count()
    assert stages[-1].count() > 0


def test_decisions_take_effect(spark, sf, stages):
    from tamarisk.llm import queries as Q
    from tamarisk.llm.decontaminate import contaminated
    from tamarisk.llm.simhash_dedup import simhash_groups
    from tamarisk.llm.toxicity import toxicity

    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert ids[0] - ids[1] == {r.doc_id for r in toxicity(stages[0], Q.toxicity_model(spark, sf)).where("predicted = 1").collect()}
    assert ids[2] - ids[3] == {r.doc_id for r in simhash_groups(stages[2], width=5).where("doc_id <> component_id").collect()}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert ids[3] - ids[4] == {r.doc_id for r in contaminated(stages[3], bench).collect()}
    texts = {r.doc_id: r.text for r in stages[2].collect()}
    lines = [" ".join(x.lower().split()) for t in texts.values() for x in t.split("\n") if len(x.split()) >= 5]
    assert len(lines) == len(set(lines))


def test_run_gives_the_last_stage(spark, sf, stages):
    assert sorted(r.doc_id for r in P.run(spark, sf).collect()) == sorted(r.doc_id for r in stages[-1].collect())


def test_a_task_needs_one_python_worker(spark, sf, monkeypatch):
    """Workers stay on the executors for later stages: none for the rows of the driver, and no two Python operators in one task."""
    from tamarisk.llm import decontaminate as D
    from tamarisk.llm import mixing as M
    from tamarisk.llm import queries as Q
    from tamarisk.llm import toxicity as T

    plans = {}
    noted = lambda name, df: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
    for module, name in ((T, "toxicity"), (D, "decontamination")):
        monkeypatch.setattr(module, "materialise", lambda df, label, name=name: (noted(f"{name} {label}", df), materialise(df, label))[1])
    svd = D.randomised_svd
    monkeypatch.setattr(D, "randomised_svd", lambda rows, width, rank: (noted("multiplied", rows), svd(rows, width, rank))[1])
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    Q.toxicity_model(spark, sf)
    next(D._blocks(documents, spark.read.parquet(f"{sf}/benchmark.parquet"), "text", 256, 8, 2000))
    noted("mixed", M.sample_mix(documents))
    assert {"toxicity labelled", "multiplied", "mixed"} <= set(plans)
    for name, plan in plans.items():
        assert "LogicalRDD" not in plan and plan.count("InArrow") + plan.count("ArrowEval") == (name not in ("multiplied", "mixed")), name


def test_rows_of_the_driver(spark):
    from tamarisk.llm.common import local_table

    rows = [("a", None, [1, 2], 0.5), (None, 2, [], None)]
    found = local_table(spark, rows, "s string, n long, at array<int>, x double")
    assert [tuple(r) for r in found.collect()] == rows and found.dtypes == [("s", "string"), ("n", "bigint"), ("at", "array<int>"), ("x", "double")]
    assert local_table(spark, [], "s string").collect() == []
