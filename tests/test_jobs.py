"""The jobs: growing input in two runs, repeated and cut-off runs, and their command lines."""

import json

import pytest
from pyspark.sql import functions as F

from jobs import audit_answers as A
from jobs import index_documents as I
from tamarisk.operators.growing_index import GrowingIndex
from tamarisk.operators.lexical import BM25Index

DOCS = "doc_id long, text string, source string, extra int"


def write(spark, rows, path, schema=DOCS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "documents.parquet"), str(tmp_path / "index"), str(tmp_path / "checkpoint")


def postings(spark, index):
    return sorted((r.id, r.term, r.tf, r.dl, r.df, round(r.idf, 9)) for r in I.read_index(spark, index).collect())


def by_content(spark, index):
    """Which of equal texts has come first depends on the files they are in; what is indexed does not."""
    return sorted((r.content_hash, r.term, r.tf, r.dl, r.df, round(r.idf, 9)) for r in I.read_index(spark, index).collect())


def test_growing_input(spark, sf, paths, tmp_path):
    """Two runs over copies that grow read each file once and give the index of one run over everything."""
    docs, index, checkpoint = paths
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", F.lit(1).alias("extra"))
    table.where("doc_id < 60").coalesce(1).write.parquet(docs)
    first = I.index_documents(spark, docs, index, checkpoint)
    assert first["read"] == 60
    table.where("doc_id >= 60").repartition(2).write.mode("append").parquet(docs)
    second = I.index_documents(spark, docs, index, checkpoint, files_per_batch=1)
    assert second["read"] == table.count() - 60
    stored = GrowingIndex(spark, index).table("passages")
    assert stored.select("batch").distinct().count() == 3
    grown = by_content(spark, index)
    whole = str(tmp_path / "whole")
    once = I.index_documents(spark, docs, whole, str(tmp_path / "other"))
    assert once["added"] == first["added"] + second["added"] and once["terms"] == second["terms"]
    assert grown == by_content(spark, whole)
    again = I.index_documents(spark, docs, index, checkpoint)
    assert (again["read"], again["added"]) == (0, 0) and by_content(spark, index) == grown


def test_repeats_nulls_and_empty_files(spark, paths):
    docs, index, checkpoint = paths
    write(spark, [(1, "bir kedi", "s", 1), (2, "bir kedi", "s", 1), (3, "bir kedi", "t", 1), (None, "kimse", "s", 1), (4, None, None, None), (5, "", None, 0)], docs)
    assert I.index_documents(spark, docs, index, checkpoint)["added"] == 3  # 1, 3 and the empty text
    write(spark, [], docs)
    write(spark, [(0, "bir kedi", "s", 1), (6, "iki kedi", "s", 1)], docs)
    assert I.index_documents(spark, docs, index, checkpoint)["added"] == 1
    got = postings(spark, index)
    assert {(r[0], r[1]) for r in got} == {(1, "bir"), (1, "kedi"), (3, "bir"), (3, "kedi"), (6, "iki"), (6, "kedi")}
    assert {r[1]: r[4] for r in got} == {"bir": 2, "kedi": 3, "iki": 1}


def test_empty_input(spark, paths):
    docs, index, checkpoint = paths
    write(spark, [], docs)
    assert I.index_documents(spark, docs, index, checkpoint) == {"read": 0, "added": 0, "terms": 0}
    assert postings(spark, index) == []


def test_batch_that_is_run_again(spark, tmp_path):
    """A batch that was cut off after its first table, and one that is repeated, leave the same index."""
    rows = lambda *x: spark.createDataFrame([(i, "s", "", t) for i, t in x], "id long, source string, heading string, text string")
    index = GrowingIndex(spark, str(tmp_path / "i"))
    one, two = rows((1, "kedi uyur"), (2, "kahve sıcak")), rows((3, "kedi yer"), (4, "kahve sıcak"))
    assert index.add(one, 0) == 2
    spark.createDataFrame([("yarım", 9, 1)], "term string, id long, tf long").write.parquet(str(tmp_path / "i/postings/batch=1"))
    assert index.add(two, 1) == 1 and index.add(two, 1) == 1 and index.add(one, 0) == 2
    ask = spark.createDataFrame([(0, "kedi kahve yarım")], "qid long, question string")
    got = {r.id: r.score for r in index.bm25().scores(ask, "qid", F.col("question")).collect()}
    whole = BM25Index.build(one.unionByName(two.where("id = 3")), "id", F.col("text"))
    assert got == pytest.approx({r.id: r.score for r in whole.scores(ask, "qid", F.col("question")).collect()})


def test_estimates_add_up_over_batches(spark, tmp_path):
    """Sketches of batches that overlap give the numbers of the whole; an empty index has none."""
    index = GrowingIndex(spark, str(tmp_path / "i"))
    assert tuple(index.estimates().first()) == (0, 0, 0, 0)
    for batch, low in enumerate((0, 2000, 3000)):
        index.add(spark.range(low, low + 2000).selectExpr("id", "concat('s', id % 700) AS source", "'' AS heading", "concat('q', id, ' q', id + 1, ' ortak') AS text"), batch)
    got = index.estimates().first()
    exact = index.table("counts").select("term").distinct().count()
    assert got.passages == 5000 and abs(got.terms - exact) <= 0.025 * exact and abs(got.sources - 700) <= 18


TALK = "conv_id long, turn long, role string, text string"


def test_audit_replaces_its_own_run(spark, tmp_path):
    path, out = str(tmp_path / "c"), str(tmp_path / "out")
    talk = [
        (1, 0, "user", "Kahve sıcak su ile demlenir ve hemen içilir."), (1, 1, "assistant", "Kahve sıcak su ile demlenir. Uzay gemileri Marsa doğru yavaşça uçar."),
        (2, 0, "assistant", "Hiçbir şey sorulmadan verilen uzun bir cevap."), (3, 0, None, "x"), (None, 1, "user", "y"), (4, 0, "assistant", None), (4, None, "user", "z"),
    ]
    write(spark, talk, path, TALK)
    assert A.audit_answers(spark, path, out, "a")["answers"] == 3
    A.audit_answers(spark, path, out, "b")
    write(spark, [(5, 0, "user", "Kediler gün boyu uyur ve gece avlanır."), (5, 1, "assistant", "Kediler gün boyu uyur ve gece avlanır.")], path, TALK)
    for _ in range(2):
        assert A.audit_answers(spark, path, out, "b")["answers"] == 4
    got = {(r.run, r.conv_id): (r.verdict, r.n_sentences, r.n_unsupported) for r in A.read_reports(spark, out).collect()}
    assert got[("b", 5)] == ("clean", 1, 0) and ("a", 5) not in got and len(got) == 7
    assert got[("a", 1)] == ("unsupported", 2, 1) and got[("a", 2)] == ("unsupported", 1, 1) and got[("a", 4)] == ("clean", 0, 0)


def test_only_the_last_passages_count(spark, tmp_path):
    """A passage that is more than ``last`` turns back supports nothing."""
    said = "Kediler gün boyu uyur ve gece avlanır."
    talk = [(1, 0, "user", said), (1, 1, "user", "b"), (1, 2, "user", "c"), (1, 3, "assistant", said), (1, 4, "user", "d"), (1, 4, "user", "e"), (1, 5, "assistant", said)]
    write(spark, talk, str(tmp_path / "c"), TALK)
    A.audit_answers(spark, str(tmp_path / "c"), str(tmp_path / "out"), "r", last=3)
    assert {r.turn: r.score for r in A.read_reports(spark, str(tmp_path / "out"), "r").collect()} == {3: 1.0, 5: 0.0}


def test_command_lines(spark, sf, paths, tmp_path, monkeypatch):
    """Both take a config file, let arguments win, and name what is missing."""
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    docs, index, checkpoint = paths
    write(spark, [(1, "bir kedi", "s", 1)], docs)
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"documents": "nowhere", "index": index, "checkpoint": checkpoint, "shards": 2}))
    I.main(["--config", str(config), "--documents", docs])
    assert len(postings(spark, index)) == 2
    config.write_text(json.dumps({"conversations": f"{sf}/conversations.parquet", "run": "x"}))
    A.main(["--config", str(config), "--output", str(tmp_path / "audit")])
    assert A.read_reports(spark, str(tmp_path / "audit"), "x").count() > 0
    for main in (I.main, A.main):
        with pytest.raises(SystemExit):
            main([])


@pytest.mark.parametrize("job", [I, A])
def test_shipped_config(job):
    with open(job.__file__.replace(".py", ".json"), encoding="utf-8") as file:
        settings = json.load(file)
    function = job.index_documents if job is I else job.audit_answers
    assert set(settings) <= set(function.__code__.co_varnames[: function.__code__.co_argcount])
