"""The model backend: one load a worker, batches, a second try, and errors by row."""

import os

import pytest
from pyspark.sql import functions as F

from tamarisk.operators.backends import Backend, ModelBackend


class Model:
    def __init__(self, log, kind):
        self.log, self.kind = log, kind
        with open(log, "a", encoding="utf-8") as file:
            file.write(f"load {kind} {os.getpid()}\n")

    def embed(self, texts):
        with open(self.log, "a", encoding="utf-8") as file:
            file.write(f"{self.kind} {len(texts)}\n")
        if any(t == "raise" for t in texts):
            raise RuntimeError("out of memory")
        bad = {"never"} | ({"seldom"} if self.kind == "first" else set())
        return [[float("inf"), 0.0] if t in bad else [1.0] if t == "narrow" else [float(len(t)), 1.0] for t in texts]

    def chat(self, messages):
        return messages[1]["content"][-5:]


@pytest.fixture
def backend(tmp_path):
    log = str(tmp_path / "log")
    return ModelBackend("test", 2, lambda: Model(log, "first"), lambda: Model(log, "again"), batch=4), log


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string").coalesce(1)


def test_errors_by_row(spark, backend):
    rows = texts(spark, "abc", "seldom", "never", None, "", "narrow", "raise", "abcd", "a")
    got = {r.id: (r.r.vector, r.r.error) for r in rows.select("id", backend[0].embed_checked(F.col("text")).alias("r")).collect()}
    assert [got[i][0] for i in (0, 1, 3, 4, 7, 8)] == [[3.0, 1.0], [6.0, 1.0], [0.0, 1.0], [0.0, 1.0], [4.0, 1.0], [1.0, 1.0]]
    assert all(got[i][0] is None and "second try" in got[i][1] for i in (2, 5, 6))
    assert all(got[i][1] is None for i in (0, 1, 3, 4, 7, 8))


def test_a_worker_loads_once_and_takes_batches(spark, backend):
    model, log = backend
    texts(spark, *["x"] * 10).select(model.embed(F.col("text")).alias("v")).collect()
    with open(log, encoding="utf-8") as file:
        lines = file.read().split("\n")[:-1]
    assert sum(x.startswith("load first") for x in lines) == 1 and not any("again" in x for x in lines)
    assert [x for x in lines if not x.startswith("load")] == ["first 4", "first 4", "first 2"]


def test_an_index_takes_no_faulty_vector(spark, backend):
    assert texts(spark, "ab").select(backend[0].embed(F.col("text")).alias("v")).first().v == [2.0, 1.0]
    with pytest.raises(Exception, match="second try"):
        texts(spark, "never").select(backend[0].embed(F.col("text")).alias("v")).collect()


def test_chat_and_contract(spark, backend):
    model: Backend = backend[0]
    assert (model.signature, model.dim) == ("test:2", 2)
    asked = spark.createDataFrame([(1, "neden?")], "qid long, question string")
    hits = spark.createDataFrame([(1, 1, "a.md", "", "çünkü", 0.9)], "qid long, rank int, source string, heading string, content string, score double")
    assert len(model.chat(asked, hits).first().answer) == 5
