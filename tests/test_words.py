"""Words as numbers, MD5 by columns and the vectors and counts made of them, against the plain rules."""

import re
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamarisk.functions import hashing as H
from tamarisk.functions import turkish as T
from tamarisk.functions import words as W
from tamarisk.functions.digests import SHORT, md5_heads
from tamarisk.operators.dense import search_with_pairs
from tamarisk.operators.lexical import BM25Index

ODD = ["'a''b' c'’d ’'’e", "'", "", None, "a'b’c'", "IĞDIR İstanbul K Å É'x é’", "x" * 60 + " " + "y" * 60, "kahve\x00kahve\tKAHVE", "ﬀ ß ﬁ Σ ς", "a " * 50]


def test_words_are_those_of_the_expressions(spark):
    every = [f"a{chr(c)}b" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ODD + ["".join(every[i : i + 997]) for i in range(0, len(every), 997)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.tokenize(F.col("t")).alias("w"), F.regexp_extract_all(H._plain(F.col("t")), F.lit(T.WORD), F.lit(0)).alias("p")).orderBy("i").collect()
    for column, plain in (("w", ("", "")), ("p", (H.ACCENTS_FROM, H.ACCENTS_TO))):
        words = W.Words(W.alphabet(plain))
        number, text = words.numbers(texts)
        got = [[] for _ in texts]
        for n, t in zip(number, text, strict=True):
            got[t].append(words.known[n])
        assert got == [r[column] for r in rows]


def test_portions(monkeypatch):
    monkeypatch.setattr(W, "TEXTS", 2)
    monkeypatch.setattr(W, "CHARACTERS", 5)
    assert list(W.portions(pa.array(["a", None, "b", "cccccccc", "d", "eeee", "f"]))) == [["a", None], ["b"], ["cccccccc"], ["d", "eeee"], ["f"]]
    assert list(W.portions(pa.array([], pa.string()))) == []


def test_digests():
    data = [bytes((i * k) % 251 for k in range(n)) for n in range(SHORT + 1) for i in (1, 77)]
    rows = np.zeros((len(data), 64), np.uint8)
    for i, d in enumerate(data):
        rows[i, : len(d)] = list(d)
    low, high = md5_heads(rows, np.array([len(d) for d in data]))
    assert [(int(a), int(b)) for a, b in zip(low, high, strict=True)] == [(int.from_bytes(x[:4], "little"), int.from_bytes(x[4:8], "little")) for x in (md5(d).digest() for d in data)]


@pytest.mark.parametrize("memo", [1 << 18, 0])
def test_dense_vectors_are_the_sparse_ones(spark, sf, monkeypatch, memo):
    monkeypatch.setattr(H, "MEMO", memo)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text").limit(40).unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "id long, text string"))
    want = {(r.id, r.bucket): r.weight for r in H.hash_features(docs, "id", F.col("text")).collect() if r.weight}
    got = {(r.id, b): x for r in docs.select("id", H.md5_embed(F.col("text")).alias("v")).collect() for b, x in enumerate(r.v) if x}
    near = {k for k in want if abs(want[k]) > 1e-12}
    assert near and near == {k for k in got if abs(got[k]) > 1e-12} and all(abs(got[k] - want[k]) < 1e-12 for k in near)


def test_a_scan_with_pairs_is_made_once(spark):
    """The best of a scan and the pairs it was asked for come from one pass: every text would be embedded and scored again for a second one."""
    docs = spark.createDataFrame([(i, f"ortak kelime{i % 7}") for i in range(40)], "id long, text string")
    asked = spark.createDataFrame([(0, "ortak"), (1, "kelime2 ortak")], "qid long, question string")
    pairs = spark.createDataFrame([(0, 39), (1, 2)], "qid long, id long")
    lexical = BM25Index.build(docs, "id", F.col("text")).with_pairs(asked, "qid", F.col("question"), 3, pairs)
    vectors = docs.select("id", H.md5_embed(F.col("text")).alias("v"))
    dense = search_with_pairs(asked.withColumn("q", H.md5_embed(F.col("question"))), vectors, 3, pairs)
    for found in (lexical, dense):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"MapInArrow run", plan)) == 1, plan
        assert {(r.qid, r.id) for r in found.collect()} >= {(0, 39), (1, 2)}
