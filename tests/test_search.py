import math

import pytest
from pyspark.sql import functions as F

from tamarisk.functions import vectors as V
from tamarisk.functions.hashing import DIM, embed, hash_embed
from tamarisk.operators.dense import assert_uniform_dim, cosine_scores, search_top_k
from tamarisk.operators.hybrid import fuse, hybrid_search
from tamarisk.operators.lexical import BM25Index


@pytest.fixture
def corpus(spark):
    rows = [(0, "Kedi uyur ve kedi yer."), (1, "Kahve sıcak içilir."), (2, "Model 1536 boyutludur."), (3, ""), (4, None)]
    return BM25Index.build(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"))


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid long, question string")


def test_bm25_properties(spark, corpus):
    got = {(r.qid, r.id): r.score for r in corpus.scores(ask(spark, "1536", "kediler", "yok", "kahve kahve", "kahve", ""), "qid", F.col("question")).collect()}
    assert set(k for k in got if k[0] == 0) == {(0, 2)} and (1, 0) in got and not [k for k in got if k[0] in (2, 5)]
    assert got[3, 1] == pytest.approx(2 * got[4, 1])
    lengths = {r.id: r.dl for r in corpus.lengths.collect()}
    assert lengths[3] == 0 and lengths[4] == 0
    idf = {r.term: r for r in corpus.idf.collect()}
    assert idf["1536"].idf == pytest.approx(math.log(1 + 4.5 / 1.5)) and all(r.idf >= 0 for r in idf.values())


def test_bm25_shuffles_nothing_by_text(spark, monkeypatch):
    """A question's scores are made where the text is; the k best, given pairs and blocks of questions give the rows of the full list."""
    from tamarisk.operators import lexical as L

    docs = spark.createDataFrame([(i, f"ortak kelime{i % 7} konu{i % 13} ortak" if i % 5 else "baska") for i in range(400)], "id long, text string")
    index = BM25Index.build(docs, "id", F.col("text"))
    asked = ask(spark, "ortak konu3", "kelime2 konu5 konu5", "yok", "ortak", "baska")
    found = index.scores(asked, "qid", F.col("question"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("hashpartitioning(id", "hashpartitioning(term", "SortMergeJoin"))
    every = sorted((r.qid, -round(r.score, 6), r.id) for r in found.collect())
    monkeypatch.setattr(L, "CELLS", 8)
    monkeypatch.setattr(L, "QUESTION_BLOCK", 2)
    best = sorted((r.qid, -r.score, r.id) for r in index.top_k(asked, "qid", F.col("question"), 3, digits=6).collect())
    assert best == [x for q in range(5) for x in [y for y in every if y[0] == q][:3]]
    pairs = spark.createDataFrame([(0, 399), (1, 0), (3, 6)], "qid long, id long")
    both = {(r.qid, r.id) for r in index.with_pairs(asked, "qid", F.col("question"), 3, pairs, digits=6).collect()}
    assert both == {(q, i) for q, _, i in best} | {(0, 399), (3, 6)}


def test_postings_meet_their_lengths_without_a_join(spark, corpus):
    from tamarisk.operators.lexical import normed_postings

    found = normed_postings(corpus)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "SortMergeJoin" not in plan
    lengths = {r.id: r.dl for r in corpus.lengths.collect()}
    mean = sum(lengths.values()) / len(lengths)
    got = {(r.term, r.id): (r.tf, r.norm) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {(r.term, r.id): r.tf for r in corpus.postings.collect()}
    assert all(n == pytest.approx(1.5 * (0.25 + 0.75 * lengths[i] / mean)) for (_, i), (_, n) in got.items())


def test_bm25_without_documents(spark):
    empty = BM25Index.build(spark.createDataFrame([], "id long, text string"), "id", F.col("text"))
    assert empty.scores(ask(spark, "kedi"), "qid", F.col("question")).count() == 0
    blank = BM25Index.build(spark.createDataFrame([(1, "")], "id long, text string"), "id", F.col("text"))
    assert blank.scores(ask(spark, "kedi"), "qid", F.col("question")).count() == 0


def test_cosine_and_widths(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-3.0, 0.0]), (3, [0.0, 0.0])], "id long, v array<double>")
    q = spark.createDataFrame([(7, [5.0, 0.0])], "qid long, q array<double>")
    assert {r.id: r.score for r in cosine_scores(q, v).collect()} == {0: 1.0, 1: 0.0, 2: -1.0, 3: 0.0}
    top = [(r["rank"], r.id) for r in search_top_k(q, v, 3, 0.0).orderBy("rank").collect()]
    assert top == [(1, 0), (2, 1), (3, 3)]
    assert search_top_k(q, v.limit(0), 3).count() == 0 and search_top_k(q.limit(0), v, 3).count() == 0
    assert [r.id for r in search_top_k(q, v, 99, -2.0).orderBy("rank").collect()] == [0, 1, 3, 2]
    with pytest.raises(Exception, match="mismatch"):
        cosine_scores(q, v.withColumn("v", F.array(F.lit(1.0)))).collect()
    assert assert_uniform_dim(v, "v") == 2
    with pytest.raises(ValueError):
        assert_uniform_dim(v.unionByName(spark.createDataFrame([(9, [1.0])], "id long, v array<double>")), "v")
    assert V.decode_vector(V.encode_vector([0.5, -1.0])) == [0.5, -1.0]


def test_cosines_of_all_pairs_are_matrix_products(spark):
    v = [(i, [float((i * k) % 7 - 3) for k in (1, 2, 3)]) for i in range(1100)] + [(2000, None), (2001, [1.0, None, 2.0])]
    vectors = spark.createDataFrame(v, "id long, v array<double>")
    asked = vectors.where("id % 100 = 0").selectExpr("id AS qid", "v AS q").unionByName(spark.createDataFrame([(-1, None)], "qid long, q array<double>"))
    found = cosine_scores(asked, vectors)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    plain = vectors.crossJoin(asked).select("qid", "id", V.cosine(F.col("q"), F.col("v")).alias("score"))
    got, want = ({(r.qid, r.id): r.score for r in t.collect()} for t in (found, plain))
    assert len(got) == 1102 * 13 and got.keys() == want.keys()
    assert all((x is None) == (want[k] is None) and (x is None or abs(x - want[k]) < 1e-12) for k, x in got.items())


def test_saturate(spark):
    row = spark.range(1).select(V.saturate(F.lit(10.29), 16).alias("a"), V.saturate(F.lit(-1.0)).alias("b"), V.saturate(F.lit(4.0)).alias("c")).first()
    assert (round(row.a, 3), row.b, row.c) == (0.391, 0.0, 0.5)


def test_hash_embedding(spark):
    row = spark.createDataFrame([("kedi uyur", ""), (None, "KEDİ")], "a string, b string").select(hash_embed("a").alias("a"), hash_embed("b").alias("b")).collect()
    assert len(row[0].a) == DIM and sum(x * x for x in row[0].a) == pytest.approx(1)
    assert not any(row[0].b) and not any(row[1].a)
    assert embed("Kedi uyur!").tolist() == pytest.approx(row[0].a)


def scores(spark, rows):
    return spark.createDataFrame([(0, i, float(s)) for i, s in rows], "qid long, id long, score double")


def test_fusion_ties_put_dense_first(spark):
    dense, lexical = scores(spark, [(1, 0.9), (2, -0.5), (3, 0.0)]), scores(spark, [(4, 8.0)])
    assert {r.id for r in fuse(dense, lexical, 20).collect()} == {1, 4}
    got = hybrid_search(dense, lexical, 4, 0.3).orderBy("rank").collect()
    assert [(r.id, r.matched_by) for r in got] == [(1, "anlam"), (4, "kelime")]
    assert got[0].fused_score == got[1].fused_score == pytest.approx(1 / 61)


def test_gate_comes_before_the_cut(spark):
    dense = scores(spark, [(i, 0.2 + i / 1000) for i in range(10)] + [(50, 0.19)])
    lexical = scores(spark, [(50, 40.0)])
    got = hybrid_search(dense, lexical, 1, 0.5).collect()
    assert [r.id for r in got] == [50] and got[0].matched_by == "ikisi"
    assert hybrid_search(dense, lexical.limit(0), 4, 0.9).count() == 0


def test_index_of_the_asked_terms(spark, sf):
    """An index for known questions has their terms only, all lengths, and gives the scores of the whole index."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "kitaplar'ın evlerinden")], "doc_id long, text string"))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("question")).limit(5)
    asked = asked.unionByName(spark.createDataFrame([(-1, "evler kitap zzzz"), (-2, None)], "qid long, question string"))
    whole, some = (BM25Index.build(docs, "doc_id", F.col("text"), asked=a) for a in (None, asked))
    scores = lambda index: {(r.qid, r.id): r.score for r in index.scores(asked, "qid", F.col("question")).collect()}
    assert scores(some) == scores(whole) and scores(some)
    assert sorted(some.lengths.collect()) == sorted(whole.lengths.collect())
    assert some.postings.count() < whole.postings.count() / 2
