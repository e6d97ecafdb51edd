"""Scores of all pairs: rounded where they are made, in an order that is stored in little room."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tamarisk.operators import dense as D


def test_scores_are_stored_by_a_dictionary(spark, tmp_path):
    """Scores of five digits repeat, but too seldom in a first page; stored as they are they would take three times the room of the result."""
    v = np.random.default_rng(0).normal(size=(2400, 64)).round(3)
    vectors = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, v array<double>")
    asked = vectors.where("id % 4 = 0").selectExpr("id AS qid", "v AS q")
    D.cosine_scores(asked, vectors, digits=5).coalesce(1).write.parquet(f"{tmp_path}/pairs")
    (name,) = glob.glob(f"{tmp_path}/pairs/*.parquet")
    group = pq.ParquetFile(name).metadata.row_group(0)
    score = next(group.column(i) for i in range(3) if group.column(i).path_in_schema == "score")
    assert group.num_rows == 2400 * 600 and any("DICTIONARY" in e for e in score.encodings) and score.total_compressed_size < 4 * group.num_rows
    plain = D.cosine_scores(asked, vectors).select("qid", "id", F.round("score", 5).alias("want"))
    both = spark.read.parquet(f"{tmp_path}/pairs").join(plain, ["qid", "id"])
    assert both.count() == 2400 * 600 and both.where("score <> want OR score IS NULL").count() == 0


def test_a_task_gives_a_bounded_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "TASK_PAIRS", 1000)
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "id long, v array<double>").repartition(40)
    asked = vectors.where("id % 4 = 0").selectExpr("id AS qid", "v AS q")
    found = D.cosine_scores(asked, vectors, digits=5)
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 200 * 50 and max(r["count"] for r in sizes) <= 2000  # blocks are dealt out in turn, not by size


def test_no_negative_zero(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1e-9, 1.0]), (2, [-0.123455, 1.0])], "id long, v array<double>")
    got = {r.id: r.score for r in D.cosine_scores(v.limit(1).selectExpr("id AS qid", "v AS q"), v, digits=5).collect()}
    assert got[0] == 1.0 and str(got[1]) == "0.0" and got[2] == -0.12252
