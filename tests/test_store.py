"""Insert-or-ignore on storage: batches in turn, repeated, cut off, and the plan of the anti-join."""

import pytest

from tamarisk.sources import store as S

ROWS = "source string, chunk_index int, heading string, content string, content_hash string, embedding array<float>, dim int"


def rows(spark, *keys, source="s"):
    return spark.createDataFrame([(source, i, "", f"t{k}", f"{k:064d}", [1.0, 0.0], 2) for i, k in enumerate(keys)], ROWS)


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, str(tmp_path / "it's an index"), buckets=3)


def held(store):
    return sorted((r.id, r.source, int(r.content_hash)) for r in store.chunks().collect())


def test_batches_in_turn(spark, store):
    assert store.chunks().count() == 0
    assert store.add_chunks(rows(spark, 5, 1, 5, 1)) == 2
    assert store.add_chunks(rows(spark, 1, 7, 9, source="a")) == 2
    assert store.add_chunks(rows(spark, 1, 7)) == 0
    assert held(store) == [(1, "s", 5), (2, "s", 1), (3, "a", 7), (4, "a", 9)]


def test_repeated_batch(spark, store):
    store.add_chunks(rows(spark, 1, 2), "a")
    for _ in range(2):
        assert store.add_chunks(rows(spark, 2, 3, 4), "b") == 2
    assert held(store) == [(1, "s", 1), (2, "s", 2), (3, "s", 3), (4, "s", 4)]
    assert {r.batch: r.n for r in store.batches().collect()} == {"a": 2, "b": 2}


def test_batch_that_was_cut_off(spark, store, monkeypatch):
    """A try that fails before its rows are written leaves the store as it was; one whose files are partly there is replaced."""
    store.add_chunks(rows(spark, 1), "a")
    real = type(spark).sql

    def cut(self, text, *a, **kw):
        if text.startswith("INSERT"):
            raise RuntimeError("killed")
        return real(self, text, *a, **kw)

    monkeypatch.setattr(type(spark), "sql", cut)
    with pytest.raises(RuntimeError, match="killed"):
        store.add_chunks(rows(spark, 1, 2, 3), "b")
    monkeypatch.undo()
    assert held(store) == [(1, "s", 1)]
    rows(spark, 2).withColumn("id", S.F.lit(2).cast("long")).write.parquet(f"{store.path}/chunks/batch=b")
    assert store.add_chunks(rows(spark, 1, 2, 3), "b") == 2
    assert held(store) == [(1, "s", 1), (2, "s", 2), (3, "s", 3)]


def test_many_rows_have_ids_without_gaps(spark, store):
    big = spark.range(5000).selectExpr(
        "concat('s', id % 7) AS source", "cast(id AS int) AS chunk_index", "'' AS heading", "'t' AS content", "sha2(cast(id % 4000 AS string), 256) AS content_hash", "array(cast(1 AS float)) AS embedding", "1 AS dim"
    )
    assert store.add_chunks(big.where("chunk_index < 1000")) == 1000 and store.add_chunks(big) == 3000
    got = store.chunks().orderBy("id").select("id", "source", "chunk_index").collect()
    assert [r.id for r in got] == list(range(1, 4001))
    assert [(r.source, r.chunk_index) for r in got[1000:]] == sorted((r.source, r.chunk_index) for r in got[1000:])


def test_stored_rows_are_not_shuffled(spark, store):
    store.add_chunks(rows(spark, *range(40)), "a")
    store.add_chunks(rows(spark, *range(30, 90)), "b")
    with store.bucketed() as stored:
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            fresh = store.fresh(rows(spark, 5, 85, 200, 201), stored)
            plan = fresh._jdf.queryExecution().executedPlan().toString()
            assert fresh.count() == 2
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert "Exchange" not in plan[plan.index("FileScan") - 200 :]  # the stored side is the last branch


def test_bucket_number_stays(spark, store):
    store.add_chunks(rows(spark, 1, 2, 3))
    other = S.Store(spark, store.path, buckets=7)
    assert other.add_chunks(rows(spark, 2, 3, 4)) == 1
    assert S.get_meta(other.meta(), "chunk_buckets") == "3"
    other.reset()
    assert other.chunks().count() == 0 and other.add_chunks(rows(spark, 1)) == 1
    assert held(other) == [(1, "s", 1)]
