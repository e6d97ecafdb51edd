import hashlib
import uuid

from tamarisk.llm.exact_dedup import DigestIndex, exact_dedup

from .conftest import EDGES


def test_longest_then_smallest_id_stays(docs):
    rows = [(5, "ab c"), (3, "a b c"), (2, "a bc"), (9, "x"), (4, "a bc")]
    got = {r.doc_id: r for r in exact_dedup(docs(rows)).collect()}
    assert {i: r.keep_id for i, r in got.items()} == {5: 3, 3: 3, 2: 3, 9: 9, 4: 4}
    assert [i for i, r in got.items() if r.kept] == sorted([3, 9, 4], key=list(got).index) and got[2].group_size == 3
    assert got[3].text_sha256 == hashlib.sha256(b"abc").hexdigest()


def test_edges(docs):
    got = exact_dedup(docs(EDGES)).collect()
    assert len(got) == len(EDGES) and sum(r.kept for r in got) == 4
    blank = [r for r in got if r.group_size == 3 and r.doc_id in (1, 2, 3)]
    assert {r.keep_id for r in blank} == {3}
    assert {r.keep_id for r in got if r.text_sha256 == hashlib.sha256(b"ab").hexdigest()} == {4}
    assert exact_dedup(docs([])).count() == 0


def test_index_grows_and_is_bucketed(spark, docs):
    index = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
    index.ingest(docs([(1, "a"), (2, "b")])).collect()
    again = {r.doc_id: r for r in index.ingest(docs([(7, "a  "), (8, "c"), (9, "c")])).collect()}
    assert again[7].keep_id == 1 and not again[7].kept and again[8].kept and not again[9].kept
    assert sorted(r.doc_id for r in index.entries().collect()) == [1, 2, 8]
    detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {index.name}").collect()}
    assert detail["Num Buckets"] == "4" and detail["Sort Columns"] == "[`digest`]"


def test_a_batch_that_is_tried_again(spark, docs):
    index = DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4)
    index.ingest(docs([(1, "a")]), batch="one").collect()
    for _ in range(2):
        got = {r.doc_id: r.kept for r in index.ingest(docs([(2, "b"), (3, "a")]), batch="two").collect()}
        assert got == {2: True, 3: False}
    assert sorted(r.doc_id for r in index.entries().collect()) == [1, 2]
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_batches_of_falling_length_change_nothing(spark, docs, sf):
    """Equal texts in different batches: the longest stays, through the index; ids and sizes are those of one batch."""
    rows = [(9, "a" * 20), (1, "a " * 20), (2, "a" * 10 + " " * 40 + "a" * 10), (3, "b"), (4, "b" + " " * 30), (5, "b" + " " * 30), (None, "c" + " " * 60), (6, "c")]
    key = lambda r: (r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept, r.text_sha256)
    got = sorted(map(key, exact_dedup(docs(rows), steps=(50, 25)).collect()))
    assert got == sorted(map(key, exact_dedup(docs(rows), steps=()).collect()))
    assert {(i, k) for i, k, *_ in got} == {(9, 2), (1, 2), (2, 2), (3, 4), (4, 4), (5, 4), (0, 0), (6, 0)}
    real = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(key, exact_dedup(real).collect())) == sorted(map(key, exact_dedup(real, steps=()).collect()))
