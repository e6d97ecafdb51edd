import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tamarisk.functions import chunking as C
from tamarisk.functions.chunking import chunk_documents

from .chunk_rules import chunk_document, chunk_text, sections, tail

WORDS = st.lists(st.text("abç. ", min_size=1, max_size=30), max_size=40).map("\n\n".join)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.integers(20, 90), st.integers(0, 19))
def test_chunks_stay_within_size_and_overlap(text, size, overlap):
    chunks = chunk_text(text, size, overlap)
    assert all(c and c == c.strip() and len(c) <= size + overlap + 2 for c in chunks)
    assert bool(chunks) == bool(text.strip())


def test_overlap_is_carried_from_a_word_start():
    chunks = chunk_text("\n\n".join(f"paragraf {i} burada biraz metin var" for i in range(12)), 100, 30)
    assert len(chunks) > 2
    for a, b in zip(chunks, chunks[1:], strict=False):
        assert b.startswith(tail(a, 30))
    assert tail("abc def", 0) == "" and tail("abc", 9) == "abc" and tail("xx abc def", 6) == "def"


def test_long_sentence_is_cut_and_bad_sizes_are_errors(spark):
    assert max(map(len, chunk_text("x" * 500, 100, 10))) <= 112
    with pytest.raises(ValueError):
        C.chunk_text(F.lit("a"), 10, 10)


def test_sections():
    text = "önce\n# Bir\n\n## İki\nmetin\n#Değil\n"
    assert list(sections(text)) == [("", "önce"), ("Bir", ""), ("İki", "metin\n#Değil")]


def test_documents(spark):
    docs = spark.createDataFrame([("a.md", "# B\nx\n\ny"), ("b.md", None), ("c.md", "  \n"), ("d.md", "# only")], "source string, text string")
    got = sorted(tuple(r) for r in chunk_documents(docs).collect())
    assert got == [("a.md", 0, "B", "x\n\ny")]


def texts():
    """Random documents of every mark that the rules know, in lines, paragraphs and sentences of all lengths."""
    rng = random.Random(5)
    parts = ["# Bir", "## İki  ", "#Değil", "###\t", "####### yedi", "", " ", "\t", "uzun " * 30, "Kısa.", 'Dedi: "Evet." Sonra', "a.) b", "x" * 70, "s\xa0.\u2003t", "…! ", "c1. c2? c3!", "\x1c", "bir iki üç dört beş altı. " * 4]
    ends = ["\n", "\n", "\n\n", "\r\n", "\r", "\x0b", "\x85", "\u2028", "\n \n", " "]
    return ["".join(rng.choice(parts) + rng.choice(ends) for _ in range(rng.randint(0, 25))) for _ in range(400)]


@pytest.mark.parametrize(("size", "overlap"), [(900, 150), (60, 20), (25, 0), (40, 39)])
def test_as_the_plain_rules(spark, size, overlap):
    docs = [(str(i), t) for i, t in enumerate(texts())]
    got: dict = {}
    for r in chunk_documents(spark.createDataFrame(docs, "source string, text string"), size, overlap).collect():
        got.setdefault(r.source, []).append((r.chunk_index, r.heading, r.content))
    for source, text in docs:
        assert sorted(got.get(source, [])) == chunk_document(text, size, overlap), repr(text)


def test_real_documents_as_the_plain_rules(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", C.chunk_text(F.col("text"), 200, 50).alias("c")).collect()
    got = {r.doc_id: r.c for r in found}
    assert all(got[r.doc_id] == chunk_text(r.text, 200, 50) for r in rows)


def test_no_python_in_the_plan(spark):
    plan = chunk_documents(spark.createDataFrame([("a", "b")], "source string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_long_document(spark):
    """Two million characters in many sections, and as many in one paragraph."""
    many = "".join(f"# B{i}\n" + "Bir cümle daha burada duruyor. " * 30 + "\n\n" for i in range(2000))
    for text in (many, "Bir cümle daha burada duruyor. " * 65_000):
        got = chunk_documents(spark.createDataFrame([("a", text)], "source string, text string"))
        assert got.count() == len(chunk_document(text))
