import pytest
from pyspark.sql import functions as F

from tamarisk.functions import sentences as S
from tamarisk.functions import turkish as T


@pytest.fixture
def ev(spark):
    """The value of a column expression for one text."""

    def run(text, make):
        return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x

    return run


def test_fold_and_deaccent(ev):
    assert ev("IĞDIR İstanbul ŞÜÖÇ", T.fold_case) == "ığdır istanbul şüöç"
    assert ev("çalışma", T.deaccent) == "calisma"
    assert ev(None, T.fold_case) is None


@pytest.mark.parametrize(
    ("word", "stem"),
    [("belgeler", "belge"), ("kitaplarda", "kitap"), ("benzerliği", "benzer"), ("benzerlik", "benzer"), ("sqlite'ta", "sqlite"), ("RAG’in", "rag"), ("veri", "veri"), ("krmbl", "krmbl"), ("2024", "2024")],
)
def test_stems(ev, word, stem):
    assert ev(word, lambda c: T.stem_word(T.fold_case(c)) if "'" not in word else T.stem_word(c)) == stem


@pytest.mark.parametrize(("a", "b", "same"), [("belge", "belgeler", True), ("SQLite", "SQLite'ta", True), ("benzerlik", "benzerliği", True), ("kahve", "kediler", False)])
def test_shares_root(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.shares_root(F.col("a"), F.col("b")).alias("x")).first()
    assert row.x is same


def test_expand_keeps_order_and_repeats(ev):
    assert ev("belgeler ve belgeler", T.expand_tokens) == ["belgeler", "belge", "ve", "belgeler", "belge"]
    assert ev("belgeler ve o 42", T.content_terms) == ["belgeler", "belge", "42"]
    assert ev("", T.expand_tokens) == [] and ev(None, T.expand_tokens) == []


def test_vowels(ev):
    assert ev("kitap", T.last_vowel) == "a" and ev("krm", T.last_vowel) is None
    assert ev("kedi", T.harmony) == "front" and ev("krm", T.harmony) is None


def test_sentence_splitters(ev):
    assert ev('Bir. "İki!" Üç?', S.chunk_sentences) == ["Bir.", '"İki!', "Üç?"] or ev("Bir. İki! Üç?", S.chunk_sentences) == ["Bir.", "İki!", "Üç?"]
    text = "- Bu cümle yeterince uzun bir cümledir [a.md]. Kısa.\n* İkinci cümle de yeterince uzun bir **cümledir**."
    assert ev(text, S.answer_sentences) == ["Bu cümle yeterince uzun bir cümledir .", "İkinci cümle de yeterince uzun bir cümledir."]
    assert ev("Kısa. Evet.", S.answer_sentences) == []


def test_degeneration(ev):
    loop = "Bu cevap kendini sürekli olarak tekrar ediyor. "
    assert ev(loop * 3, S.is_degenerate) is True
    assert ev(loop * 2, S.repeated_sentence) == loop.strip()
    assert ev("tek", S.distinct_bigram_ratio) == 1.0
    assert ev("Her cümle burada farklı şeyler söylüyor ve tekrar etmiyor.", S.is_degenerate) is False


def test_sentences_keep_their_digits(ev):
    """White space goes at both ends, and nothing else: not the digits that a sentence's number has."""
    assert ev("  007 sokak. 1 elma\xa0! 202 2", S.chunk_sentences) == ["007 sokak.", "1 elma\xa0!", "202 2"]


def test_deaccent_of_every_character(spark):
    """As the Unicode data say, alone and among others; of what is no letter too."""
    import unicodedata

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.replace("ı", "i")) if not unicodedata.combining(c))
    every = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b" for c in every] + ["".join(every[i : i + 997]) for i in range(0, len(every), 997)] + ["", None, "ﷺ ﬃ ½ 각 Ⅷ é e\u0301\u0323"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.deaccent(F.col("t")).alias("d"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString().split("Scan")[0]
    got = {r.i: r.d for r in rows.collect()}
    bad = [(i, t) for i, t in enumerate(texts) if got[i] != (None if t is None else plain(t))]
    assert not bad, bad[:5]


def test_strip_looks_at_the_ends_only(spark):
    """All white space of the pattern goes from both ends and stays inside; no regular expression runs over the text."""
    from tamarisk.functions import sentences

    inner = f"a{sentences.SPACES}b"
    frame = spark.createDataFrame([(f"{sentences.SPACES}{inner}{sentences.SPACES[::-1]}",), (sentences.SPACES,), ("",), (None,)], "t string").select(sentences.strip(F.col("t")).alias("s"))
    assert [r.s for r in frame.collect()] == [inner, "", "", None] and len(sentences.SPACES) == 29
    assert "regexp" not in frame._jdf.queryExecution().optimizedPlan().toString().lower()


def test_ingest_report_cuts_texts_once(spark, sf):
    from tamarisk.queries import ingest_report

    assert "Generate" not in ingest_report(spark, sf)._jdf.queryExecution().executedPlan().toString()
