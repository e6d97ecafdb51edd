import pytest

from tamarisk.operators import answer as A
from tamarisk.operators import groundedness as G
from tamarisk.operators.backends import HashingBackend, create_backend

PASSAGE = "Kahve çekirdekleri Etiyopya dağlarında yetişir. Kahve sıcak suyla demlenir ve fincanda sunulur."


@pytest.fixture
def hits(spark):
    rows = [(1, 1, "kahve.md", "Kahve", PASSAGE, 0.9), (1, 2, "kedi.md", "", "Kediler günün büyük bölümünü uyuyarak geçirir ve fare yakalar.", 0.5)]
    return spark.createDataFrame(rows, "qid long, rank int, source string, heading string, content string, score double")


def passages(hits):
    from pyspark.sql import functions as F

    return hits.select("qid", "rank", "source", F.concat("heading", F.lit("\n"), "content").alias("passage"))


def answers(spark, *texts):
    return spark.createDataFrame([(1, t) for t in texts], "qid long, answer string")


def test_verbatim_is_supported_and_fabricated_is_not(spark, hits):
    good = G.report(answers(spark, PASSAGE), passages(hits)).first()
    assert (good.score, good.is_clean, good.n_sentences) == (1.0, True, 2)
    bad = G.report(answers(spark, "Ay yüzeyinde peynir madenleri işleten robotlar yaşamaktadır."), passages(hits)).first()
    assert bad.score == 0.0 and bad.n_unsupported == 1 and bad.trustworthy


def test_a_share_of_exactly_the_threshold_is_supported(spark):
    words = [a + b + "k" for a in ("ba", "de", "gu", "ko", "mi", "nu", "po", "ra", "si", "tu") for b in ("lor", "zan")]
    for ranks in (1, 2, 3, 4):  # every term weighs the same, 9 of 20 are covered, and sums of doubles fall on either side of 0.45
        hits = spark.createDataFrame([(1, r, f"s{r}", " ".join(words[:9]) if r == 1 else "") for r in range(1, ranks + 1)], "qid long, rank int, source string, passage string")
        for said in (words, words + words):
            v = G.verdicts(answers(spark, " ".join(said)), hits).first()
            assert v.supported and v.score == pytest.approx(0.45)


def test_best_source_and_edge_cases(spark, hits):
    v = G.verdicts(answers(spark, "Kediler günün büyük bölümünü uyuyarak geçirir."), passages(hits)).first()
    assert v.best_source == "kedi.md" and v.supported
    none = G.report(answers(spark, "Evet."), passages(hits)).first()
    assert (none.score, none.degenerate, none.summary) == (1.0, False, "Denetlenecek cumle yok.")
    empty = G.report(answers(spark, PASSAGE), passages(hits).limit(0)).first()
    assert empty.score == 0.0 and empty.n_unsupported == 2
    assert G.report(answers(spark, None), passages(hits)).first().score == 1.0


def test_quotes(spark, hits):
    q = spark.createDataFrame([(1, "Kahve nerede yetişir?"), (2, "Uzay gemisi?")], "qid long, question string")
    got = {r.qid: r.answer for r in A.extract_answer(q, hits, notice="!").collect()}
    assert got[1].startswith("Kahve çekirdekleri Etiyopya dağlarında yetişir. [kahve.md]") and got[1].endswith("!")
    assert got[2] == A.NO_ANSWER
    chat = {r.qid: r.answer for r in HashingBackend().chat(q, hits).collect()}
    assert "[kahve.md]" in chat[1] and chat[2] == A.NO_ANSWER


def test_prompts_and_sources(spark, hits):
    assert A.format_context(hits).first().context == f"[1] Kaynak: kahve.md | Bölüm: Kahve\n{PASSAGE}\n\n---\n\n[2] Kaynak: kedi.md\nKediler günün büyük bölümünü uyuyarak geçirir ve fare yakalar."
    q = spark.createDataFrame([(1, " Soru? ")], "qid long, question string")
    m = A.build_messages(q, hits, "English").first().messages
    assert [x.role for x in m] == ["system", "user"] and "English" in m[0].content and "SORU: Soru?" in m[1].content
    assert A.answer_sources(hits.unionByName(hits)).first().sources == ["kahve.md", "kedi.md"]


def test_backends():
    assert create_backend().signature == "hashing-offline:512"
    with pytest.raises(ValueError):
        create_backend("nothing")
