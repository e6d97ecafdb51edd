"""Answers from hits: quoting, prompts, source lists, and the decision between quoting and generating.

Questions are (qid, question); hits are (qid, rank, source, heading, content, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sentences import quote_sentences
from ..functions.terms import counted_content

# Texts that answers and prompts are made of, refusal markers, thresholds.
NO_ANSWER = "Bu bilgi elimdeki belgelerde yok."
BLANK_QUESTION = "Lutfen bir soru yaz."
FALLBACK_NOTICE = "\n\n(Not: Üretilen cevap getirilen belgelerde doğrulanamadığı için belgelerden doğrudan alıntı yapıldı.)"
SYSTEM_PROMPT = """Görevin, soruları yalnızca aşağıda BAĞLAM başlığıyla verilen belge parçalarından yanıtlamaktır.

Uyman gerekenler:
- Bağlamda yazmayan hiçbir bilgiyi ekleme; bildiğini sandığın şeyleri de kullanma.
- Bağlam soruyu yanıtlamıyorsa yalnızca "Bu bilgi elimdeki belgelerde yok." yaz.
- Her bilginin ardından geldiği dosyayı köşeli parantezle göster, örneğin [notlar.md].
- Lafı uzatmadan, doğrudan yanıtla başla.
- Yanıtın dili: {language}.
"""
LEAST_RELEVANCE, LEAST_GROUNDED = 0.08, 0.34


def citation(source: Column, heading: Column) -> Column:
    return F.when(heading != "", F.concat(source, F.lit(" > "), heading)).otherwise(source)


def embedding_text(heading: Column, text: Column) -> Column:
    return F.when(heading != "", F.concat(heading, F.lit("\n\n"), text)).otherwise(text)


def lexical_text(heading: Column, text: Column) -> Column:
    return F.concat(heading, F.lit("\n"), text)


def sentence_relevance(question_terms: Column, sentence: Column) -> Column:
    """Share of the question's distinct content terms that a sentence has; 0 if the question has none."""
    n, said = F.size(question_terms), F.transform(counted_content(sentence), lambda x: x["term"])
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(question_terms, said)) / F.greatest(n, F.lit(1)))


def extract_scores(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, rank, pos, sentence, source, relevance, weighted) of sentences that reach the relevance floor."""
    asked = questions.select("qid", F.transform(counted_content(F.col("question")), lambda x: x["term"]).alias("terms"))
    quoted = hits.select("qid", "rank", "source", F.posexplode(quote_sentences(F.col("content"))).alias("pos", "sentence"))
    scored = quoted.join(asked, "qid").withColumn("relevance", sentence_relevance(F.col("terms"), F.col("sentence"))).where(F.col("relevance") >= LEAST_RELEVANCE)
    return scored.select("qid", "rank", "pos", "sentence", "source", "relevance", (F.col("relevance") * (0.5 + 0.5 / F.col("rank"))).alias("weighted"))


def extract_answer(questions: DataFrame, hits: DataFrame, most: int = 3, notice: str = "") -> DataFrame:
    """(qid, answer): the best distinct sentences with their sources, a line each; NO_ANSWER if there are none."""
    order = (F.desc("weighted"), F.asc("rank"), F.asc("pos"))
    first = Window.partitionBy("qid", "sentence").orderBy(*order)
    best = Window.partitionBy("qid").orderBy(*order)
    scored = extract_scores(questions, hits).withColumn("weighted", F.round("weighted", 12))
    picked = scored.withColumn("again", F.row_number().over(first)).where("again = 1").withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    lines = picked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("sentence", F.lit(" ["), "source", F.lit("]")).alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return questions.select("qid").join(lines, "qid", "left").select("qid", F.when(F.col("l").isNull(), NO_ANSWER).otherwise(F.concat(text, F.lit(notice))).alias("answer"))


def format_context(hits: DataFrame) -> DataFrame:
    """(qid, context): numbered passages with source and heading."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Kaynak: "), "source", F.when(F.col("heading") != "", F.concat(F.lit(" | Bölüm: "), "heading")).otherwise(""))
    blocks = hits.select("qid", F.struct("rank", F.concat(head, F.lit("\n"), "content").alias("b")).alias("x"))
    return blocks.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def build_messages(questions: DataFrame, hits: DataFrame, language: str = "Türkçe") -> DataFrame:
    """(qid, messages): system and user turn of each question."""
    user = F.concat(F.lit("BAĞLAM:\n"), F.coalesce("context", F.lit("")), F.lit("\n\n---\n\nSORU: "), F.btrim("question"),
                    F.lit("\n\nYukarıdaki bağlamı kullanarak soruyu cevapla ve kaynakları belirt."))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    system = F.lit(SYSTEM_PROMPT.replace("{language}", language))
    return questions.join(format_context(hits), "qid", "left").select("qid", F.array(message("system", system), message("user", user)).alias("messages"))


def answer_sources(hits: DataFrame) -> DataFrame:
    """(qid, sources): distinct sources in the order in which they first appear."""
    first = hits.groupBy("qid", "source").agg(F.min("rank").alias("rank"))
    return first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("sources"))


def answer_mode(question: Column, n_hits: Column, mode: str, grounded: Column, degenerate: Column, audit: bool = True, least: float = LEAST_GROUNDED) -> Column:
    """Which kind of answer a question gets."""
    broken = ((grounded < least) | degenerate) if mode == "auto" and audit else F.lit(False)
    return (
        F.when(F.btrim(F.coalesce(question, F.lit(""))) == "", "blank").when(n_hits == 0, "no-context")
        .when(F.lit(mode) == "extractive", "extractive").when(broken, "extractive-fallback").otherwise("generative")
    )
