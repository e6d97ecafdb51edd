"""Ingestion and answering: whole DataFrames of documents and of questions."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import chunk_documents
from ..operators import answer as A
from ..operators.backends import Backend, ChatOptions, create_backend
from ..operators.dense import search_top_k
from ..operators.groundedness import report, verdicts
from ..operators.hybrid import hybrid_search, pooled_scores
from ..operators.lexical import BM25Index
from ..sources.documents import scan_documents
from ..sources.store import Store, content_hash
from .settings import Settings

MULTIPLIER = 5


def embed_chunks(chunks: DataFrame, backend: Backend) -> DataFrame:
    """Chunk rows with their hash, embedding and width, ready to be stored."""
    text = A.embedding_text(F.col("heading"), F.col("content"))
    out = chunks.withColumn("content_hash", content_hash(F.col("source"), F.col("heading"), F.col("content"))).withColumn("embedding", backend.embed(text))
    return out.withColumn("dim", F.size("embedding"))


def ingest(spark: SparkSession, settings: Settings, backend: Backend | None = None, reset: bool = True) -> dict:
    """Scans, chunks, embeds and stores a folder; returns documents, chunks, inserted, seconds, skipped.

    Blank documents and documents without chunks are skipped. No chunk at all is a ValueError.
    """
    settings.validate()
    began, backend = time.perf_counter(), backend or create_backend(settings.backend)
    docs = scan_documents(spark, settings.docs_dir).cache()
    chunks = chunk_documents(docs, settings.chunk_size, settings.chunk_overlap).cache()
    n_chunks = chunks.count()
    if not n_chunks:
        raise ValueError(f"no chunks in {settings.docs_dir}")
    store = Store(spark, settings.index_dir)
    if reset:
        store.reset()
    inserted = store.add_chunks(embed_chunks(chunks, backend))
    n_docs = docs.count()
    store.set_meta({"embedding_signature": backend.signature, "chunk_size": settings.chunk_size, "chunk_overlap": settings.chunk_overlap, "backend": settings.backend, "document_count": n_docs})
    row = skipped(docs, chunks).agg(F.sort_array(F.collect_list("label")).alias("s")).first()
    chunks.unpersist()
    docs.unpersist()
    return {"documents": n_docs, "chunks": n_chunks, "inserted": inserted, "seconds": time.perf_counter() - began, "skipped": row.s}


def skipped(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(label) of each document that gives no chunk, with the reason."""
    without = docs.join(chunks.select("source").distinct(), "source", "left_anti")
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", " ")) == ""
    return without.select(F.concat("source", F.when(blank, " (bos)").otherwise(" (parca uretilemedi)")).alias("label"))


def summary(report: dict) -> str:
    line = f"{report['documents']} belge -> {report['chunks']} parca ({report['inserted']} yeni kayit) / {report['seconds']:.1f} sn"
    return line + (f"\nAtlanan dosyalar: {', '.join(report['skipped'])}" if report["skipped"] else "")


class RagPipeline:
    """An open index: postings and what answers are made of are kept until ``close``."""

    def __init__(self, spark: SparkSession, settings: Settings, backend: Backend | None = None):
        settings.validate()
        self.spark, self.settings = spark, settings
        self.backend = backend or create_backend(settings.backend)
        store = Store(spark, settings.index_dir)
        store.verify(self.backend.signature)
        self.chunks = store.chunks()
        self.vectors = self.chunks.select("id", F.col("embedding").alias("v")).cache()
        self._scratch = store.scratch()
        self.bm25 = BM25Index.build(self.chunks, "id", A.lexical_text(F.col("heading"), F.col("content")), self._hold) if settings.hybrid else None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        """Deletes what answers left in the index's scratch folder and releases the vectors and the backend."""
        self.vectors.unpersist()
        self._scratch.clear()
        closer = getattr(self.backend, "close", None)
        if closer:
            closer()

    def _hold(self, table: DataFrame) -> DataFrame:
        return self._scratch.keep(table)

    @property
    def chat_options(self) -> ChatOptions:
        s = self.settings
        return ChatOptions(s.temperature, s.max_tokens, s.answer_language)

    def scores(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(qid, id, score) by meaning and by words, of each question's dense and lexical pool."""
        asked = questions.select("qid", "question", self.backend.embed(F.col("question")).alias("q"))
        pool = max(self.settings.top_k * MULTIPLIER, self.settings.top_k)
        if not self.bm25:
            lexical = self.spark.createDataFrame([], "qid long, id long, score double")
            return self._hold(search_top_k(asked, self.vectors, pool, -2.0).drop("rank")), lexical
        # a candidate of one pool has the score of the other kind too: the gate needs it
        return pooled_scores(self.bm25, self._hold(asked), self.vectors, pool, self._hold)

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """Hits of every (qid, question): qid, rank, id, scores, matched_by, source, chunk_index, heading, content."""
        s = self.settings
        hits = hybrid_search(*self.scores(questions), s.top_k, s.min_similarity, lexical_scale=s.lexical_scale, candidate_multiplier=MULTIPLIER)
        return hits.join(self.chunks.select("id", "source", "chunk_index", "heading", "content"), "id")

    def answer(self, questions: DataFrame) -> DataFrame:
        """One row for every (qid, question), with what is needed to audit it.

        qid, question, text, grounded, mode, score, degenerate, summary, sources (first seen first),
        hits, verdicts (one a sentence of the answer that was audited), retrieval_seconds and
        generation_seconds (of the whole batch of questions). Blank questions and questions without
        hits never reach the chat model. In mode ``auto``, a generated answer whose audit is below
        ``min_groundedness`` or degenerate is replaced by quotes. Intermediate results stay in
        the index's scratch folder until ``close``.
        """
        s = self.settings
        began = time.perf_counter()
        asked = questions.select("qid", F.btrim(F.coalesce("question", F.lit(""))).alias("question"))
        real = asked.where(F.col("question") != "")
        hits = self._hold(self.retrieve(real))
        retrieved = time.perf_counter()
        with_hits = real.join(hits.select("qid").distinct(), "qid", "left_semi")
        quoted = A.extract_answer(with_hits, hits)
        quoting = s.answer_mode == "extractive"
        said = self._hold(quoted if quoting else self.backend.chat(with_hits, hits, self.chat_options))
        seconds = retrieved - began, 0.0 if quoting else time.perf_counter() - retrieved
        passages = hits.select("qid", "rank", "source", A.lexical_text(F.col("heading"), F.col("content")).alias("passage"))
        if s.check_groundedness:
            judged = self._hold(verdicts(said, passages))
            audit = report(said, passages, judged=judged).select("qid", "score", "degenerate", "summary")
        else:
            judged = self.spark.createDataFrame([], "qid long, pos int, sentence string, score double, supported boolean, best_source string")
            audit = self.spark.createDataFrame([], "qid long, score double, degenerate boolean, summary string")
        joined = (
            asked.join(_listed(hits, "hits", ("rank", "id", "source", "chunk_index", "heading", "content", "score", "dense_score", "lexical_score", "fused_score", "matched_by")), "qid", "left")
            .join(said.withColumnRenamed("answer", "said"), "qid", "left").join(audit, "qid", "left")
            .join(_listed(judged, "verdicts", ("pos", "sentence", "score", "supported", "best_source")), "qid", "left").join(A.answer_sources(hits), "qid", "left")
        )
        if s.answer_mode == "auto":
            joined = joined.join(quoted.withColumnRenamed("answer", "quote"), "qid", "left")
        else:
            joined = joined.withColumn("quote", F.col("said"))
        n = F.coalesce(F.size("hits"), F.lit(0))
        mode = A.answer_mode(F.col("question"), n, s.answer_mode, F.coalesce("score", F.lit(1.0)), F.coalesce("degenerate", F.lit(False)), s.check_groundedness, s.min_groundedness)
        text = (
            F.when(F.col("mode") == "blank", A.BLANK_QUESTION).when(F.col("mode") == "no-context", A.NO_ANSWER).when(F.col("mode") == "extractive", F.col("quote"))
            .when(F.col("mode") == "extractive-fallback", F.concat("quote", F.lit(A.FALLBACK_NOTICE))).otherwise(F.coalesce(F.nullif(F.btrim("said"), F.lit("")), F.lit(A.NO_ANSWER)))
        )
        out = joined.withColumn("mode", mode)
        return out.select(
            "qid", "question", text.alias("text"), (n > 0).alias("grounded"), "mode", "score", "degenerate", "summary", "sources", "hits", "verdicts",
            F.lit(seconds[0]).alias("retrieval_seconds"), F.lit(seconds[1]).alias("generation_seconds"),
        )

    def stream_answer(self, question: str) -> Iterator[str]:
        """One answer as the backend makes it; as in an interactive session it is neither audited nor replaced by quotes.

        A backend without ``stream_chat`` gives its answer in one piece.
        """
        text = (question or "").strip()
        if not text:
            yield A.BLANK_QUESTION
            return
        asked = self.spark.createDataFrame([(0, text)], "qid long, question string")
        hits = self._hold(self.retrieve(asked))
        if hits.isEmpty():
            yield A.NO_ANSWER
            return
        stream = getattr(self.backend, "stream_chat", None)
        if stream is not None:
            yield from stream(asked, hits, self.chat_options)
        else:
            yield self.backend.chat(asked, hits, self.chat_options).first().answer or A.NO_ANSWER


def _listed(rows: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    """(qid, name): a question's rows as an array, by their first column. There are as many as ``top_k``, or as an answer has sentences."""
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
