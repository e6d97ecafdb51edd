"""Embedding and chat backends: an interface, the offline hashing backend, and a registry."""

from __future__ import annotations

import atexit
import inspect
import warnings
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.hashing import DIM, SIGNATURE, hash_embed
from ..functions.vectors import dot
from .answer import NO_ANSWER, build_messages


@dataclass(frozen=True)
class ChatOptions:
    """What a chat model is told besides the messages."""

    temperature: float = 0.1
    max_tokens: int = 600
    language: str = "Türkçe"


class Backend(Protocol):
    """``embed`` maps a text column to a vector column; ``chat`` answers (qid, question) from hits as (qid, answer).

    Optional hooks: ``stream_chat(questions, hits, options)`` yields the pieces of one answer as
    they are made, ``close()`` releases what the backend holds.
    """

    signature: str
    dim: int

    def embed(self, text: Column) -> Column: ...

    def chat(self, questions: DataFrame, hits: DataFrame, options: ChatOptions = ChatOptions()) -> DataFrame: ...


class HashingBackend:
    """Deterministic and offline: hashed features, and quotes instead of generation."""

    signature, dim = SIGNATURE, DIM
    notice = "\n\n(Not: Bu cevap bir dil modeli tarafından yazılmadı; belgelerden doğrudan alıntılandı.)"

    def embed(self, text: Column) -> Column:
        return hash_embed(text)

    def chat(self, questions: DataFrame, hits: DataFrame, options: ChatOptions = ChatOptions()) -> DataFrame:
        """The three sentences nearest to the question by embedding, then those over 0.05, with their sources."""
        cut = F.filter(F.transform(F.split("content", r"(?<=[.!?…])\s+"), lambda s: F.btrim(s)), lambda s: F.length(s) > 20)
        said = hits.select("qid", "rank", "source", F.posexplode(cut).alias("pos", "sentence"))
        said = said.withColumn("v", hash_embed(F.col("sentence"))).join(questions.select("qid", hash_embed(F.col("question")).alias("q")), "qid")
        scored = said.select("qid", "rank", "pos", "sentence", "source", dot(F.col("q"), F.col("v")).alias("score"))
        w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "rank", "pos")
        best = scored.withColumn("place", F.row_number().over(w)).where("place <= 3 AND score > 0.05")
        lines = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("sentence", F.lit(" ["), "source", F.lit("]")).alias("line")))).alias("l"))
        text = F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(self.notice))
        return questions.select("qid").join(lines, "qid", "left").select("qid", F.when(F.col("l").isNull(), NO_ANSWER).otherwise(text).alias("answer"))


class UdfBackend:
    """Any Python model. ``embed_fn`` takes a list of texts and ``chat_fn`` a list of message lists; both run on Arrow batches.

    ``chat_fn`` gets those of ``temperature`` and ``max_tokens`` that it names as parameters.
    ``stream_fn``, if given, takes one message list on the driver and yields the pieces of its answer.
    """

    def __init__(self, name: str, dim: int, embed_fn, chat_fn, stream_fn=None):
        self.signature, self.dim, self._embed, self._chat = f"{name}:{dim}", dim, embed_fn, chat_fn
        if stream_fn is not None:
            self.stream_chat = lambda questions, hits, options=ChatOptions(): stream_fn(_plain(build_messages(questions, hits, options.language).first().messages))

    def embed(self, text: Column) -> Column:
        embed_fn = self._embed

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            vectors = [np.asarray(v, dtype=np.float32) for v in embed_fn(texts.fillna("").tolist())]
            if not all(np.isfinite(v).all() for v in vectors):
                raise ValueError("the embedding has values that are not finite")
            return pd.Series([v.tolist() for v in vectors])

        return run(text)

    def chat(self, questions: DataFrame, hits: DataFrame, options: ChatOptions = ChatOptions()) -> DataFrame:
        chat_fn = self._chat
        named = inspect.signature(chat_fn).parameters
        passed = {k: getattr(options, k) for k in ("temperature", "max_tokens") if k in named}

        def run(batches):
            for b in batches:
                yield pd.DataFrame({"qid": b["qid"], "answer": chat_fn([_plain(x) for x in b["messages"]], **passed)})

        return build_messages(questions, hits, options.language).mapInPandas(run, "qid long, answer string")


class ModelBackend:
    """A model that each Python worker loads once, when it first needs it.

    ``load`` gives an object with ``embed(texts) -> vectors`` (and ``chat(messages) -> answer`` if it can
    answer); texts go to it ``batch`` at a time. Vectors that are not finite, or not ``dim`` wide, are asked for once
    more, of the model that ``fallback`` loads if given (say, on another device). A row that fails again, or whose
    batch raises, has an error instead of a vector: one bad text doesn't end the job. If a loaded model has
    ``close``, it is called when its worker ends.
    """

    def __init__(self, name: str, dim: int, load, fallback=None, batch: int = 16):
        self.signature, self.dim, self.load, self.fallback, self.batch = f"{name}:{dim}", dim, load, fallback, batch

    def embed_checked(self, text: Column) -> Column:
        """struct<vector, error>: one of them is null. Null text counts as empty."""
        from pyspark.ml.functions import predict_batch_udf

        load, fallback, dim = self.load, self.fallback, self.dim

        def prepare():
            first, again = _once(load), _once(fallback or load)

            def tried(model, texts: list[str]) -> np.ndarray:
                out = np.full((len(texts), dim), np.nan, np.float32)
                try:
                    found = model().embed(texts)
                except Exception:  # which of the texts it was is found out one by one
                    if len(texts) > 1:
                        return np.concatenate([tried(model, [t]) for t in texts])
                    return out
                for row, vector in zip(out, found, strict=True):
                    if np.shape(vector) == (dim,):
                        row[:] = vector
                return out

            def predict(texts: np.ndarray) -> np.ndarray:
                texts = [t or "" for t in texts.tolist()]
                out = tried(first, texts)
                if len(bad := np.flatnonzero(~np.isfinite(out).all(axis=1))):
                    out[bad] = tried(again, [texts[i] for i in bad])
                return out

            return predict

        run = predict_batch_udf(prepare, return_type=ArrayType(FloatType()), batch_size=self.batch)
        finite = lambda v: ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
        checked = lambda v: F.struct(F.when(finite(v), v).alias("vector"), F.when(~finite(v), F.lit("no finite vector after a second try")).alias("error"))
        return F.get(F.transform(F.array(run(F.coalesce(text, F.lit("")))), lambda v: checked(v)), F.lit(0))

    def embed(self, text: Column) -> Column:
        """The vectors; a row without one ends the job, as an index can't hold it."""
        return F.get(F.transform(F.array(self.embed_checked(text)), lambda r: F.when(r["error"].isNull(), r["vector"]).otherwise(F.raise_error(r["error"]).cast("array<float>"))), F.lit(0))

    def chat(self, questions: DataFrame, hits: DataFrame, options: ChatOptions = ChatOptions()) -> DataFrame:
        load = self.load

        def run(batches):
            model = _once(load)
            for b in batches:
                yield pd.DataFrame({"qid": b["qid"], "answer": [model().chat(_plain(x)) for x in b["messages"]]})

        return build_messages(questions, hits, options.language).mapInPandas(run, "qid long, answer string")


def _once(load):
    """A function that loads at its first call, and has what it loaded closed when the worker ends."""
    held = []

    def model():
        if not held:
            held.append(load())
            if close := getattr(held[0], "close", None):
                atexit.register(close)
        return held[0]

    return model


def _plain(messages) -> list[dict[str, str]]:
    return [{"role": m["role"], "content": m["content"]} for m in messages]


REGISTRY = {"hashing": HashingBackend}


def create_backend(name: str = "auto") -> Backend:
    """A backend by name. ``auto`` takes the first registered model, and with a warning the offline one if that can't be made."""
    if name == "auto":
        for other in REGISTRY:
            if other != "hashing":
                try:
                    return REGISTRY[other]()
                except Exception as e:  # whatever keeps a model from loading
                    warnings.warn(f"backend {other} is not available ({e}); the offline one is used", stacklevel=2)
                    break
        return HashingBackend()
    if name not in REGISTRY:
        raise ValueError(f"unknown backend: {name}")
    return REGISTRY[name]()
