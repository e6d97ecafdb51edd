"""Deterministic feature-hashing embeddings.

``hash_embed`` is an Arrow UDF, as its hash and accent folding have no built-in counterpart.
``hash_features`` is a built-in variant, sparse and in a vector space of its own (MD5 buckets);
``md5_embed`` gives the same vectors densely.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b, md5
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .digests import SHORT, md5_heads
from .turkish import WORD, fold_case
from .words import Alphabet, Words, alphabet, counted, portions, spread

DIM = 512
SIGNATURE, SQL_SIGNATURE = f"hashing-offline:{DIM}", f"hashing-md5:{DIM}"
#: Distinct features, and words, whose places a task keeps at a time.
MEMO = 1 << 18
#: Pairs of words that are spelt out together.
PAIRS = 1 << 16
ACCENTS_FROM, ACCENTS_TO = "çğöşüáàâäéèêëíìîïóòôúùûñ", "cgosuaaaaeeeeiiiiooouuun"


def _counted(words: list[str]) -> Counter:
    """Words, 4-grams within words of more than five characters, and word pairs."""
    counts = Counter("w:" + w for w in words)
    counts.update(f"c:{w[i : i + 4]}" for w in words if len(w) > 5 for i in range(len(w) - 3))
    counts.update(f"b:{a}_{b}" for a, b in zip(words, words[1:], strict=False))
    return counts


def features(text: str) -> Counter:
    plain = unicodedata.normalize("NFKD", text.replace("I", "ı").replace("İ", "i").lower())
    return _counted(re.findall(r"\w+", "".join(c for c in plain if not unicodedata.combining(c))))


def place(feature: str) -> tuple[int, int]:
    """Bucket and sign of a feature."""
    data = feature.encode("utf-8", "replace")
    sign = 1 if blake2b(data, digest_size=5).digest()[4] % 2 else -1
    return int.from_bytes(blake2b(data, digest_size=4).digest(), "big") % DIM, sign


def embed(text: str | None, place=place) -> np.ndarray:
    """Unit vector of signed, sublinear feature counts; no word gives the zero vector."""
    v = np.zeros(DIM, dtype=np.float32)
    for f, n in features(text or "").items():
        bucket, sign = place(f)
        v[bucket] += sign * (1 + math.log(n))
    return v / (np.linalg.norm(v) or 1)


class _Remembered(dict):
    """The places of the features that a task has met, emptied when it is full."""

    def __init__(self, place):
        self.place = place

    def __missing__(self, feature: str) -> tuple[int, int]:
        if len(self) >= MEMO:
            self.clear()
        self[feature] = found = self.place(feature)
        return found


def _vectors(rows: list[np.ndarray], n: int, kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, DIM * n + 1, DIM, dtype=np.int32)), pa.array(flat, kind))


def hash_embed(text: Column) -> Column:
    """Embedding of a text (array<float>); null text has the zero vector."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = _Remembered(place).__getitem__
        for batch in batches:
            yield _vectors([embed(t.as_py(), find) for t in batch], len(batch), pa.float32())

    return arrow_udf(run, "array<float>")(text)


class _Md5Places:
    """Vectors of the words of texts (``hash_features``), many texts at a time; the features of a distinct word are placed once."""

    def __init__(self, letters: Alphabet):
        self.words, self.grams = Words(letters), {}
        self._forget()

    def _forget(self) -> None:
        self.words.forget()
        self.grams.clear()
        self.spelt: list[bytes] = []
        self.first, self.parts, self.own, self.gram, self.size = np.zeros(1, np.int64), *(np.empty(0, np.int64) for _ in range(4))
        self.letters = np.empty((0, SHORT - 3), np.uint8)

    def _learn(self) -> None:
        """Places of the words that are new, and of their 4-grams."""
        new = self.words.known[len(self.spelt) :]
        listed, met = [], len(self.grams)
        for w in new:
            listed.append([self.grams.setdefault(w[i : i + 4], len(self.grams)) for i in range(len(w) - 3)] if len(w) > 5 else [])
        spelt = [w.encode() for w in new]
        self.spelt += spelt
        self.size = np.concatenate((self.size, np.fromiter(map(len, spelt), np.int64, len(spelt))))
        padded = b"".join([w[: SHORT - 3].ljust(SHORT - 3, b"\0") for w in spelt])
        self.letters = np.concatenate((self.letters, np.frombuffer(padded, np.uint8).reshape(-1, SHORT - 3)))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum([len(x) for x in listed], dtype=np.int64)))
        self.parts = np.concatenate((self.parts, np.fromiter(chain.from_iterable(listed), np.int64)))
        self.own = np.concatenate((self.own, _codes(b"w:" + w for w in spelt)))
        self.gram = np.concatenate((self.gram, _codes(f"c:{g}".encode() for g in islice(self.grams, met, None))))

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes of pairs of words, by their numbers."""
        size, code = self.size[a] + self.size[b] + 3, np.empty(len(a), np.int64)
        for i in np.flatnonzero(size > SHORT):
            code[i] = _codes([b"b:%b_%b" % (self.spelt[a[i]], self.spelt[b[i]])])[0]
        rows = np.flatnonzero(size <= SHORT)
        for some in np.array_split(rows, -(-len(rows) // PAIRS) or 1):
            x, y = a[some], b[some]
            text, long = np.zeros((len(some), 64), np.uint8), self.size[x]
            text[:, 0], text[:, 1], text[:, 2 : SHORT - 1] = *b"b:", self.letters[x]
            text[np.arange(len(some)), long + 2] = ord("_")
            order = np.argsort(long.astype(np.uint8), kind="stable")
            ends = np.cumsum(np.bincount(long, minlength=SHORT))
            for n in range(SHORT - 2):  # the second word stands where the first one ends
                at = order[ends[n - 1] if n else 0 : ends[n]]
                text[at, n + 3 : SHORT] = self.letters[y[at], : SHORT - 3 - n]
            low, high = md5_heads(text, size[some])
            code[some] = ((low >> 16 & 1) << 8 | low >> 24) << 1 | high >> 4 & 1
        return code

    def embed(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words) > MEMO:
            self._forget()
        word, text = self.words.numbers(texts)
        self._learn()
        many = max(1, len(self.spelt))
        follow = np.flatnonzero(text[1:] == text[:-1])
        t, pair, n = counted(text[follow], word[follow] * many + word[follow + 1], many * many)
        distinct, which = np.unique(pair, return_inverse=True)
        found = [(t, self._pairs(*np.divmod(distinct, many))[which], n)]
        t, w, n = counted(text, word, many)
        found.append((t, self.own[w], n))
        at, owner = spread(self.first, w)
        t, g, n = counted(t[owner], self.parts[at], max(1, len(self.gram)), n[owner])
        found.append((t, self.gram[g], n))
        t, code, n = (np.concatenate(x) for x in zip(*found, strict=True))
        v = np.bincount(t * DIM + (code >> 1), np.where(code & 1, 1.0, -1.0) * (1 + np.log(n)), DIM * len(texts)).reshape(-1, DIM)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm == 0, 1, norm)


def _codes(features: Iterable[bytes]) -> np.ndarray:
    """Twice the bucket of each feature, and one more where its sign is positive: what ``hash_features`` reads off the digest."""
    digest = np.frombuffer(b"".join([md5(f, usedforsecurity=False).digest() for f in features]), np.uint8).reshape(-1, 16).astype(np.int64)
    return ((digest[:, 2] << 8 | digest[:, 3]) % DIM) << 1 | digest[:, 4] >> 4 & 1


def md5_embed(text: Column) -> Column:
    """The vectors of ``hash_features``, dense (array<double>): one row a text and no shuffle."""
    letters = alphabet((ACCENTS_FROM, ACCENTS_TO))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = _Md5Places(letters)
        for batch in batches:
            yield _vectors([places.embed(some).ravel() for some in portions(batch)], len(batch), pa.float64())

    return arrow_udf(run, "array<double>")(text)


def _plain(text: Column) -> Column:
    return F.translate(fold_case(F.coalesce(text, F.lit(""))), ACCENTS_FROM, ACCENTS_TO)


def hash_features(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, bucket, weight): sparse unit vectors by MD5 buckets, built-ins only."""
    words = F.regexp_extract_all(_plain(text), F.lit(WORD), F.lit(0))
    grams = lambda w: F.when(F.length(w) > 5, F.transform(F.sequence(F.lit(1), F.length(w) - 3), lambda i: F.concat(F.lit("c:"), F.substr(w, i, F.lit(4))))).otherwise(F.array().cast("array<string>"))
    n = F.size("__w")
    pairs = F.zip_with(F.slice("__w", 1, F.greatest(n - 1, F.lit(0))), F.slice("__w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b))
    found = docs.select(F.col(id_col).alias("id"), words.alias("__w")).select(
        "id", F.explode(F.concat(F.transform("__w", lambda w: F.concat(F.lit("w:"), w)), F.flatten(F.transform("__w", grams)), pairs)).alias("f")
    )
    digest = F.md5("f")
    hashed = found.groupBy("id", "f").count().select(
        "id",
        (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % DIM).cast("int").alias("bucket"),
        (F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0) * (1 + F.ln(F.col("count").cast("double")))).alias("x"),
    )
    summed = hashed.groupBy("id", "bucket").agg(F.sum("x").alias("x"))
    norm = summed.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return summed.join(norm, "id").select("id", "bucket", F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(0.0).alias("weight"))
