"""Counted terms of texts, as an Arrow UDF that stems each distinct word of a task once.

The expressions of ``turkish`` say what a term is, in the JVM; for every token of a corpus their
regular expressions would run again and again, so here the same rules fill a table of stems.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .turkish import FOLD_FROM, FOLD_TO, MIN_STEM, PASSES, SOFTENED, STOPWORDS, SUFFIXES, VOWELS, WORD, fold_case
from .words import MEMO, Alphabet, Words, alphabet, portions, spread

TERMS = "array<struct<term:string,n:int>>"


def _by_length(suffixes: list[str]) -> list[tuple[int, frozenset[str]]]:
    """The suffixes of each length, the longest first."""
    return [(n, frozenset(s for s in suffixes if len(s) == n)) for n in sorted({len(s) for s in suffixes}, reverse=True)]


#: Suffixes of the first pass, and of the later ones.
_FIRST, _LATER = _by_length(SUFFIXES), _by_length([s for s in SUFFIXES if len(s) > 1])


def _shorten(word: str, suffixes: list[tuple[int, frozenset[str]]], vowel: int) -> str:
    """``word`` without its longest suffix of which a long enough stem with a vowel is left; ``vowel`` is where its first one stands."""
    for n, known in suffixes:
        left = len(word) - n
        if left >= MIN_STEM and left > vowel and word[left:] in known:
            return word[: left - 1] + SOFTENED.get(word[left - 1], word[left - 1])
    return word


def stem(word: str) -> str:
    """The stem of one folded token; what ``turkish.stem_word`` gives."""
    head, mark, _ = word.replace("’", "'").partition("'")
    if mark:
        return head.translate(str.maketrans(FOLD_FROM, FOLD_TO)).lower()
    vowel = next((k for k, c in enumerate(word) if c in VOWELS), None)
    if len(word) <= MIN_STEM or vowel is None:
        return word
    for turn in range(PASSES):
        before, word = word, _shorten(word, _LATER if turn else _FIRST, vowel)
        if word == before:  # the later passes try no suffix that this one didn't
            break
    return word


def counter(content: bool):
    """A function from a folded text to its counted terms, with a table of stems of its own."""
    known: dict[str, tuple[str, ...]] = {}
    find, stops = re.compile(WORD).findall, frozenset(STOPWORDS)

    def terms(word: str) -> tuple[str, ...]:
        root = stem(word)
        both = (word, root) if root not in (word, "") else (word,)
        return tuple(t for t in both if len(t) > 1 and t not in stops) if content else both

    def count(text: str | None) -> Counter:
        found: Counter = Counter()
        for word, n in Counter(find(text or "")).items():
            if word not in known:
                if len(known) >= MEMO:
                    known.clear()
                known[word] = terms(word)
            for t in known[word]:
                found[t] += n
        return found

    return count


def _counted(content: bool):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(content)
        for batch in texts:
            terms, numbers, ends = [], [], [0]
            for t in batch:
                found = count(t.as_py())
                terms += found.keys()
                numbers += found.values()
                ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(numbers, pa.int32())], names=["term", "n"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    # not deterministic for the optimizer, which would otherwise run it again in each filter and projection made of its result
    return arrow_udf(run, TERMS).asNondeterministic()


class AskedTerms:
    """Counts of the ``asked`` terms of texts, many texts at a time, and the number of all their terms; a distinct word is stemmed once."""

    def __init__(self, letters: Alphabet, asked: list[str]):
        self.words, self.place = Words(letters), {t: i for i, t in enumerate(asked)}
        self._forget()

    def _forget(self) -> None:
        self.words.forget()
        self.number, self.first, self.hits = np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        number, hits = [], []
        for word in self.words.known[len(self.number) :]:
            root = stem(word)
            terms = (word, root) if root not in (word, "") else (word,)
            number.append(len(terms))
            hits.append([self.place[t] for t in terms if t in self.place])
        self.number = np.concatenate((self.number, np.array(number, np.int64)))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum([len(h) for h in hits], dtype=np.int64)))
        self.hits = np.concatenate((self.hits, np.fromiter(chain.from_iterable(hits), np.int64)))

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, asked term, number) of each text's terms in the order in which they are met, and the number of all terms of each text."""
        if len(self.words) > MEMO:
            self._forget()
        word, text = self.words.numbers(texts)
        self._learn()
        totals = np.bincount(text, self.number[word], len(texts)).astype(np.int64)
        at, owner = spread(self.first, word)
        keys, met, number = np.unique(text[owner] * max(1, len(self.place)) + self.hits[at], return_index=True, return_counts=True)
        order = np.argsort(met)
        return *np.divmod(keys[order], max(1, len(self.place))), number[order], totals


def counted_asked(text: Column, asked: frozenset[str]) -> Column:
    """struct<terms array<struct<term, n>>, dl>: the terms of ``counted_terms`` that are ``asked``, and the number of all, repeated ones included."""
    letters, known = alphabet(), sorted(asked)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter, names = AskedTerms(letters, known), pa.array(known, pa.string())
        for batch in texts:
            parts = [counter.count(some) for some in portions(batch)]
            sizes = [np.bincount(t, minlength=len(totals)) for t, _, _, totals in parts]
            ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if parts else np.zeros(1)
            term, number, totals = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (1, 2, 3))
            pairs = pa.StructArray.from_arrays([names.take(pa.array(term)), pa.array(number.astype(np.int32))], names=["term", "n"])
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs), pa.array(totals)], names=["terms", "dl"])

    return arrow_udf(run, f"struct<terms:{TERMS},dl:long>").asNondeterministic()(text)


def counted_terms(text: Column) -> Column:
    """array<struct<term, n>>: each distinct expanded token with its number; null text has none."""
    return _counted(False)(fold_case(F.coalesce(text, F.lit(""))))


def counted_content(text: Column) -> Column:
    """The same without stop words and single characters."""
    return _counted(True)(fold_case(F.coalesce(text, F.lit(""))))
