"""Sentence splitters and repetition measures as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that the three splitters cut at, what they strip, their least lengths, and the degeneracy floor.
CHUNK_END = r"""(?<=[.!?…])["'”’)\]]*\s+"""
ANSWER_END = r"(?<=[.!?…])\s+|\n+"
QUOTE_END = r"(?<=[.!?…])\s+|\n{2,}"
ANSWER_STRIP, QUOTE_STRIP = " -•\t", " -•\t*"
ANSWER_LEAST, QUOTE_LEAST = 25, 30
DEGENERATE_BELOW = 0.75
SPACE = r"[\s\x1c-\x1f\x85   -     　]+"
#: The characters of ``SPACE``, which lie below U+10000. Taking them off the ends of a text looks at no other characters, as a search for the pattern would.
SPACES = "".join(c for c in map(chr, range(0xD800)) if re.fullmatch(SPACE, c, re.ASCII))


def _cut(text: Column, pattern: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), pattern)


def strip(text: Column, characters: str | None = None) -> Column:
    """Without the given characters (white space by default) at both ends."""
    return F.btrim(text, F.lit(SPACES if characters is None else characters))


def chunk_sentences(text: Column) -> Column:
    """Sentences for chunking; closing quotes and brackets at a cut are lost."""
    return F.filter(F.transform(_cut(text, CHUNK_END), lambda s: strip(s)), lambda s: s != "")


def answer_sentences(text: Column) -> Column:
    """Checkable sentences of an answer: without citations and markup, of 25 characters at least."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), "[*_`#>]+", "")
    return F.filter(F.transform(_cut(plain, ANSWER_END), lambda s: strip(s, ANSWER_STRIP)), lambda s: F.length(s) >= ANSWER_LEAST)


def quote_sentences(text: Column) -> Column:
    """Quotable sentences of a passage, of 30 characters at least."""
    return F.filter(F.transform(_cut(text, QUOTE_END), lambda s: strip(s, QUOTE_STRIP)), lambda s: F.length(s) >= QUOTE_LEAST)


def distinct_bigram_ratio(text: Column) -> Column:
    """Distinct word pairs over all; 1 below two words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n < 2, F.lit(1.0)).otherwise(F.size(F.array_distinct(pairs)) / F.greatest(F.size(pairs), F.lit(1)))


def repeated_sentence(text: Column) -> Column:
    """The first answer sentence that says again what one before it said, or the empty string."""
    rows = F.transform(answer_sentences(text), lambda s, i: F.struct(F.lower(strip(F.regexp_replace(s, SPACE, " "))).alias("key"), i.alias("pos"), s.alias("s")))
    rows = F.sort_array(rows)  # array_sort would call a comparing expression for each pair
    n = F.greatest(F.size(rows) - 1, F.lit(0))
    # neighbours in the order of their keys: the second of equal ones is a repetition
    again = F.zip_with(F.slice(rows, 1, n), F.slice(rows, 2, n), lambda a, b: F.when(a["key"] == b["key"], F.struct(b["pos"].alias("pos"), b["s"].alias("s"))))
    return F.coalesce(F.array_min(again)["s"], F.lit(""))


def is_degenerate(text: Column) -> Column:
    return (distinct_bigram_ratio(text) < DEGENERATE_BELOW) | (repeated_sentence(text) != "")
