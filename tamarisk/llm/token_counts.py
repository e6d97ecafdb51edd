"""Token counts of a unigram tokenizer without making tokens.

Aho-Corasick enumerates the vocabulary pieces that end at each character; a dynamic programme
carries the best score and its number of pieces. Tie rules are those of the public unigram
tokenizers: candidates for an end are taken by increasing start and only a strictly better score
replaces the best one, so of equal scores the earliest start wins; a character that no
single-character piece covers is an unknown of the least score minus ten, counted as its UTF-8
bytes; sums are 64-bit. As no piece spans the start of a word, words are independent and each
distinct one is solved once per task.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

MARK = "▁"
#: Taken off the least score for an unknown character: a fixed value of the tokenizers.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    pieces: dict[str, float]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The normal pieces of a SentencePiece model file with byte fallback, with their scores."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        if not any(sp.is_byte(i) for i in ids):
            raise ValueError("the vocabulary has no byte fallback")
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))})


class Counter:
    """Counts pieces of whole texts; remembers up to ``memory`` distinct words."""

    def __init__(self, vocabulary: Vocabulary, memory: int = 400_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown = min(vocabulary.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        # words may be cut apart before a mark only if marks are at the start of every piece that has other characters
        self.by_word = all(MARK not in p.lstrip(MARK) and (not p.startswith(MARK * 2) or not p.strip(MARK)) for p in vocabulary.pieces)
        self.line_ends = not any("\n" in p for p in vocabulary.pieces)
        self.memory, self.known = memory, {}

    def solve(self, text: str) -> tuple[float, int]:
        """Best score and its piece count of one marked text.

        The automaton gives the pieces that end at a character longest first, so by increasing start.
        """
        n = len(text)
        best, count = [0.0] + [-inf] * n, [0] * (n + 1)
        if self.single.issuperset(text):
            for end, (size, score) in self.automaton.iter(text):
                start = end + 1 - size
                if (s := best[start] + score) > best[end + 1]:
                    best[end + 1], count[end + 1] = s, count[start] + 1
            return best[n], count[n]
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, (size, score) in self.automaton.iter(text):
            ends[end + 1].append((end + 1 - size, score))
        for end in range(1, n + 1):
            for start, score in ends[end]:
                if (s := best[start] + score) > best[end]:
                    best[end], count[end] = s, count[start] + 1
            c = text[end - 1]
            if c not in self.single and (s := best[end - 1] + self.unknown) > best[end]:
                best[end], count[end] = s, count[end - 1] + len(c.encode("utf-8", "surrogatepass"))
        return best[n], count[n]

    def units(self, text: str) -> tuple[list[str], int]:
        """The independent parts of a text, marked, and the number of line ends between them."""
        if not self.by_word:
            return [MARK + text.replace(" ", MARK)], 0
        lines = text.split("\n") if self.line_ends else [text]
        found: list[str] = []
        for k, line in enumerate(lines):
            words = line.split(" ")
            if "" in words[1:] or (k == 0 and words[0] == "") or MARK in line:  # runs of marks: keep them whole
                marked = (MARK if k == 0 else "") + line.replace(" ", MARK)
                at = 0
                for i in range(1, len(marked)):
                    if marked[i] == MARK and marked[i - 1] != MARK:
                        found.append(marked[at:i])
                        at = i
                found.append(marked[at:])
                continue
            found.append(MARK + words[0] if k == 0 else words[0])
            found.extend(map(MARK.__add__, words[1:]))
        return found, len(lines) - 1

    def count(self, text: str | None) -> tuple[int, float]:
        """Number of pieces and best score of a whole text; null and empty texts have none."""
        if not text:
            return 0, 0.0
        units, line_ends = self.units(text)
        known = self.known
        fresh = set(units).difference(known)
        if len(known) + len(fresh) > self.memory:
            known.clear()
            fresh = set(units)
        for u in fresh:
            known[u] = self.solve(u)
        found = list(map(known.__getitem__, units))
        return sum(c for _, c in found) + line_ends, sum(s for s, _ in found) + line_ends * self.unknown


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score (of the best segmentation), n_chars of every row's whole text.

    Null and empty texts have no token. Null ids and repeated rows are kept, other columns ignored;
    an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            tokens, scores = [], []
            for a, b in chunks(batch.column(1), 1_000_000):
                for t in batch.column(1)[a:b].to_pylist():
                    n, s = counter.count(t)
                    tokens.append(n)
                    scores.append(s)
            sizes = np.array([len(t.as_py() or "") for t in batch.column(1)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64()), pa.array(sizes)],
                names=["doc_id", "n_tokens", "score", "n_chars"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, score double, n_chars long")
