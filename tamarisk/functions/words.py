"""Words of whole texts, many at a time, as numbers that a task gives them.

The expressions of ``turkish`` say what a word is. Here a table maps each character to a byte, folded
and without what stands in no word, so that a text's words are what is left between blanks: no
regular expression runs over it, and a word is looked at once by a task.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from .turkish import FOLD_FROM, FOLD_TO

#: Distinct words that a task knows at a time; texts, and characters of them, that are taken together.
MEMO, TEXTS, CHARACTERS = 1 << 18, 1 << 10, 1 << 21
LETTERS, QUOTES = "0123456789abcdefghijklmnopqrstuvwxyzçğıöşü", "'’"


@dataclass(frozen=True)
class Alphabet:
    """Bytes of the characters of words. ``table`` has the character of each byte, ``folded`` the byte of the letter that it becomes, or a blank."""

    table: str
    folded: bytes
    letters: dict[int, str]


@cache
def alphabet(plain: tuple[str, str] = ("", "")) -> Alphabet:
    """That of words after folding and ``plain``, a further map of characters. Made on the driver, as it looks at every character there is."""
    fold, more, known = str.maketrans(FOLD_FROM, FOLD_TO), str.maketrans(*plain), frozenset(LETTERS + QUOTES)
    became = lambda c: c.translate(fold).lower().translate(more)
    every = map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000)))
    other = [c for c in every if (c in known or c in plain[0] or c.lower() != c) and known & set(became(c))]
    if len(other) > 128 or any(len(became(c)) > 1 for c in other):
        raise ValueError("more characters than bytes")
    table = [chr(c) for c in range(0x80)] + other  # ASCII stands for itself
    place = {c: i for i, c in enumerate(table)}
    folded = bytes(place[became(c)] if became(c) in known else 0x20 for c in table)
    return Alphabet("".join(table).ljust(256, "\ufffe"), folded.ljust(256), {i: table[i] for i in set(folded) - {0x20}})


class Words(dict):
    """Numbers of the distinct words a task has met, in ``known`` by number."""

    def __init__(self, alphabet: Alphabet):
        super().__init__()
        self.alphabet, self.known, self.places = alphabet, [], codecs.charmap_build(alphabet.table)
        quotes = [bytes([i]) for i, c in alphabet.letters.items() if c in QUOTES]
        # a mark counts between two letters only: neither of two that meet, and none at an end of a word
        self.stray = [a + b for a in quotes for b in quotes] + [b" " + q for q in quotes] + [q + b" " for q in quotes]

    def __missing__(self, data: bytes) -> int:
        self[data] = n = len(self.known)
        self.known.append("".join(map(self.alphabet.letters.__getitem__, data[:-1])))
        return n

    def forget(self) -> None:
        self.clear()
        self.known.clear()

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of some texts, one after the other, and the text of each, from 0; null has none."""
        texts = [t or "" for t in texts]
        data = codecs.charmap_encode(f" {' '.join(texts)} ", "replace", self.places)[0].translate(self.alphabet.folded)  # a byte a character
        for mark in self.stray:
            data = data.replace(mark, b"  ")
        cells = np.frombuffer(data, np.uint8)
        letter = cells != 0x20
        starts, ends = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1, np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        letter[ends] = True  # each word with one blank after it
        offsets = np.concatenate(([0], np.cumsum(ends - starts + 1))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(cells[letter])]).dictionary_encode()
        number = np.fromiter(map(self.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(words.dictionary))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        return number[words.indices.to_numpy()], np.searchsorted(bounds, starts, side="right")


def portions(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow column in portions of bounded size; a long text is one of its own."""
    held, size = [], 0
    for t in texts:
        text = t.as_py()
        if held and (len(held) == TEXTS or size + len(text or "") > CHARACTERS):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


def counted(groups: np.ndarray, items: np.ndarray, many: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, item, number) of each distinct pair, in order; items are below ``many``, and ``weights``, if given, are whole numbers."""
    keys = groups * many + items
    if weights is None:
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        number = np.diff(first, append=len(keys))
        keys = keys[first]
    else:  # the weight goes into the key: numbers are sorted faster than places
        bits = int(weights.max(initial=1)).bit_length()
        keys = (keys << bits) | weights
        keys.sort()
        weights, keys = keys & ((1 << bits) - 1), keys >> bits
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        number = np.add.reduceat(weights, first) if len(first) else weights
        keys = keys[first]
    return *np.divmod(keys, many), number


def spread(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all members of the lists ``of``, list i being from start[i] to start[i + 1], and which of ``of`` each belongs to."""
    sizes = start[of + 1] - start[of]
    owner = np.repeat(np.arange(len(of)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start[of], sizes), owner
