"""The chunking rules restated in plain Python, as the brute force that the column expressions are held against."""

from __future__ import annotations

import re
from collections.abc import Iterator

_END = re.compile(r"""(?<=[.!?…])["'”’)\]]*\s+""")
_HEADING = re.compile(r"^#{1,6}\s+(.*\S)\s*$")


def tail(text: str, overlap: int) -> str:
    """The last ``overlap`` characters, from the first whole word on."""
    if overlap <= 0:
        return ""
    if len(text) <= overlap:
        return text
    end = text[-overlap:]
    head, gap, rest = end.partition(" ")
    return (rest if gap and rest else end).strip()


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(heading, body): the lines between two headings, if there are any, under the one above them."""
    lines = text.splitlines()
    marks = [(k, found[1]) for k, found in enumerate(map(_HEADING.match, lines)) if found]
    below = [(-1, ""), *marks]
    for (at, heading), end in zip(below, [*(k for k, _ in marks), len(lines)], strict=True):
        if body := lines[at + 1 : end]:
            yield heading, "\n".join(body)


def pieces(text: str, size: int) -> Iterator[str]:
    """Paragraphs; of longer ones their sentences; of longer sentences slices."""
    for paragraph in map(str.strip, re.split(r"\n\s*\n", text)):
        if len(paragraph) <= size:
            if paragraph:
                yield paragraph
            continue
        for sentence in map(str.strip, _END.split(paragraph)):
            yield from (sentence[i : i + size] for i in range(0, len(sentence), size))


def chunk_text(text: str | None, size: int = 900, overlap: int = 150) -> list[str]:
    """Pieces packed greedily; a chunk that is full hands its tail to the next."""
    done: list[str] = []
    held = ""
    for piece in pieces(text or "", size):
        if not held:
            held = piece
        elif len(held) + 2 + len(piece) <= size:
            held += "\n\n" + piece
        else:
            done.append(held.strip())
            carried = tail(held, overlap)
            held = f"{carried}\n\n{piece}".strip() if carried else piece
    return [c for c in (*done, held.strip()) if c]


def chunk_document(text: str | None, size: int = 900, overlap: int = 150) -> list[tuple[int, str, str]]:
    found = [(heading, content) for heading, body in sections(text or "") for content in chunk_text(body, size, overlap)]
    return [(k, *x) for k, x in enumerate(found)]
