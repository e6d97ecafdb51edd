"""Byte-level BPE: texts to token ids with character offsets, and ids back to bytes and text.

The ranks of a vocabulary become a model of the tokenizers library: bytes are written as characters
(``byte_characters``), and each token's merge is the last one that makes it when its bytes are merged
by rank. A piece of text (a match of the pattern) that is itself a token is that token; other pieces
are merged. Every distinct piece goes through the library once in a task, until its table of pieces is
full; a text's ids and offsets are then gathered from that table.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Pieces, and characters of pieces, that a task keeps; matches of a long text that are in memory at a time; longest text that is split at once.
MEMO, MEMO_CHARS, MATCHES, LONG = 1 << 18, 1 << 24, 1 << 17, 1 << 20
#: Pieces that go through the library at a time: what it returns for one is far larger than its ids.
LEARNED = 1 << 13
#: What an id that is no token stands for.
REPLACEMENT = "�".encode()


def byte_characters() -> list[str]:
    """The character of each byte: printable ones of Latin-1 stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The pair whose merge makes ``token`` out of its bytes; None if merging by rank ends elsewhere."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks)), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == len(ranks):
            return None
        if len(parts) == 2:
            return parts[0], parts[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return None


@dataclass
class ByteBpe:
    """A vocabulary: the tokenizer as JSON text and the pattern whose matches are encoded separately. As large as the vocabulary."""

    model: str
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        """From a file of lines ``<base64 of a token's bytes> <rank>``, read on the driver."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls.of(ranks, pattern)

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> ByteBpe:
        from tokenizers import Tokenizer, models, pre_tokenizers

        if missing := 256 - sum(bytes([b]) in ranks for b in range(256)):
            raise ValueError(f"{missing} bytes have no token")
        order = {t: k for k, t in enumerate(sorted(ranks, key=ranks.get))}  # ranks may leave numbers out
        char = byte_characters()
        written = lambda token: "".join(char[b] for b in token)
        merges = [(written(pair[0]), written(pair[1])) for t in order if len(t) > 1 and (pair := last_merge(t, order))]
        tokenizer = Tokenizer(models.BPE({written(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
        tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return cls(tokenizer.to_str(), pattern)

    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.model)


def gather(first: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs (first, size) that ``at`` names, one after the other, and the sizes of the runs."""
    n = size[at]
    return np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


class Encoder:
    """Encodes whole texts; keeps the ids, and with ``offsets`` the offsets, of up to ``memo`` distinct pieces."""

    def __init__(self, spec: ByteBpe, offsets: bool = True, memo: int = MEMO):
        import regex

        tokenizer = spec.tokenizer()
        self.batch = tokenizer.encode_batch if offsets else tokenizer.encode_batch_fast
        self.split, self.offsets, self.memo = regex.compile(spec.pattern), offsets, memo
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = self.held = 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.table = np.zeros((3 if self.offsets else 1, 1 << 14), np.int32)  # id, start and end within the piece

    def learn(self, pieces: set[str]) -> None:
        fresh = list(pieces.difference(self.known))
        if self.known and (len(self.known) + len(fresh) > self.memo or self.chars > MEMO_CHARS):
            self.forget()
            fresh = list(pieces)
        for k in range(0, len(fresh), LEARNED):
            self._add(fresh[k : k + LEARNED])

    def _add(self, fresh: list[str]) -> None:
        found = self.batch(fresh, add_special_tokens=False)
        ids = [f.ids for f in found]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        n = int(size.sum())
        if self.held + n > self.table.shape[1]:
            self.table = np.concatenate((self.table, np.zeros((len(self.table), max(n, self.table.shape[1])), np.int32)), axis=1)
        own = self.table[:, self.held : self.held + n]
        own[0] = np.fromiter(chain.from_iterable(ids), np.int32, n)
        if self.offsets:
            own[1:] = np.fromiter(chain.from_iterable(chain.from_iterable(f.offsets for f in found)), np.int32, 2 * n).reshape(n, 2).T
        self.first = np.concatenate((self.first, np.cumsum(size) - size + self.held))
        self.size = np.concatenate((self.size, size))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.held += n
        self.chars += sum(map(len, fresh))

    def pieces(self, text: str) -> Iterator[tuple[list[str], np.ndarray]]:
        """The matches of the pattern, in order, and with ``offsets`` where each starts; a long text's come in several lists."""
        if len(text) <= LONG and not self.split.groups:
            found = self.split.findall(text)
            if not self.offsets:
                yield found, np.zeros(0, np.int64)
                return
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            if not len(ends) or ends[-1] == len(text):
                yield found, np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1]))
                return
        matches = self.split.finditer(text)
        while some := list(islice(matches, MATCHES)):
            yield [m.group() for m in some], np.array([m.start() for m in some], np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, with ``offsets`` below them the first character and the one after the last of each token, and each text's number of tokens.

        Tokens of one split character share its offsets.
        """
        parts, tokens = [np.zeros((len(self.table), 0), np.int32)], np.zeros(len(texts), np.int64)
        words: list[str] = []
        starts: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            self.learn(set(words))
            where, n = gather(self.first, self.size, np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
            part = self.table[:, where]
            if self.offsets:
                part[1:] += np.repeat(np.concatenate(starts), n).astype(np.int32)
            parts.append(part)
            ends, at = np.concatenate(([0], np.cumsum(n))), 0
            for k, many in owners:
                tokens[k] += ends[at + many] - ends[at]
                at += many
            words.clear(), starts.clear(), owners.clear()

        for k, text in enumerate(texts):
            for own, begun in self.pieces(text or ""):
                words.extend(own)
                starts.append(begun)
                owners.append((k, len(own)))
                if len(words) >= MATCHES:
                    flush()
        if words:
            flush()
        return np.concatenate(parts, axis=1), tokens


class Decoder:
    """The bytes of ids, by the reversed byte table."""

    def __init__(self, spec: ByteBpe):
        byte = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = spec.tokenizer().get_vocab(with_added_tokens=False)
        self.n = max(vocabulary.values(), default=-1) + 1
        of = [REPLACEMENT] * (self.n + 1)
        for token, i in vocabulary.items():
            of[i] = bytes(byte[c] for c in token)
        self.tokens = of
        self.size = np.fromiter(map(len, of), np.int64, len(of))
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(of), np.uint8)

    def places(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids < 0) | (ids >= self.n), self.n, ids)

    def bytes(self, ids: np.ndarray) -> bytes:
        return self.data[gather(self.first, self.size, self.places(ids))[0]].tobytes()

    def pieces(self, ids: np.ndarray) -> list[str]:
        """What each token adds to the text: a character that is split over tokens belongs to the one that completes it."""
        decode = codecs.getincrementaldecoder("utf-8")("replace").decode
        out = [decode(self.tokens[i]) for i in self.places(ids).tolist()]
        if out:
            out[-1] += decode(b"", True)
        return out


def encode(docs: DataFrame, spec: ByteBpe, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(doc_id, ids, and with ``offsets`` starts, ends) of every row's whole text.

    Null and empty texts have no token; bytes that are no UTF-8 count as U+FFFD. Null ids and repeated
    rows are kept, other columns ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # as large as the vocabulary
    names = ("ids", "starts", "ends") if offsets else ("ids",)

    def run(batches):
        encoder = Encoder(shared.value, offsets)
        for batch in batches:
            for a, b in chunks(batch.column(1), 1_000_000):
                rows, tokens = encoder.encode(batch.column(1)[a:b].to_pylist())
                ends = pa.array(np.concatenate(([0], np.cumsum(tokens))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(row)) for row in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *lists], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} array<int>" for n in names))


def _ids(cell: pa.Scalar) -> np.ndarray:
    return cell.values.fill_null(-1).to_numpy().astype(np.int64)


def _decoded(encoded: DataFrame, spec: ByteBpe, id_col: str, ids_col: str, columns: str, row) -> DataFrame:
    """Applies ``row`` (decoder, ids) to every list of ids that is not null, some hundred thousand ids a batch; ``columns`` names and types what it gives."""
    shared = encoded.sparkSession.sparkContext.broadcast(spec)
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    fields = [c.split(" ") for c in columns.split(", ")]

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            lists, at = batch.column(1), 0
            while at < batch.num_rows:
                end, held = at, 0
                while end < batch.num_rows and held < 500_000:
                    held += len(lists[end]) if lists[end].is_valid else 0
                    end += 1
                found = [row(decoder, _ids(x)) if x.is_valid else (None,) * len(fields) for x in lists[at:end]]
                made = [pa.array([f[k] for f in found], kinds[kind]) for k, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], *made], names=["doc_id", *(name for name, _ in fields)])
                at = end

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"doc_id long, {columns}")


def decode(encoded: DataFrame, spec: ByteBpe, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes, text, pieces) of lists of ids: the bytes as they are, the text with U+FFFD for what is no UTF-8, and what each token adds to it.

    A null list gives nulls; a null or unknown id stands for U+FFFD. Repeated rows are kept.
    """

    def row(decoder, ids):
        data = decoder.bytes(ids)
        return data, data.decode("utf-8", "replace"), decoder.pieces(ids)

    return _decoded(encoded, spec, id_col, ids_col, "bytes binary, text string, pieces array<string>", row)


def _digest(decoder: Decoder, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoder.bytes(ids)).hexdigest()


def digests(encoded: DataFrame, spec: ByteBpe) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): of the ids as little-endian 32-bit integers, and of the bytes that they decode to."""
    return _decoded(encoded, spec, "doc_id", "ids", "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)


def encoded_digests(docs: DataFrame, spec: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digests`` of ``encode``, in one step: ids don't leave the task that made them, and a task has one Python process."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        encoder, decoder = Encoder(shared.value, False), Decoder(shared.value)
        for batch in batches:
            for a, b in chunks(batch.column(1), 1_000_000):
                rows, tokens = encoder.encode(batch.column(1)[a:b].to_pylist())
                made = [_digest(decoder, ids.astype(np.int64)) for ids in np.split(rows[0], np.cumsum(tokens)[:-1])]
                columns = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
