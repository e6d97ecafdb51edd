import base64
import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarisk.llm import queries as llm
from tamarisk.llm.byte_bpe import ByteBpe, Decoder, Encoder, byte_characters, decode, digests, encode, encoded_digests

from .conftest import EDGES

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n\n \t x", "don't can'T we'll", "漢字かな混じり文", "é é ﷽ 𝒳𝟙²½", "👩‍👩‍👧‍👦🇹🇷", "<|endoftext|> a", "a" * 300, "  x​y　", "\x00\x1f\x7f\x80﻿�", "1234567 12½3", "ab " * 40, "!!!???...", "  lead", "trail  ", "٣٤٥ नमस्ते"]


@pytest.fixture(scope="module")
def spec():
    return ByteBpe.load(PATH, P.PATTERN)


def reference(path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tiktoken():
    return reference(PATH)


def test_every_byte_has_its_character():
    chars = byte_characters()
    assert len(set(chars)) == 256 and chars[ord("A")] == "A" and chars[ord(" ")] == "Ġ" and chars[0] == "Ā" and not any(c.isspace() for c in chars)


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_equal_the_public_library(corpus, file):
    own, public = Encoder(ByteBpe.load(P.path(file), P.PATTERN)), reference(P.path(file))
    for text in [t for _, t in corpus] + ODD + ["".join(ODD) * 3]:
        assert own.encode([text])[0][0].tolist() == public.encode_ordinary(text or "")


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_ids_of_any_text(text):
    own, public, decoder = _once()
    got, _ = own.encode([text])
    assert got[0].tolist() == public.encode_ordinary(text)
    assert decoder.bytes(got[0]) == text.encode() and "".join(decoder.pieces(got[0])) == text


_made = []


def _once():
    if not _made:
        spec = ByteBpe.load(PATH, P.PATTERN)
        _made.extend((Encoder(spec, memo=40), reference(PATH), Decoder(spec)))
    return _made


def test_vocabulary_whose_merges_are_ambiguous():
    """Tokens that several pairs would make, equal parts next to each other, and a token that merging never makes."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {t.encode(): 256 + k for k, t in enumerate(["aa", "ab", "aaa", "abc", "bc", "aab", "xyz", "aaaa", "cab"])}
    import tiktoken

    own, public = Encoder(ByteBpe.of(ranks, r"\S+|\s+")), tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(list("abcxyz "), rng.integers(1, 12)))
        assert own.encode([text])[0][0].tolist() == public.encode_ordinary(text), text


def test_texts_together_as_apart(corpus, spec):
    """With and without offsets, and with a memory that is too small for the pieces of one text."""
    texts = [t for _, t in corpus[:50]] + ODD + [None]
    apart = [Encoder(spec).encode([t])[0] for t in texts[-20:]]
    for encoder in (Encoder(spec), Encoder(spec, offsets=False), Encoder(spec, memo=5)):
        rows, tokens = encoder.encode(texts)
        assert tokens.sum() == rows.shape[1] and tokens[-1] == 0
        for want, got in zip(apart, np.split(rows, np.cumsum(tokens)[:-1], axis=1)[-20:], strict=True):
            assert (want[: len(got)] == got).all()


def test_bytes_without_a_token():
    with pytest.raises(ValueError):
        ByteBpe.of({b"a": 0}, r"\S+")


def test_offsets_cover_the_text(corpus, spec):
    encoder, decoder = Encoder(spec), Decoder(spec)
    for text in [t or "" for _, t in corpus[:60]] + ODD:
        ids, starts, ends = encoder.encode([text])[0]
        for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
            assert decoder.tokens[i] in text[a:b].encode()
        covered = np.zeros(len(text) + 1, bool)
        for a, b in zip(starts, ends, strict=True):
            covered[a:b] = True
        assert covered[: len(text)].all() and (np.diff(starts) >= 0).all()


def test_pattern_that_leaves_gaps(spec):
    """Characters that no match has are left out, as by the public library; offsets stay those of the text."""
    ids, starts, ends = Encoder(ByteBpe(spec.model, r"(?:[a-z])+")).encode(["ab, cd"])[0]
    assert [("ab, cd"[a:b]) for a, b in zip(starts, ends, strict=True)] == ["ab", "cd"]


def test_split_characters(spec):
    decoder, encoder = Decoder(spec), Encoder(spec)
    ids, starts, _ = encoder.encode(["𝒳é"])[0]
    assert len(ids) > 2 and starts[0] == starts[1] == 0
    assert [p for p in decoder.pieces(ids) if p] == ["𝒳", "é"]
    assert decoder.pieces(ids[:1]) == ["�"] and decoder.bytes(ids[:1]).decode("utf-8", "replace") == "�"


def test_long_texts(spec, tiktoken):
    """One word of two million characters, and a text of many words, split in several lists."""
    encoder = Encoder(spec)
    for text in ("ab" * 1_000_000, "word and Ünï " * 200_000, "\n" * 20_000):
        ids, _ = encoder.encode([text])
        assert ids[0].tolist() == tiktoken.encode_ordinary(text)
        assert ids[2][-1] == len(text)
    blank, _ = encoder.encode(["\n" * 1_500_000])  # more white space than the public library takes
    assert Decoder(spec).bytes(blank[0]) == b"\n" * 1_500_000


def test_round_trip_as_rows(docs, spec, tiktoken):
    rows = EDGES + [(10 + k, t) for k, t in enumerate(ODD)]
    encoded = encode(docs(rows), spec)
    got = encoded.collect()
    key = lambda i, t: (i or 0, t)
    assert sorted(key(r.doc_id, tuple(r.ids)) for r in got) == sorted(key(i, tuple(tiktoken.encode_ordinary(t or ""))) for i, t in rows)
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in got)
    back = decode(encoded, spec).collect()
    assert sorted(key(r.doc_id, r.text) for r in back) == sorted(key(i, t or "") for i, t in rows)
    assert all("".join(r.pieces) == r.text and bytes(r.bytes) == r.text.encode() for r in back)
    assert encode(docs([]), spec).count() == 0 and decode(encode(docs([]), spec), spec).count() == 0


def test_ids_that_are_no_tokens(spark, spec):
    rows = spark.createDataFrame([(1, None), (2, [None, -5, 10**6]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode(rows, spec).collect()} == {1: None, 2: "���", 3: ""}
    assert {r.doc_id: r.n_tokens for r in digests(rows, spec).collect()} == {1: None, 2: 3, 3: 0}


def test_query(spark, sf, corpus, tiktoken):
    got = {r.doc_id: r for r in llm.op11_byte_bpe(spark, sf).collect()}
    assert len(got) == len(corpus)
    for i, text in corpus:
        ids = tiktoken.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_digests_in_one_step(docs, spec):
    """As encoding and decoding one after the other; the library never gets more than some thousand pieces at once."""
    rows = EDGES + [(10 + k, t) for k, t in enumerate(ODD)]
    both = [sorted(map(tuple, f.collect()), key=repr) for f in (encoded_digests(docs(rows), spec), digests(encode(docs(rows), spec, offsets=False), spec))]
    assert both[0] == both[1] and encoded_digests(docs([]), spec).count() == 0
    encoder, most = Encoder(spec, False), []
    library = encoder.batch
    encoder.batch = lambda pieces, **options: most.append(len(pieces)) or library(pieces, **options)
    text = " ".join(f"w{k}" for k in range(50_000))
    assert (encoder.encode([text])[0][0] == Encoder(spec, False, memo=10).encode([text])[0][0]).all() and max(most) <= 1 << 13
