import pytest

from tamarisk.llm.token_counts import MARK, Counter, Vocabulary, token_counts

from .conftest import EDGES

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))


def want(tokenizer, text):
    return len(tokenizer.encode(MARK + text.replace(" ", MARK)).ids) if text else 0


def test_equals_the_public_tokenizer(corpus, vocabulary, tokenizer):
    counter = Counter(vocabulary)
    texts = [t for _, t in corpus] + ["", " ", "  a  b", "漢字\n\n x", "a\tb  ▁c", "\n", "\n a", "x\n", "é" * 50, "ab" * 3000]
    assert [counter.count(t)[0] for t in texts] == [want(tokenizer, t) for t in texts]


def test_ties_go_to_the_earliest_start():
    counter = Counter(Vocabulary({MARK: -1.0, "a": -1.0, "b": -1.0, "c": -1.0, "ab": -2.0, "bc": -2.0, "abc": -3.0}))
    assert counter.solve("abc") == (-3.0, 1)  # all segmentations score -3: the longest last piece wins
    assert counter.solve("ab") == (-2.0, 1)
    assert counter.count("a€")[0] == 2 + 3


def test_small_memory_changes_nothing(corpus, vocabulary):
    a, b = Counter(vocabulary), Counter(vocabulary, memory=50)
    assert [a.count(t) for _, t in corpus[:30]] == [b.count(t) for _, t in corpus[:30]]


def test_edges(docs, vocabulary, tokenizer):
    got = token_counts(docs(EDGES), vocabulary).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, want(tokenizer, t or "")) for i, t in EDGES)
    assert token_counts(docs([]), vocabulary).count() == 0
