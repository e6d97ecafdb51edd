import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.llm.lm_score import BUCKETS, fit_weights, lm_scores

from .conftest import EDGES


def brute(rows, train, order=2):
    """(n_tokens, n_known, base, score) of each row by plain counting, with the same EM on unbinned estimates."""
    texts = [[*(t or "").encode().lower().split(), "<end>"] for _, t in rows]
    known = [t for t, ok in zip(texts, train, strict=True) if ok]
    uni, bi, n = Counter(w for t in known for w in t), Counter(), 0
    for t in known:
        bi.update(zip(["<s>", *t], t, strict=False))
    n, v, docs = sum(uni.values()), len(uni), len(known)
    context = lambda h: docs if h == "<s>" else uni[h]
    bucket = lambda c: 0 if c < 1 else min(BUCKETS - 1, 1 + int(math.log2(c)))
    cells = Counter()
    for t in known:
        for h, w in zip(["<s>", *t], t, strict=False):
            c = context(h) - 1
            cells[bucket(c), (uni[w] - 1) / max(1, n - 1), (bi[h, w] - 1) / c if c > 0 else 0.0] += 1
    weights = np.full((BUCKETS, 3), 1 / 3)
    if cells:
        for _ in range(100):
            sums = np.zeros((BUCKETS, 3))
            for (b, p1, p2), k in cells.items():
                share = weights[b] * np.array([1 / (v + 1), p1, p2])
                sums[b] += k * share / share.sum()
            pooled = sums.sum(axis=0)
            rest = np.array([pooled[0] / pooled.sum(), 1 - pooled[0] / pooled.sum(), 0])
            weights = np.array([s / s.sum() if s.sum() > 0 else rest for s in sums])
    out = []
    for t in texts:
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = 0.0
        for h, w in zip(["<s>", *t], t, strict=False):
            c = context(h)
            score += math.log10(weights[bucket(c)] @ [1 / (v + 1), uni[w] / max(1, n), bi[h, w] / c if c else 0])
        out.append((len(t), sum(uni[w] > 0 for w in t), base, score))
    return n, out


def test_matches_brute_force(docs, corpus):
    rows = corpus[:80]
    n, want = brute(rows, [i % 4 != 1 for i, _ in rows])
    got = {r.doc_id: r for r in lm_scores(docs(rows), F.col("doc_id") % 4 != 1, block_bytes=20_000).collect()}
    for (i, _), (tokens, known, base, score) in zip(rows, want, strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=0.02)


def test_held_out_texts_are_likelier_than_by_the_base(docs, corpus):
    got = lm_scores(docs(corpus), F.col("doc_id") % 5 != 1).collect()
    held = [r for r in got if r.doc_id % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 3])
def test_other_orders(docs, corpus, order):
    got = lm_scores(docs(corpus[:40]), F.lit(True), order=order).collect()
    assert len(got) == 40 and all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_weights_sum_to_one():
    w = fit_weights(np.array([[0, -20, 1], [3, -10, -2]]), np.array([5.0, 7.0]), 2, 100)
    assert np.allclose(w.sum(axis=1), 1) and w[0, 2] < 1e-6 and w[3, 2] > w[3, 1]


def test_edges(docs):
    got = lm_scores(docs(EDGES), F.lit(True)).collect()
    assert len(got) == len(EDGES) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm_scores(docs([]), F.lit(True)).count() == 0
    assert {r.score for r in lm_scores(docs(EDGES), F.lit(None).cast("boolean")).collect()} == {0.0}
