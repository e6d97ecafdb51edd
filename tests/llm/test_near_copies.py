import random

import corpus_pipeline as P
from tamarisk.llm import near_copies as N
from tamarisk.llm.simhash_dedup import simhash_groups

from .conftest import EDGES


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_stage_finds_pairs_at_the_similarity_and_spares_others(spark, sf, docs):
    rng = random.Random(3)
    rows, want = [], set()
    for k in range(120):
        words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(rng.choice((60, 120, 300)))]
        copy = list(words)
        for at in range(3, len(words), rng.choice((35, 60, 15, 20))):  # about 0.75, 0.85, 0.5 and 0.6
            copy[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy).upper())]
        a, b = shingles(rows[-1][1]), shingles(rows[-2][1])
        if len(a & b) >= 0.8 * len(a | b):
            want.add(2 * k + 1)
    kept = {r.doc_id for r in P.near_copy_stage(spark, docs(rows), sf).collect()}
    bits = {r.doc_id for r in simhash_groups(docs(rows), width=5).where("doc_id <> component_id").collect()}
    assert len(want - bits) > 20 and {i for i, _ in rows} - kept == want | bits and len(bits - want) < 3


def test_large_groups_lose_no_link(docs):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(200), 2):
            words[at] = f"x{k}"
        rows.append((k, " ".join(words)))
    frame = docs(rows).selectExpr("doc_id id", "doc_id h", "text")
    made = {r.node: r.root for r in N.near_roots(frame, small=4, limit=16).collect()}
    assert made == {r.node: r.root for r in N.near_roots(frame, small=1000).collect()} and len(made) > 50


def test_edges(docs):
    kept = N.near_dedup(docs([*EDGES, (9, "A  b")]))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 4, 4, 5, 6] and kept.columns == docs([]).columns
    assert N.near_dedup(docs([])).count() == 0
