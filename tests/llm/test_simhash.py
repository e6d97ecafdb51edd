import random
import re

import numpy as np
import pytest
import xxhash

from tamarisk.llm import simhash_dedup as H
from tamarisk.llm.components import connected_components

from .conftest import EDGES


def fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(rows, width=3, budget=3):
    prints = [fingerprint(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(f"{p:016x}", least.get(find(k))) for k, p in enumerate(prints)]


def key(row):
    return tuple("" if x is None else str(x) for x in row)


def test_brute_force(docs, corpus):
    rng = random.Random(6)
    near = [(1000 + k, " ".join(w if rng.random() > 0.004 else "changed" for w in t.split(" "))) for k, (_, t) in enumerate(corpus[:40])]
    rows = [*corpus, *near, *EDGES]
    want = sorted(((i, *g) for (i, _), g in zip(rows, groups(rows), strict=True)), key=key)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in H.simhash_groups(docs(rows)).collect()), key=key) == want
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in H.simhash_groups(docs(rows), limit=8).collect()), key=key) == want


def test_ids_over_the_whole_range(docs):
    rows = [(2**62 + 5, "a b c d"), (2**62 + 6, "A b c d"), (-(2**63), "q r s"), (2**63 - 1, "q r s"), (-1, "")]
    got = {r.doc_id: r.component_id for r in H.simhash_groups(docs(rows)).collect()}
    assert got == {2**62 + 5: 2**62 + 5, 2**62 + 6: 2**62 + 5, -(2**63): -(2**63), 2**63 - 1: -(2**63), -1: -1}
    assert sorted(r.doc_id for r in H.simhash_dedup(docs(rows)).collect()) == [-(2**63), -1, 2**62 + 5]


def test_more_tries_give_the_same_components(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = np.unique(np.array([int(base[k % 60]) ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))}) for k in range(400)], dtype=np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    few, many = (sorted(map(tuple, connected_components(H.near_links(frame, plan=H.tries(n, 3), limit=limit)).collect())) for n, limit in ((len(prints), 8192), (1 << 40, 8)))
    assert few == many
    assert 50 <= len({r for _, r in few}) <= 60
    assert len(H.tries(1 << 40, 3)) == 10 and all(sum(size for _, size in order) == 64 and 25 <= top <= 26 for order, top in H.tries(1 << 40, 3))


@pytest.mark.parametrize("two_sides", [False, True])
def test_trie_join(two_sides):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 5, dtype=np.uint64)]
    f = np.unique(np.array([base[k % 5] ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 9))}) for k in range(200)], dtype=np.uint64))
    side = rng.integers(0, 2, len(f)) if two_sides else None
    label = list(range(len(f)))
    for i in range(len(f)):
        for j in range(i):
            x = int(f[i]) ^ int(f[j])
            if x >> 48 == 0 and x.bit_count() <= 3 and (side is None or side[i] != side[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert label == H.trie_components(f, side, 3, 16, step=64).tolist()


def test_majority_of_many():
    h = np.random.default_rng(2).integers(0, 2**63, 1500, dtype=np.uint64)
    out = H.majority(h, np.array([0, 1, 2, 700, 0, 797]))
    ones = [int(((h[3:703] >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    assert int(out[3]) == sum(1 << b for b in range(64) if 2 * ones[b] > 700) and out[0] == out[4] == 0 and out[1] == h[0] and out[2] == h[1] & h[2]


def test_one_of_each_group_stays(docs):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "q w e r t y u"), (None, "a b c d e f g"), (7, ""), (8, None)]
    kept = H.simhash_dedup(docs(rows))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 2, 7] and kept.columns == docs([]).columns
    same = [(4, "a b c d e f g"), (4, "x y z"), (5, "A b c d e f g"), (None, "q r s t")]  # an id that two texts share: each has its own fate
    assert sorted((r.doc_id or 0, r.text) for r in H.simhash_dedup(docs(same)).collect()) == [(0, "q r s t"), (4, "a b c d e f g"), (4, "x y z")]
    assert H.simhash_groups(docs([])).count() == 0 and H.simhash_dedup(docs([])).count() == 0


def test_components_by_stars_and_in_one_task(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1030)] + [(5000, i) for i in range(5001, 5100)]
    frame = spark.createDataFrame(edges, "a long, b long")
    one, stars = (sorted(map(tuple, connected_components(frame, one_task=n).collect())) for n in (10**6, 0))
    assert one == stars and ((1030, 1000) in one) and ((5000, 5000) in one)
    assert connected_components(frame.limit(0)).count() == 0
