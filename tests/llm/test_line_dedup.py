import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tamarisk.llm import line_dedup as L

from .conftest import EDGES


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=25), st.text("ab", max_size=25), st.integers(0, 30))
def test_edit_distance(a, b, most):
    d, got = levenshtein(a, b), L.edit_distance(a, b, most)
    assert got == d if d <= most else got > most


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("aé漢😀", max_size=70), st.text("aé漢😀", max_size=70)), max_size=9))
def test_edit_distances_side_by_side(pairs):
    assert L.edit_distances(pairs) == [levenshtein(a, b) for a, b in pairs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["aa", "b", "ccc", "d"]), max_size=12), st.lists(st.sampled_from(["aa", "b", "ccc", "d"]), max_size=12))
def test_alignment_is_a_bound_from_above(a, b):
    a, b = [x.encode() for x in a], [x.encode() for x in b]
    assert L.alignment_cost(a, b, 10**9) >= levenshtein(b" ".join(a), b" ".join(b))


def exact_only(rows):
    """Brute force: each line's first occurrence stays, and every blank line."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            key = b" ".join(line.encode().lower().split())
            if not key or key not in seen:
                kept.append(line)
                seen.add(key)
        out[i] = "\n".join(kept)
    return out


def test_equal_lines_as_brute_force(docs, corpus):
    got = {r.doc_id: r for r in L.line_dedup(docs(corpus), least=1.0).collect()}
    assert {i: r.text for i, r in got.items()} == exact_only(corpus)


def test_similar_lines_as_brute_force(docs):
    """Of the pairs that are similar by the definition, nine of ten are found; no group joins lines that no chain of such pairs joins."""
    rng = random.Random(14)
    word = lambda: rng.choice(vocabulary) if rng.random() < 0.6 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(150)]
    lines = []
    for _ in range(150):
        base = [word() for _ in range(rng.choice((6, 9, 15, 30, 60)))]
        for _ in range(3):
            share = rng.choice((0.03, 0.06, 0.1, 0.15))
            lines.append(" ".join(word() if rng.random() < share else w for w in base))
    lines = sorted(set(lines))
    near = [(a, b) for b in range(len(lines)) for a in range(b) if abs(len(lines[a]) - len(lines[b])) <= 0.2 * max(len(lines[a]), len(lines[b])) and L.similar(lines[a].encode(), lines[b].encode(), 0.8)]
    assert all(levenshtein(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b])) + 1e-9 for a, b in near[::7])
    root = list(range(len(lines)))
    for a, b in near:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    frame = docs(list(enumerate(lines)))
    made = L.lines_of(frame, "doc_id", "text").cache()
    group = {r.id: r.g for r in made.join(L.line_groups(made), ["h", "c"]).select("id", "g").collect()}
    assert sum(a in group and group[a] == group.get(b) for a, b in near) >= 0.9 * len(near) and len(near) > 200
    by_group = {}
    for i, g in group.items():
        by_group.setdefault(g, set()).add(root[i])
    assert all(len(x) == 1 for x in by_group.values())


def test_similar_lines_and_chains(docs):
    rng = random.Random(4)
    words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    base = words[:60]
    one, two = [*base[:-1], "zzzz"], [*base[:-2], "yyyy", "zzzz"]
    rows = [(1, " ".join(base) + "\nshort line"), (2, " ".join(one).upper() + "\nother line"), (3, " ".join(two) + "\nShort  line"), (4, " ".join(words[100:160]))]
    got = {r.doc_id: (r.text, r.dropped_lines) for r in L.line_dedup(docs(rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("other line", 1) and got[3] == ("", 2) and got[4] == (rows[3][1], 0)
    assert {r.doc_id: r.n_chars for r in L.without_repeated_lines(docs(rows)).collect()} == {1: len(rows[0][1]), 2: 10, 4: len(rows[3][1])}


def test_lines_without_spaces_and_very_long_lines(docs):
    rng = random.Random(8)
    kana = "".join(chr(rng.randint(0x4E00, 0x4F00)) for _ in range(200))
    long = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30_000)]
    changed = [w if k % 50 else w[:2] + "zz" + w[4:] for k, w in enumerate(long)]
    half = [w if k % 2 else "q" * 5 for k, w in enumerate(long)]
    rows = [(1, kana), (2, kana[:90] + "一二三" + kana[93:]), (3, kana[::-1]), (4, " ".join(long)), (5, " ".join(changed)), (6, " ".join(half)), (7, "xyz" * 100_000), (8, "xyz" * 100_001)]
    assert {r.doc_id for r in L.line_dedup(docs(rows)).collect() if r.dropped_lines} == {2, 5, 8}


def test_columns_with_the_names_the_stage_uses(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    frame = frame.withColumn("__row", F.lit("r")).withColumn("__drop", F.lit("d")).withColumn("dropped_lines", F.lit("n")).withColumn("row", F.lit("w")).withColumn("h", F.lit("h"))
    kept = L.without_repeated_lines(frame).collect()
    assert [(r.doc_id, r["__row"], r["__drop"], r.dropped_lines, r.row, r.h) for r in kept] == [(1, "r", "d", "n", "w", "h")]
    assert {r.doc_id: r.dropped_lines for r in L.line_dedup(frame).collect()} == {1: 0, 2: 1}


def test_large_values_lose_no_link(spark):
    """Many similar lines under one value: leaders and the second comparison join what all pairs would."""
    rng = random.Random(5)
    base = [f"word{i:03d}" for i in range(50)]
    lines = [" ".join(w if rng.random() > 0.04 else f"x{rng.randrange(10**6)}" for w in base) for _ in range(150)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    made = L.lines_of(frame, "doc_id", "text").cache()
    few = {(r.h): r.g for r in L.line_groups(made, small=4, limit=16).collect()}
    many = {(r.h): r.g for r in L.line_groups(made, small=10_000).collect()}
    assert few == many and len(set(many.values())) == 1 and len(many) > 100


def test_all_pairs_of_a_large_value_are_tried(spark):
    """Lines k and k + 20 of one value are alike, and no line is like its leader but one, or like its nearest ones."""
    blocks = spark.createDataFrame([(0, k, (1 << k) - 1, 0) for k in range(36)], "grp long, h long, s0 long, s1 long")
    texts = spark.createDataFrame([(k, str(k).encode()) for k in range(36)], "h long, text binary")
    found = L.candidates(blocks, 36, 4, 36).cache()
    got = {r.node: r.root for r in L.linked(found, texts, lambda x, y: abs(int(x) - int(y)) == 20, 36).collect()}
    assert {(k, got.get(k)) for k in range(16)} == {(k, got.get(k + 20)) for k in range(16)}
    assert len(got) == 32 and len(set(got.values())) == 16


def test_lines_of_a_value_hand_out_no_row_for_each_pair(spark, monkeypatch):
    """All lines of a value are within budget and few are alike: as many rows as lines are joined with texts, in one piece or in slices."""
    blocks = spark.createDataFrame([(0, k, (1 << k % 18) - 1, 0) for k in range(72)], "grp long, h long, s0 long, s1 long")
    texts = spark.createDataFrame([(k, str(k).encode()) for k in range(72)], "h long, text binary")
    given, verify = [], L.verify
    monkeypatch.setattr(L, "verify", lambda pairs, *rest: given.append(pairs.count()) or verify(pairs, *rest))
    for rows in (L.SLICE_ROWS, 7):
        monkeypatch.setattr(L, "SLICE_ROWS", rows)
        got = {r.node: r.root for r in L.linked(L.candidates(blocks, 36, 4, 72), texts, lambda x, y: abs(int(x) - int(y)) == 40, 36).collect()}
        assert got == {k: k % 40 for k in (*range(32), *range(40, 72))}
    assert sum(given) <= 2 * 72


def test_edges(docs):
    rows = [*EDGES, (7, "one two three four five\none two three four five"), (None, "one two three four five")]
    got = L.line_dedup(docs(rows)).collect()
    assert len(got) == len(rows) and "digest" in got[0].asDict()
    by = {(r.doc_id, r.text) for r in got}
    assert (7, "one two three four five") in by and (None, "") in by and (2, None) in by and (1, "") in by
    assert L.line_dedup(docs([])).count() == 0


def test_text_of_many_repeated_lines(docs):
    """A hundred thousand equal lines in one text, and as many of which every other one repeats."""
    many = ["the same line of seven words stands here"] * 100_000
    mixed = [f"line {i} has a number of its own, {i * 7919}" if i % 2 else "short one" for i in range(50_000)]
    got = {r.doc_id: r for r in L.line_dedup(docs([(1, "\n".join(many)), (2, "\n".join(mixed[:2000]))])).collect()}
    assert got[1].text == many[0] and got[1].dropped_lines == len(many) - 1
    kept = got[2].text.split("\n")
    assert kept[:2] == mixed[:2] and kept.count("short one") == 1 and len(kept) + got[2].dropped_lines == 2000
