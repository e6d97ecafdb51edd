import numpy as np
import pytest

from tamarisk.llm import language_id as LI
from tamarisk.llm import toxicity as TX
from tamarisk.llm.queries import op4_language_id, op5_toxicity

from .conftest import EDGES


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in op4_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)


def test_kernel_is_the_mean_of_set_cosines():
    table = LI.class_table(["abc abd", "xyz"])
    a, b = "abcab", "abd"

    def grams(t):
        return [{t[i : i + n] for i in range(len(t) - n + 1)} for n in LI.LENGTHS]

    want = np.mean([len(x & y) / np.sqrt(len(x) * len(y)) for x, y in zip(grams(a), grams(b), strict=True)])
    codes = np.unique(np.concatenate([(g & np.uint64(0xFFFFFFFF)).astype(np.uint32) for g in LI.ngrams(b, table)]))
    at, scale = LI.matches(a, table, codes)
    own = {int(c): 1 / np.sqrt(len(g)) for g in LI.ngrams(b, table) for c in (g & np.uint64(0xFFFFFFFF)).astype(np.uint32)}
    assert sum(s * own[int(codes[k])] for k, s in zip(at, scale, strict=True)) == pytest.approx(want)


def test_ridge_as_brute_force():
    """Kernel, Nyström features and one-versus-rest ridge worked out densely from sets of n-grams."""
    rng = np.random.default_rng(5)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(12))
    texts, labels = [make("abcde") for _ in range(8)] + [make("cdefg") for _ in range(8)], ["p"] * 8 + ["q"] * 8
    model = LI.fit(texts, labels, landmarks=3, ridge=0.01)

    def kernel(a, b):
        sets = [[{t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b)] for n in LI.LENGTHS]
        return np.mean([len(x & y) / np.sqrt(len(x) * len(y)) for x, y in sets])

    marks = [0, 1, 2, 8, 9, 10]
    k = np.array([[kernel(t, texts[m]) for m in marks] for t in texts])
    target = np.array([[float(x == c) for c in ("p", "q")] for x in labels])
    weights = np.linalg.solve(k.T @ k + 0.01 * len(texts) * k[marks] + 1e-8 * np.eye(len(marks)), k.T @ target)
    new = [make("abcde"), make("cdefg"), make("abcdefg")]
    want = np.array([[kernel(t, texts[m]) for m in marks] for t in new]) @ weights
    assert np.allclose(model.values(new), want, atol=1e-6)


def test_languages_of_edges(docs):
    model = LI.fit(["the cat and the dog", "le chat et le chien"] * 5, ["en", "fr"] * 5)
    got = LI.identify(docs([*EDGES, (8, "12 34 !?"), (9, "the dog and the cat"), (10, "漢字"), (11, "½ ² ①"), (12, "_ ٣")]), model).collect()
    pred = {r.doc_id: r.lang_pred for r in got}
    assert pred[1] == pred[2] == pred[3] == pred[8] == pred[11] == pred[12] == "und" and pred[9] == "en" and pred[10] in ("en", "fr")
    assert LI.identify(docs([]), model).count() == 0
    empty = LI.learn(docs([]))
    assert {r.lang_pred for r in LI.identify(docs([(1, "abc")]), empty).collect()} == {"und"}


def test_folding():
    assert TX.fold("L0S3R!") == " loser " and TX.fold("ѕсum") == " scum " and TX.fold("ÉTÉ 1diot") == " ete idiot "
    assert TX.fold("ＬＯＳＥＲ") == " loser " and TX.fold("𝓵𝓸𝓼𝓮𝓻") == " loser " and TX.fold("lồser…漢字") == " loser 漢字 "
    assert TX.fold("sc​um") == " scum " and TX.fold("") == "  "


def test_hits_and_exceptions():
    model = TX.Model({" scum": 2.0, " scum bag ": 3.0, " loser ": 1.0}, [" pond scum "])
    made = model.automaton()
    assert [w for _, _, w in TX.hits(TX.fold("Scummy loser losers"), made)] == [2.0, 1.0]
    assert TX.hits(TX.fold("the pond scum here"), made) == []
    assert [w for _, _, w in TX.hits(TX.fold("pond scum, scum bag"), made)] == [3.0]


def test_learned_lexicon(spark, docs):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefg"), 5))
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        body = [word() for _ in range(40)]
        if bad:
            body[i % 40] = "zlorp" + word()
        elif i % 7 == 0:
            body[3:5] = ["pond", "scumx"]
        rows.append((i, " ".join(body)))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = TX.learn(docs(rows), frame.where("doc_id < 250"))
    assert " zlorp" in model.weights and len(model.weights) == 1
    got = {r.doc_id: r for r in TX.toxicity(docs(rows), model).collect()}
    assert all(got[i].predicted == t for i, t in labels) and all(0 <= r.score <= 1 for r in got.values())
    assert sorted(r.doc_id for r in TX.reject_toxic(docs(rows), model).collect()) == [i for i, t in labels if not t]
    shared = [(None, rows[0][1]), (None, rows[1][1]), (7, rows[5][1]), (7, rows[6][1])]  # each row by its own text, whatever its id
    assert sorted((r.doc_id or 0, r.text) for r in TX.reject_toxic(docs(shared), model).collect()) == [(0, rows[1][1]), (7, rows[6][1])]
    assert model.power > 0
    edges = TX.toxicity(docs(EDGES), model).collect()
    assert len(edges) == len(EDGES) and not any(r.predicted for r in edges)
    assert TX.toxicity(docs([]), model).count() == 0
    none = TX.learn(docs(rows), frame.where(F.lit(False)))
    assert {r.predicted for r in TX.toxicity(docs(rows[:3]), none).collect()} == {0}


def test_rare_precise_entry_among_many_common_words(docs):
    """Over 20,000 prefixes that all texts have don't displace one that a third of the toxic texts have."""
    rng = np.random.default_rng(4)
    common = ["".join(w) for w in rng.choice(list("abcdefghijklm"), (6000, 8))]
    rows = [(i, " ".join([*(common[k] for k in rng.permutation(6000)), *(["zlorp"] if i % 12 == 0 else ["plain"])])) for i in range(240)]
    labels = docs(rows).selectExpr("doc_id", "CAST(doc_id % 4 = 0 AS INT) AS toxic")
    assert list(TX.learn(docs(rows), labels).weights) == [" zlorp "]


def test_toxicity_query(spark, sf):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in op5_toxicity(spark, sf).collect() if r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in got]) > 0.85
