import pytest

from tamarisk.cli import main
from tamarisk.operators import answer as A
from tamarisk.operators.backends import HashingBackend, UdfBackend
from tamarisk.plans.pipeline import RagPipeline, ingest
from tamarisk.plans.settings import Settings
from tamarisk.sources.documents import read_questions, scan_documents
from tamarisk.sources.store import EmptyIndex, IndexMismatch, Store, get_meta
from tamarisk.streaming.ingest import document_stream, stream_ingest


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    (d / "sub").mkdir(parents=True)
    (d / "kedi.md").write_text("# Kediler\n\n## Uyku\nKediler günde on altı saat kadar uyur ve çok dinlenir.\n\n## Av\nKediler geceleri fare yakalar.", "utf-8")
    (d / "sub" / "kahve.MD").write_text("# Kahve\n\n## Demleme\nKahve doksan derecelik suyla demlenir ve fincanda sunulur.", "utf-8")
    (d / "bos.txt").write_text("  \n", "utf-8")
    (d / "x.pdf").write_text("no", "utf-8")
    return d


@pytest.fixture
def settings(tmp_path, folder):
    return Settings(docs_dir=str(folder), index_dir=str(tmp_path / "index"), chunk_size=300, chunk_overlap=50, top_k=3, min_similarity=0.1)


def asked(spark, *q):
    return spark.createDataFrame(list(enumerate(q)), "qid long, question string")


def test_round_trip(spark, settings):
    got = ingest(spark, settings)
    assert (got["documents"], got["chunks"], got["inserted"], got["skipped"]) == (3, 3, 3, ["bos.txt (bos)"])
    assert ingest(spark, settings, reset=False)["inserted"] == 0
    with RagPipeline(spark, settings) as rag:
        rows = {r.qid: r for r in rag.answer(asked(spark, "Kediler kaç saat uyur?", "  ", "xyzq wvut")).collect()}
        assert rows[0].grounded and rows[0].sources[0] == "kedi.md" and "uyur" in rows[0].text
        assert rows[1].mode == "blank" and rows[1].text == A.BLANK_QUESTION
        assert rows[2].mode == "no-context" and not rows[2].grounded
        assert "".join(rag.stream_answer("Kahve nasıl demlenir?")) and list(rag.stream_answer(" ")) == [A.BLANK_QUESTION] and list(rag.stream_answer("xyzq wvut")) == [A.NO_ANSWER]
        first = rows[0].hits[0]
        assert (first.rank, first.source, first.heading) == (1, "kedi.md", "Uyku") and first.score >= 0.1 and first.matched_by == "ikisi"
        assert rows[0].verdicts and all(v.supported for v in rows[0].verdicts[:1]) and "Kaynaklilik" in rows[0].summary
        assert rows[0].retrieval_seconds > 0 and rows[0].generation_seconds > 0 and rows[2].hits is None


def test_breaker_replaces_a_fabricated_answer(spark, settings):
    liar = UdfBackend("liar", 512, lambda texts: [__import__("tamarisk.functions.hashing", fromlist=["embed"]).embed(t) for t in texts],
                      lambda chats: ["Ay yüzeyinde peynir madenleri işleten robotlar yaşamaktadır." for _ in chats])
    ingest(spark, settings, backend=liar)
    with RagPipeline(spark, settings, backend=liar) as rag:
        row = rag.answer(asked(spark, "Kediler kaç saat uyur?")).first()
        assert row.mode == "extractive-fallback" and row.text.endswith(A.FALLBACK_NOTICE) and row.score == 0.0


def test_settings_reach_the_model_and_the_breaker(spark, settings):
    from dataclasses import replace

    from tamarisk.functions.hashing import embed

    def chat(chats, temperature, max_tokens):
        return [f"Kediler günde on altı saat kadar uyur ve çok dinlenir. Robotlar {temperature} {max_tokens} peynir madenleri işletir {'English' in c[0]['content']}." for c in chats]

    half = UdfBackend("half", 512, lambda texts: [embed(t) for t in texts], chat, stream_fn=lambda messages: iter(["a", messages[1]["role"]]))
    half.close = lambda: closed.append(1)
    closed = []
    ingest(spark, settings, backend=half)
    for least, mode in ((0.5, "generative"), (0.51, "extractive-fallback")):
        with RagPipeline(spark, replace(settings, min_groundedness=least, answer_language="English", temperature=0.7, max_tokens=42), backend=half) as rag:
            row = rag.answer(asked(spark, "Kediler kaç saat uyur?")).first()
            assert row.mode == mode and row.score == 0.5 and [v.supported for v in row.verdicts] == [True, False]
            assert mode != "generative" or "0.7 42" in row.text and "True" in row.text
            assert list(rag.stream_answer("Kediler uyur mu?")) == ["a", "user"]
    with RagPipeline(spark, replace(settings, answer_mode="extractive", check_groundedness=False), backend=half) as rag:
        row = rag.answer(asked(spark, "Kediler kaç saat uyur?")).first()
        assert row.mode == "extractive" and row.score is None and row.generation_seconds == 0 and row.verdicts is None
    assert closed == [1, 1, 1]


def test_plan_of_an_answer_stays_small(spark, settings):
    import time

    ingest(spark, settings)
    with RagPipeline(spark, settings) as rag:
        rag.answer(asked(spark, "ısınma")).collect()
        began = time.perf_counter()
        out = rag.answer(asked(spark, "Kediler kaç saat uyur?"))
        out.collect()
        assert time.perf_counter() - began < 15 and len(out._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_evaluation(spark, settings, tmp_path):
    from tamarisk.plans import evaluate as E

    ingest(spark, settings)
    rows = [("q1", "Kediler kaç saat uyur?", "kedi.md", ["on altı", "zürafa"]), ("q2", "Kahve nasıl demlenir?", "yok.md", None), ("q3", "xyzq wvut", None, None)]
    questions = spark.createDataFrame(rows, "id string, question string, expected_source string, expected_keywords array<string>")
    with RagPipeline(spark, settings) as rag:
        results, summary = E.evaluate(rag, questions, generate=True)
        r = {x.id: x for x in results.collect()}
        assert (r["q1"].rank, r["q1"].hit, r["q1"].correct, r["q1"].keywords_found) == (1, True, True, ["on altı"]) and r["q1"].seconds > 0
        assert not r["q2"].correct and r["q3"].refused and r["q3"].correct and r["q3"].retrieved_sources == [] and r["q3"].top_score == 0
        s = summary.first()
        assert (s.questions, s.n_answerable, s.refusal_accuracy, s.keyword_rate) == (3, 2, 1.0, 0.5) and s.avg_seconds > 0
        text = E.report(results.orderBy("id").collect(), s, settings)
        assert "[q2] Kahve" in text and "refusals 100.0%" in text and "keyword 50.0%" in text
        E.append_results(results, str(tmp_path / "log"))
        E.append_results(results, str(tmp_path / "log"))
        assert spark.read.json(str(tmp_path / "log")).count() == 6
        plain, _ = E.evaluate(rag, questions)
        assert {x.id: (x.hit, x.refused) for x in plain.collect()}["q3"] == (False, True)
        cells = E.calibrate_pipeline(rag, questions).collect()
        assert len(cells) == 66 and "best: lexical_scale" in E.calibration_report(cells, cells[0], settings)


def test_a_model_that_does_not_load_is_replaced_with_a_warning(monkeypatch):
    from tamarisk.operators import backends as B

    def broken():
        raise OSError("no weights")

    monkeypatch.setitem(B.REGISTRY, "broken", broken)
    with pytest.warns(UserWarning, match="no weights"):
        assert isinstance(B.create_backend(), HashingBackend)


def test_index_errors(spark, settings, tmp_path):
    with pytest.raises(EmptyIndex):
        RagPipeline(spark, settings)
    ingest(spark, settings)
    Store(spark, settings.index_dir).set_meta({"embedding_signature": "other:3"})
    assert get_meta(Store(spark, settings.index_dir).meta(), "embedding_signature") == "other:3"
    with pytest.raises(IndexMismatch):
        RagPipeline(spark, settings)
    with pytest.raises(FileNotFoundError):
        scan_documents(spark, str(tmp_path / "none"))


def test_streaming_appends_once(spark, settings, folder, tmp_path):
    store = Store(spark, settings.index_dir)
    for _ in range(2):
        stream_ingest(document_stream(spark, str(folder)), store, HashingBackend(), str(tmp_path / "cp"), once=True).awaitTermination(120)
        assert store.chunks().count() == 3
    (folder / "yeni.md").write_text("Yeni belge burada duruyor ve okunuyor.", "utf-8")
    stream_ingest(document_stream(spark, str(folder)), store, HashingBackend(), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert store.chunks().count() == 4


def test_settings():
    s = Settings.from_env({"TAMARISK_TOP_K": "7", "TAMARISK_HYBRID": "no", "TAMARISK_CHUNK_SIZE": " "})
    assert (s.top_k, s.hybrid, s.chunk_size) == (7, False, 900)
    with pytest.raises(ValueError):
        Settings.from_env({"TAMARISK_TOP_K": "x"})
    for bad in ({"chunk_size": 0}, {"chunk_overlap": -1}, {"chunk_overlap": 900}, {"top_k": 0}, {"min_similarity": 2}, {"answer_mode": "?"}):
        with pytest.raises(ValueError):
            Settings(**bad).validate()


def test_cli_and_questions(spark, settings, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("TAMARISK_CHUNK_SIZE", "300")
    monkeypatch.setenv("TAMARISK_CHUNK_OVERLAP", "50")
    base = ["--index-dir", settings.index_dir]
    assert main([*base, "ingest", "--docs-dir", settings.docs_dir], spark) == 0
    assert main([*base, "ask", "Kediler", "uyur", "mu?"], spark) == 0 and main([*base, "info"], spark) == 0
    out = capsys.readouterr().out
    assert "[1] kedi.md > " in out and "Kaynaklilik" in out
    assert main(["--index-dir", str(tmp_path / "no"), "ask", "x"], spark) == 1
    path = tmp_path / "q.json"
    path.write_text('{"questions": [{"id": "a", "question": "q", "expected_source": null, "expected_keywords": ["k"]}]}', "utf-8")
    assert read_questions(spark, str(path)).first().expected_keywords == ["k"]
    assert main([*base, "evaluate", str(path)], spark) == 0 and main([*base, "evaluate", str(path), "--gate"], spark) == 1
    assert main([*base, "calibrate", str(path)], spark) == 0 and "best: lexical_scale" in capsys.readouterr().out


def test_sweep_agrees_with_the_grid(spark):
    """At every cell of a grid the sweep has the counts of the least threshold that it lists from there on."""
    import random

    from tamarisk.plans import evaluate as E

    rng = random.Random(2)
    pairs = [(q, i) for q in range(12) for i in range(30)]
    table = lambda top: spark.createDataFrame([(q, i, round(rng.random() * top, 2)) for q, i in pairs if rng.random() < 0.8], "qid long, id long, score double")
    dense, lexical = table(0.9).cache(), table(30).cache()
    sources = spark.createDataFrame([(i, f"s{i % 10}") for i in range(30)], "id long, source string")
    asked = spark.createDataFrame([(q, f"s{q}" if q % 3 else None) for q in range(13)], "qid long, expected string")
    cells = E.calibrate(asked, dense, lexical, sources, 3, scales=(4.0, 16.0)).collect()
    swept = E.sweep(asked, dense, lexical, sources, 3, scales=(4.0, 16.0)).collect()
    assert len({r.min_similarity for r in swept}) > 50
    for c in cells:
        at = min((r for r in swept if r.lexical_scale == c.lexical_scale and r.min_similarity >= c.min_similarity), key=lambda r: r.min_similarity)
        assert (at.recall, at.refusal, at.overall, at.balanced) == pytest.approx((c.recall, c.refusal, c.overall, c.balanced))
    assert max(r.balanced for r in swept) >= max(c.balanced for c in cells)
