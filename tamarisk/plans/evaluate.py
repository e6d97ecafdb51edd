"""Retrieval quality over a question set, a quality gate, and calibration over a threshold grid."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.answer import NO_ANSWER
from ..operators.hybrid import fuse

# What marks a refusal, the gate's minima, the calibration grid.
REFUSAL_MARKERS = (NO_ANSWER.lower(), "belgelerde yok", "bilmiyorum", "bilgi bulunmuyor", "yeterli bilgi yok")
GATE = {"recall_at_k": 0.84, "refusal_accuracy": 0.95, "overall_accuracy": 0.87}
SIMILARITIES = (0.0, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50, 0.60)
SCALES = (2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


def is_refusal(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for marker in REFUSAL_MARKERS:
        found = found | F.contains(low, F.lit(marker))
    return found


def keywords_found(answer: Column, keywords: Column) -> Column:
    return F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k)))


def judge(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, answerable, rank, hit, refused, correct) for questions (qid, expected) and hits (qid, rank, source)."""
    right = hits.join(questions.select("qid", "expected"), "qid").where(F.col("source") == F.col("expected")).groupBy("qid").agg(F.min("rank").alias("rank"))
    any_hit = hits.select("qid").distinct().withColumn("any", F.lit(True))
    out = questions.select("qid", F.col("expected").isNotNull().alias("answerable")).join(right, "qid", "left").join(any_hit, "qid", "left")
    hit = F.col("answerable") & F.col("rank").isNotNull()
    refused = ~F.col("answerable") & F.col("any").isNull()
    return out.select("qid", "answerable", F.when(hit, F.col("rank")).alias("rank"), hit.alias("hit"), refused.alias("refused"), (hit | refused).alias("correct"))


def metrics(judged: DataFrame, *by: str) -> DataFrame:
    """Recall, MRR, refusal and overall accuracy; kinds of question that don't occur count as 0."""
    share = lambda hit, of: F.coalesce(F.avg(F.when(of, hit.cast("double"))), F.lit(0.0))
    a = F.col("answerable")
    return judged.groupBy(*by).agg(
        F.count("*").alias("questions"),
        F.sum(a.cast("long")).alias("n_answerable"),
        share(F.col("hit"), a).alias("recall_at_k"),
        F.coalesce(F.avg(F.when(a, F.coalesce(1 / F.col("rank"), F.lit(0.0)))), F.lit(0.0)).alias("mrr"),
        share(F.col("refused"), ~a).alias("refusal_accuracy"),
        F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("overall_accuracy"),
    )


def quality_gate(summary: DataFrame, minima: dict[str, float] | None = None) -> DataFrame:
    """(name, actual, minimum, passed) for each metric with a minimum."""
    minima = GATE if minima is None else minima
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), F.round(F.col(k), 3).alias("actual"), F.lit(v).alias("minimum")) for k, v in minima.items()))
    return summary.select(F.inline(pairs)).withColumn("passed", F.col("actual") >= F.col("minimum"))


def _fused(dense: DataFrame, lexical: DataFrame, sources: DataFrame, pool: int) -> DataFrame:
    """(qid, fused, dense_rank, lex_rank, source, d, x): every candidate with its scores."""
    fused = fuse(dense, lexical, pool).join(dense.select("qid", "id", F.col("score").alias("d")), ["qid", "id"], "left")
    fused = fused.join(lexical.select("qid", "id", F.col("score").alias("x")), ["qid", "id"], "left")
    return fused.join(sources, "id").select("qid", "fused", "dense_rank", "lex_rank", "source", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("x", F.lit(0.0)).alias("x"))


def _confidence() -> Column:
    """Of columns d, x and lexical_scale."""
    return F.greatest("d", F.when(F.col("x") <= 0, 0.0).otherwise(F.col("x") / (F.greatest("x", F.lit(0.0)) + F.col("lexical_scale"))))


def _balanced(r: Column, f: Column) -> Column:
    return F.when(r + f == 0, F.lit(0.0)).otherwise(2 * r * f / F.when(r + f == 0, F.lit(1.0)).otherwise(r + f))


def calibrate(questions: DataFrame, dense: DataFrame, lexical: DataFrame, sources: DataFrame, top_k: int = 4, similarities=SIMILARITIES, scales=SCALES, multiplier: int = 5) -> DataFrame:
    """(lexical_scale, min_similarity, recall, refusal, overall, balanced) for every cell of the grid.

    Scores and fused ranks don't depend on the cell, so they are computed once; a cell is only a
    filter and a cut by rank. ``sources``: (id, source).
    """
    spark = questions.sparkSession
    fused = _fused(dense, lexical, sources, max(top_k * multiplier, top_k))
    grid = spark.createDataFrame([(sc, si) for sc in scales for si in similarities], "lexical_scale double, min_similarity double")
    cells = fused.crossJoin(F.broadcast(grid))  # a fixed number of cells against top_k * multiplier rows a question
    w = Window.partitionBy("lexical_scale", "min_similarity", "qid").orderBy(F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lex_rank"))
    hits = cells.where(_confidence() >= F.col("min_similarity")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    key = ["lexical_scale", "min_similarity", "qid"]
    found = hits.join(questions.select("qid", "expected"), "qid").groupBy(*key).agg(F.max((F.col("source") == F.col("expected")).cast("int")).alias("hit"))
    every = questions.select("qid", F.col("expected").isNotNull().alias("answerable")).crossJoin(F.broadcast(grid)).join(found.withColumn("any", F.lit(1)), key, "left")
    hit, refused = F.coalesce("hit", F.lit(0)) == 1, F.col("any").isNull()
    judged = every.select(*key, "answerable", F.lit(None).cast("int").alias("rank"), (F.col("answerable") & hit).alias("hit"), (~F.col("answerable") & refused).alias("refused"))
    judged = judged.withColumn("correct", F.col("hit") | F.col("refused"))
    m = metrics(judged, "lexical_scale", "min_similarity")
    r, f = F.col("recall_at_k"), F.col("refusal_accuracy")
    balanced = _balanced(r, f)
    return m.select("lexical_scale", "min_similarity", r.alias("recall"), f.alias("refusal"), F.col("overall_accuracy").alias("overall"), balanced.alias("balanced"))


def sweep(questions: DataFrame, dense: DataFrame, lexical: DataFrame, sources: DataFrame, top_k: int = 4, scales=SCALES, multiplier: int = 5) -> DataFrame:
    """What ``calibrate`` gives, for every threshold at which anything changes: (lexical_scale, min_similarity, recall, refusal, overall, balanced).

    A question's outcome changes only where the threshold passes the confidence of one of its
    candidates, of which there are ``2 * top_k * multiplier`` at most. Those changes, summed up by
    threshold in one sorted pass for each scale, give the counts at every confidence, and at 1 for
    thresholds above them all; between two of them the counts are those of the upper one.
    """
    spark = questions.sparkSession
    order = Window.partitionBy("qid").orderBy(F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lex_rank"))
    placed = _fused(dense, lexical, sources, max(top_k * multiplier, top_k)).withColumn("pos", F.row_number().over(order))
    scaled = spark.createDataFrame([(float(s),) for s in scales], "lexical_scale double")
    asked = questions.select("qid", "expected")
    rows = placed.join(asked, "qid").crossJoin(F.broadcast(scaled)).withColumn("right", F.coalesce(F.col("source") == F.col("expected"), F.lit(False)))
    listed = rows.groupBy("lexical_scale", "qid").agg(F.sort_array(F.collect_list(F.struct("pos", _confidence().alias("c"), "right"))).alias("found"))
    every = asked.select("qid", F.col("expected").isNotNull().alias("answerable")).crossJoin(F.broadcast(scaled)).join(listed, ["lexical_scale", "qid"], "left")
    every = every.withColumn("found", F.coalesce("found", F.array().cast("array<struct<pos:int,c:double,right:boolean>>"))).withColumn("at", F.array_sort(F.array_distinct(F.transform("found", lambda a: a["c"]))))
    passing = lambda v: F.slice(F.filter("found", lambda a: a["c"] >= v), 1, top_k)
    # 1 where the question is answered right at its i-th confidence; beyond the last one nothing is found, which is right if there is no answer
    good = F.transform("at", lambda v: F.when(F.col("answerable"), F.exists(passing(v), lambda a: a["right"]).cast("int")).otherwise(0))
    every = every.withColumn("good", F.concat(good, F.array(F.when(F.col("answerable"), 0).otherwise(1))))
    start = every.groupBy("lexical_scale").agg(
        F.count("*").alias("n"), F.sum(F.col("answerable").cast("long")).alias("asked"), F.sum(F.when(F.col("answerable"), F.get("good", F.lit(0))).otherwise(0)).alias("hits0"), F.sum(F.when(F.col("answerable"), 0).otherwise(F.get("good", F.lit(0)))).alias("refused0")
    )
    change = F.transform("at", lambda v, i: F.struct(v.alias("t"), (F.get("good", i + 1) - F.get("good", i)).alias("by")))
    changes = every.select("lexical_scale", "answerable", F.inline(change)).select("lexical_scale", "t", F.when(F.col("answerable"), F.col("by")).otherwise(0).alias("h"), F.when(F.col("answerable"), 0).otherwise(F.col("by")).alias("r"))
    above = scaled.select("lexical_scale", F.lit(1.0).alias("t"), F.lit(0).alias("h"), F.lit(0).alias("r"))
    summed = changes.unionByName(above).groupBy("lexical_scale", "t").agg(F.sum("h").alias("h"), F.sum("r").alias("r"))
    below = Window.partitionBy("lexical_scale").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    counted = summed.select("lexical_scale", "t", F.coalesce(F.sum("h").over(below), F.lit(0)).alias("h"), F.coalesce(F.sum("r").over(below), F.lit(0)).alias("r")).join(F.broadcast(start), "lexical_scale")  # a row for each scale
    hits, refused = F.col("hits0") + F.col("h"), F.col("refused0") + F.col("r")
    share = lambda a, n: F.coalesce(F.try_divide(a, n), F.lit(0.0))
    found = counted.select("lexical_scale", F.col("t").alias("min_similarity"), share(hits, F.col("asked")).alias("recall"), share(refused, F.col("n") - F.col("asked")).alias("refusal"), share(hits + refused, F.col("n")).alias("overall"))
    return found.withColumn("balanced", _balanced(F.col("recall"), F.col("refusal")))


def best_cell(grid: DataFrame, objective: str = "balanced") -> DataFrame:
    """The cell with the largest objective; of equals the one with the smallest scale, then threshold."""
    return grid.orderBy(F.desc(F.round(objective, 9)), "lexical_scale", "min_similarity").limit(1)


def evaluate(pipeline, questions: DataFrame, generate: bool = False) -> tuple[DataFrame, DataFrame]:
    """The results of every question (id, question, expected_source, expected_keywords), and their summary (one row).

    Results: id, question, answerable, expected_source, retrieved_sources, top_score, rank, hit,
    refused, correct, keywords_found, answer, seconds (the batch's, shared out evenly). With
    ``generate``, an answerable question also fails if its answer is a refusal, and an unanswerable
    one passes by a refusal too. Ids are unique.
    """
    asked = questions.select(F.xxhash64("id").alias("qid"), "id", "question", "expected_source", "expected_keywords")
    if generate:
        answered = pipeline.answer(asked.select("qid", "question"))
        found = answered.select("qid", F.col("text").alias("answer"), F.transform("hits", lambda h: F.struct(h["rank"].alias("rank"), h["source"].alias("source"), h["score"].alias("score"))).alias("h"),
                                (F.col("retrieval_seconds") + F.col("generation_seconds")).alias("all_seconds"))
    else:
        began = time.perf_counter()
        hits = pipeline.retrieve(asked.select("qid", "question")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "score"))).alias("h")).cache()
        hits.count()
        found = hits.select("qid", F.lit("").alias("answer"), "h", F.lit(time.perf_counter() - began).alias("all_seconds"))
    n = max(1, asked.count())
    h = F.coalesce("h", F.array().cast("array<struct<rank:int,source:string,score:double>>"))
    joined = asked.join(found, "qid", "left").withColumn("h", h).withColumn("answer", F.coalesce("answer", F.lit("")))
    sources, answerable = F.transform("h", lambda x: x["source"]), F.col("expected_source").isNotNull()
    rank = F.nullif(F.array_position(sources, F.col("expected_source")), F.lit(0)).cast("int")
    declined = is_refusal(F.col("answer")) if generate else F.lit(False)
    no_words = F.array().cast("array<string>")
    words = F.when(answerable, keywords_found(F.col("answer"), F.coalesce("expected_keywords", no_words))).otherwise(no_words) if generate else no_words
    results = joined.select(
        "id", "question", answerable.alias("answerable"), "expected_source", sources.alias("retrieved_sources"),
        F.coalesce(F.get("h", F.lit(0))["score"], F.lit(0.0)).alias("top_score"), rank.alias("rank"), F.coalesce(rank.isNotNull() & answerable, F.lit(False)).alias("hit"),
        F.when(answerable, declined).otherwise((F.size("h") == 0) | declined).alias("refused"), words.alias("keywords_found"), "answer",
        (F.coalesce("all_seconds", F.lit(0.0)) / n).alias("seconds"),
    )
    correct = F.when(F.col("answerable"), F.col("hit") & ~F.col("refused")).otherwise(F.col("refused"))
    results = results.withColumn("correct", correct)
    return results, summarise(results, generate)


def summarise(results: DataFrame, generate: bool) -> DataFrame:
    """``metrics`` of results, with the mean seconds and, for generated answers, the share of answerable questions whose answer has a keyword."""
    base = metrics(results)
    with_words = F.avg(F.when(F.col("answerable"), (F.size("keywords_found") > 0).cast("double")))
    more = results.agg(F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"), F.coalesce(with_words, F.lit(0.0)).alias("keyword_rate"))
    out = base.crossJoin(more)  # one row each
    return out.withColumn("generated", F.lit(generate)) if generate else out.drop("keyword_rate").withColumn("generated", F.lit(generate))


def report(results, summary, settings) -> str:
    """A table of the questions, the failed ones in detail, and the summary, as text."""
    lines, failed = [f"{'id':<8}{'':<6}{'expected':<36}{'rank':<6}{'score':<8}"], []
    for r in results:
        lines.append(f"{r.id:<8}{'ok' if r.correct else 'FAIL':<6}{r.expected_source or '(none)':<36}{r.rank or '-':<6}{r.top_score:<8.3f}")
        if not r.correct:
            failed += [f"[{r.id}] {r.question}", f"  expected {r.expected_source or 'no answer'}, found {', '.join(r.retrieved_sources) or 'nothing'}"]
            failed += [f"  {' '.join(r.answer.split())[:160]}"] if r.answer else []
    lines += ["", *failed] if failed else []
    lines += ["", f"backend {settings.backend}, top_k {settings.top_k}, min_similarity {settings.min_similarity}, chunks {settings.chunk_size}/{settings.chunk_overlap}"]
    lines += [f"{summary.questions} questions, {summary.n_answerable} answerable"]
    lines += [f"recall@{settings.top_k} {summary.recall_at_k:.1%}, MRR {summary.mrr:.3f}, refusals {summary.refusal_accuracy:.1%}, overall {summary.overall_accuracy:.1%}, {summary.avg_seconds:.2f} s a question"]
    return "\n".join(lines + ([f"answers with an expected keyword {summary.keyword_rate:.1%}"] if summary.generated else []))


def calibrate_pipeline(pipeline, questions: DataFrame, **options) -> DataFrame:
    """The grid of ``calibrate`` on an open index and a question set."""
    s = pipeline.settings
    asked = questions.select(F.xxhash64("id").alias("qid"), "question", F.col("expected_source").alias("expected"))
    dense, lexical = pipeline.scores(asked.select("qid", "question"))
    return calibrate(asked, dense, lexical, pipeline.chunks.select("id", "source"), s.top_k, **options)


def calibration_report(cells, best, settings) -> str:
    """The ten best cells, and how the best one compares with the settings in force."""
    lines = [f"{'scale':>8}{'floor':>8}{'recall':>9}{'refusal':>9}{'overall':>9}{'balanced':>10}"]
    for c in sorted(cells, key=lambda c: (-round(c.balanced, 9), c.lexical_scale, c.min_similarity))[:10]:
        lines.append(f"{c.lexical_scale:>8g}{c.min_similarity:>8.2f}{c.recall:>9.1%}{c.refusal:>9.1%}{c.overall:>9.1%}{c.balanced:>10.1%}")
    lines.append(f"best: lexical_scale {best.lexical_scale:g}, min_similarity {best.min_similarity:.2f}; now {settings.lexical_scale:g}, {settings.min_similarity:.2f}")
    return "\n".join(lines)


def append_results(results: DataFrame, path: str) -> None:
    """One JSON line per row, after those of earlier runs."""
    results.write.mode("append").json(path)


