"""Audits recorded answers: which sentences do the turns before them support?

    python -m jobs.audit_answers --config jobs/audit_answers.json --run 2026-01-31

Reads conversations (conv_id, turn, role, text), checks every sentence of every answer against the
passages that came before it, and writes two tables, partitioned by run and outcome: ``verdicts`` (a
row per sentence, by ``supported``) and ``reports`` (a row per answer, by ``verdict``). A run that is
repeated replaces its own partitions only. Paths may be anything that Spark reads and writes.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.groundedness import SUPPORTED_FROM, report, verdicts
from tamarisk.plans.audit import recorded_answers

log = logging.getLogger("jobs.audit_answers")

VERDICTS = "qid string, pos int, sentence string, score double, supported boolean, best_source string"
REPORTS = "conv_id long, turn long, score double, n_sentences long, n_unsupported long, summary string, run string, verdict string"


def audit_answers(
    spark: SparkSession, conversations: str, output: str, run: str, answer_role: str = "assistant", passage_role: str = "user", last: int = 4, threshold: float = SUPPORTED_FROM
) -> dict[str, int]:
    """Audits all answers below ``conversations`` (Parquet) as run ``run``; returns how many turns were read and answers and sentences written."""
    turns = spark.read.parquet(conversations)
    answers, hits = recorded_answers(turns, answer_role, passage_role, last)
    folder = lambda name: f"{output.rstrip('/')}/{name}/run={run}"
    verdicts(answers.select("qid", "answer"), hits, threshold).write.mode("overwrite").partitionBy("supported").parquet(folder("verdicts"))
    judged = spark.read.schema(VERDICTS).parquet(folder("verdicts"))
    reports = report(answers.select("qid", "answer"), hits, threshold, judged).join(answers.select("qid", "conv_id", "turn"), "qid")
    verdict = F.when(F.col("degenerate"), "degenerate").when(F.col("n_unsupported") > 0, "unsupported").otherwise("clean")
    chosen = reports.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "score", "n_sentences", "n_unsupported", "summary", verdict.alias("verdict"))
    chosen.write.mode("overwrite").partitionBy("verdict").parquet(folder("reports"))
    done = {"turns": turns.count(), "sentences": judged.count(), "answers": read_reports(spark, output, run).count()}
    log.info("read %d turns from %s", done["turns"], conversations)
    log.info("wrote %d sentences and %d answers of run %s to %s", done["sentences"], done["answers"], run, output)
    return done


def read_reports(spark: SparkSession, output: str, run: str | None = None) -> DataFrame:
    """(conv_id, turn, score, n_sentences, n_unsupported, summary, run, verdict) of one run, or of all."""
    found = spark.read.schema(REPORTS).parquet(f"{output.rstrip('/')}/reports")
    return found if run is None else found.where(F.col("run") == run)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--config", help="JSON file with the parameters of audit_answers")
    for name in ("conversations", "output", "run"):
        parser.add_argument(f"--{name}", help=f"{name}, instead of what the config file says")
    given = vars(parser.parse_args(arguments))
    settings = {}
    if path := given.pop("config"):
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
    settings |= {k: v for k, v in given.items() if v}
    if missing := [k for k in ("conversations", "output", "run") if k not in settings]:
        parser.error(f"not given: {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("audit_answers").getOrCreate()
    try:
        audit_answers(spark, **settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
