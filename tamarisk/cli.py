"""Command line: ingest, ask, chat, evaluate, calibrate, info. Exit codes: 0 done, 1 failed, 2 usage, 130 interrupted."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from .plans import evaluate as E
from .plans.pipeline import RagPipeline, ingest, summary
from .plans.settings import Settings
from .sources.documents import read_questions
from .sources.store import Store, get_meta


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamarisk")
    p.add_argument("--index-dir")
    p.add_argument("--backend")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest")
    one.add_argument("--docs-dir")
    one.add_argument("--append", action="store_true")
    ask = sub.add_parser("ask")
    ask.add_argument("question", nargs="+")
    ask.add_argument("--top-k", type=int)
    ask.add_argument("--mode", dest="answer_mode")
    sub.add_parser("chat")
    test = sub.add_parser("evaluate")
    test.add_argument("questions")
    test.add_argument("--generate", action="store_true")
    test.add_argument("--gate", action="store_true", help="exit with 1 if a metric misses its minimum")
    test.add_argument("--log", help="folder to which a JSON line of each question is appended")
    grid = sub.add_parser("calibrate")
    grid.add_argument("questions")
    sub.add_parser("info")
    return p


def shown(row) -> str:
    """An answer with its sources, its mode and its audit."""
    lines = [row.text, "", f"[{row.mode}] {row.retrieval_seconds:.1f} s + {row.generation_seconds:.1f} s"]
    lines += [f"  [{h.rank}] {h.source}" + (f" > {h.heading}" if h.heading else "") + f"  {h.score:.3f} ({h.matched_by})" for h in row.hits or []]
    if row.summary:
        lines.append(row.summary)
        lines += [f"  ! {v.sentence}" for v in row.verdicts or [] if not v.supported]
    return "\n".join(lines)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    known = {k: v for k, v in vars(args).items() if v is not None and hasattr(Settings, k)}
    settings = replace(Settings.from_env(), **known)
    spark = spark or SparkSession.builder.appName("tamarisk").getOrCreate()
    try:
        if args.command == "ingest":
            print(summary(ingest(spark, settings, reset=not args.append)))
        elif args.command == "info":
            store = Store(spark, settings.index_dir)
            print(f"{store.chunks().count()} chunks, {get_meta(store.meta(), 'embedding_signature', 'no signature')}")
            for row in store.sources().toLocalIterator():
                print(row.source)
        else:
            with RagPipeline(spark, settings) as rag:
                if args.command == "ask":
                    asked = spark.createDataFrame([(0, " ".join(args.question))], "qid long, question string")
                    print(shown(rag.answer(asked).first()))
                elif args.command == "evaluate":
                    results, summed = E.evaluate(rag, read_questions(spark, args.questions), args.generate)
                    if args.log:
                        E.append_results(results, args.log)
                    print(E.report(results.orderBy("id").toLocalIterator(), summed.first(), settings))
                    if args.gate:
                        gate = E.quality_gate(summed).collect()
                        for g in gate:
                            print(f"{g.name}: {g.actual:.3f} (>= {g.minimum}) {'ok' if g.passed else 'FAILED'}")
                        return 0 if all(g.passed for g in gate) else 1
                elif args.command == "calibrate":
                    cells = E.calibrate_pipeline(rag, read_questions(spark, args.questions)).cache()
                    print(E.calibration_report(cells.collect(), E.best_cell(cells).first(), settings))
                    cells.unpersist()
                else:
                    for line in sys.stdin:
                        for piece in rag.stream_answer(line):
                            print(piece, end="", flush=True)
                        print()
    except KeyboardInterrupt:
        return 130
    except (ValueError, RuntimeError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
