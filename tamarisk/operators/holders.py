"""Which documents hold a text verbatim: one automaton over a block of texts, one scan of the documents a block."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that are looked for in one scan.
ITEM_BLOCK = 20_000


def first_holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, id): the least document (id, text) that holds each item (qid, question); blank items and those that none holds are left out."""
    import ahocorasick

    spark = docs.sparkSession
    known = items.where("question IS NOT NULL AND question <> ''").select("qid", "question")
    blocks = -(-known.count() // ITEM_BLOCK)
    out = spark.createDataFrame([], "qid long, id long")
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r.qid, r.question) for r in rows])

        def run(batches, shared=shared):
            automaton, owners = ahocorasick.Automaton(), {}
            for qid, text in shared.value:
                owners.setdefault(text, []).append(qid)
            for text, qids in owners.items():
                automaton.add_word(text, qids)
            automaton.make_automaton()
            least: dict[int, int] = {}
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for _, qids in automaton.iter(text.as_py() or ""):
                        for q in qids:
                            least[q] = min(i, least.get(q, i))
            if least:
                yield pa.RecordBatch.from_arrays([pa.array(least.keys(), pa.int64()), pa.array(least.values(), pa.int64())], names=["qid", "id"])

        out = out.unionByName(docs.where("id IS NOT NULL").select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "qid long, id long"))
    return out.groupBy("qid").agg(F.min("id").alias("id"))
