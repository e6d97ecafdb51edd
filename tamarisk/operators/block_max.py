"""BM25 top-k that leaves most postings unread: postings in blocks, with the largest impact of each.

The impact of a posting is what it adds to the score of a question that has the term once. A row of the
index holds the postings of one term in a range of 4,096 ids, the largest impact of each block of 64
ids in it, and the largest of all. The sum of a question's largest impacts bounds every score in a
range or block, so once k documents have scores, ranges and then blocks below the least of those
need not be read. The rows that are left give exact scores: the result is that of a full search. They
go once each to the task of their range, whatever number of questions asks for them, and only the k
best of a question leave it.

Ids that lie close together should be alike, such as chunks of one document; any ids give the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.words import spread
from ..sources.tables import write_bucketed
from .dense import best_of_each
from .lexical import K1, BM25Index, normed_postings, term_frequency, top

#: Ids of a block and of a range, as powers of two; ranges, and blocks, that give the first scores of a question.
BLOCK, RANGE, SEEDS = 6, 12, 8
#: Ranges of a term that share a join key; beyond, its rows are dealt out over several.
SALTED = 1024
#: What rounding may take off a bound.
SLACK = 1e-6
#: Scores of texts and questions that a task holds at a time.
CELLS = 1 << 20


@dataclass
class BlockMaxIndex:
    """rows (term, range, salt, top, tops [(block, top)], postings [(block, id, impact)]), bucketed by term and range; terms (term, salts); ``full``: the ranges that all documents would fill."""

    rows: DataFrame
    terms: DataFrame
    keep: Callable[[DataFrame], DataFrame]
    full: int

    @classmethod
    def build(cls, bm25: BM25Index, path: str, keep: Callable[[DataFrame], DataFrame], buckets: int | None = None) -> BlockMaxIndex:
        """Writes the index below ``path``; ``keep`` stores an intermediate table and reads it again. A posting list is cut by id, so no row has more than 4,096 of them."""
        buckets = buckets or int(bm25.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        terms = keep(bm25.postings.groupBy("term", F.shiftright("id", RANGE).alias("range")).agg(F.lit(1).alias("one")).groupBy("term").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts")))
        impact = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + F.col("norm"))
        posting, place = F.struct(F.shiftright("id", BLOCK).alias("block"), "id", impact.alias("impact")), F.shiftright("id", RANGE)
        weighed = normed_postings(bm25).join(bm25.idf, "term").join(terms, "term").select("term", place.alias("range"), F.pmod(place, F.col("salts")).cast("int").alias("salt"), posting.alias("posting"))
        placed = weighed.repartition(buckets, "term", "range")  # their lists are written where they are made
        rows = placed.groupBy("term", "range", "salt").agg(F.max("posting.impact").alias("top"), F.collect_list("posting").alias("postings"))
        rows = rows.select("term", "range", "salt", "top", _tops(F.col("postings")).alias("tops"), "postings")
        return cls(write_bucketed(rows, f"{path}/rows", ("term", "range"), buckets, dealt=True), terms, keep, 1 + (bm25.corpus.first().n >> RANGE))

    def _asked(self, questions: DataFrame, id_col: str, text: Column) -> DataFrame:
        asked = term_frequency(questions, id_col, text).select(F.col("id").alias("qid"), "term", F.col("tf").alias("qf"))
        return self.keep(asked.join(self.terms, "term"))

    def _ranges(self, asked: DataFrame) -> DataFrame:
        """(qid, range, bound)."""
        dealt = asked.select("qid", "term", "qf", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        return dealt.join(self.rows.select("term", "salt", "range", "top"), ["term", "salt"]).groupBy("qid", "range").agg(F.sum(F.col("qf") * F.col("top")).alias("bound"))

    def _blocks(self, asked: DataFrame, ranges: DataFrame) -> DataFrame:
        """(qid, range, block, bound) of the blocks of (qid, range)."""
        wanted = ranges.select("qid", "range").join(asked.select("qid", "term", "qf"), "qid")
        found = wanted.join(self.rows.select("term", "range", "tops"), ["term", "range"]).select("qid", "range", "qf", F.inline("tops"))
        return found.groupBy("qid", "range", "block").agg(F.sum(F.col("qf") * F.col("top")).alias("bound"))

    def _postings(self, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        """(qid, qf, id, impact) of the postings in (qid, range, block)."""
        wanted = blocks.groupBy("qid", "range").agg(F.collect_set("block").alias("blocks")).join(asked.select("qid", "term", "qf"), "qid")  # 64 blocks at most
        found = wanted.join(self.rows.select("term", "range", "postings"), ["term", "range"])
        some = F.filter("postings", lambda p: F.array_contains(F.col("blocks"), p["block"]))
        return found.select("qid", "qf", F.inline(some)).select("qid", "qf", "id", "impact")

    @staticmethod
    def _scores(postings: DataFrame) -> DataFrame:
        return postings.groupBy("qid", "id").agg(F.sum(F.col("qf") * F.col("impact")).alias("score"))

    def _alive(self, questions: DataFrame, id_col: str, text: Column, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The asked terms, (qid, range, block) of the blocks that have to be read, and (qid, floor): a score that k documents reach; no row if there are fewer."""
        asked = self._asked(questions, id_col, text)
        ranges = self.keep(self._ranges(asked))
        best = Window.partitionBy("qid").orderBy(F.desc("bound"), "range")
        first = ranges.withColumn("n", F.row_number().over(best)).where(F.col("n") <= SEEDS)
        nearest = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")
        seeds = self._blocks(asked, first).withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= SEEDS)
        kth = Window.partitionBy("qid").orderBy(F.desc("score"))
        scored = self._scores(self._postings(asked, seeds)).withColumn("n", F.row_number().over(kth)).where(F.col("n") <= k)
        floor = self.keep(scored.where(F.col("n") == k).select("qid", F.col("score").alias("floor")))
        reach = F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - SLACK
        alive = ranges.join(floor, "qid", "left").where(reach)
        return asked, self._blocks(asked, alive).join(floor, "qid", "left").where(reach).select("qid", "range", "block"), floor

    def survivors(self, questions: DataFrame, id_col: str, text: Column, k: int) -> tuple[DataFrame, DataFrame]:
        """(qid, qf, id, impact) of the postings that have to be read, and (qid, floor): a score that k documents reach, 0 if there are fewer."""
        asked, blocks, floor = self._alive(questions, id_col, text, k)
        return self._postings(asked, blocks), floor

    def top_k(self, questions: DataFrame, id_col: str, text: Column, k: int = 10, digits: int | None = None) -> DataFrame:
        """(qid, rank, id, score): the k best of each question, ties by id, scores rounded to ``digits`` (6 at most) if given. Questions without a term of the index have none."""
        asked, blocks, floor = self._alive(questions, id_col, text, k)
        alive = self.keep(blocks.groupBy("qid", "range").agg(F.collect_set("block").alias("blocks")))  # 64 blocks at most
        wanted = alive.select("qid", "range").join(asked.select("qid", "term"), "qid").select("term", "range").distinct()
        # ranges that hold few documents, where ids are far apart, go together
        task = F.pmod(F.xxhash64("range"), F.lit(self.full)).alias("task")
        read = self.rows.select("term", "range", "postings").join(wanted, ["term", "range"], "left_semi").select(task, "term", F.col("postings.id").alias("ids"), F.col("postings.impact").alias("impacts"))
        terms = asked.groupBy("qid").agg(F.collect_list("term").alias("terms"), F.collect_list("qf").alias("qfs"))
        asking = alive.join(terms, "qid").join(floor, "qid", "left").select(task, "qid", "blocks", "terms", "qfs", F.coalesce("floor", F.lit(0.0)).alias("floor"))
        score = lambda found, questions: _best(found, questions, k, digits)
        return top(read.groupBy("task").cogroup(asking.groupBy("task")).applyInArrow(score, "qid long, id long, score double"), k)


def _tops(postings: Column) -> Column:
    """The blocks of each list of postings, with the largest impact of each; grouping rows by block would make a group of nearly every posting."""

    def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in lists:
            block, impact = (batch.flatten().field(name).to_numpy() for name in ("block", "impact"))
            row = np.repeat(np.arange(len(batch)), batch.value_lengths().to_numpy())
            order = np.lexsort((block, row))
            row, block = row[order], block[order]
            first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(block, prepend=0) != 0))
            top = np.maximum.reduceat(impact[order], first) if len(first) else impact
            pairs = pa.StructArray.from_arrays([pa.array(block[first]), pa.array(top)], names=["block", "top"])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=len(batch))))), pa.int32()), pairs)

    return arrow_udf(run, "array<struct<block:long,top:double>>")(postings)


def _best(found: pa.Table, questions: pa.Table, k: int, digits: int | None) -> pa.Table:
    """(qid, id, score): the k best positive scores of each question among some ranges, by its blocks (task, qid, blocks, terms, qfs, floor) and the postings (task, term, ids, impacts)."""
    found, questions = (t.combine_chunks() for t in (found, questions))
    lists = lambda t, name: t[name].combine_chunks() if isinstance(t[name], pa.ChunkedArray) else t[name]
    ids, impact = lists(found, "ids"), lists(found, "impacts").flatten().to_numpy()
    start = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
    ids, text = np.unique(ids.flatten().to_numpy(), return_inverse=True)
    named = lists(found, "term").dictionary_encode()
    rows = np.argsort(named.indices.to_numpy(), kind="stable")  # a term has a row for each range
    of = np.concatenate(([0], np.cumsum(np.bincount(named.indices.to_numpy(), minlength=len(named.dictionary)))))
    blocks, place = np.unique(ids >> BLOCK, return_inverse=True)
    out, step = [], max(1, CELLS // max(1, len(ids)))
    for a in range(0, questions.num_rows, step):
        some = questions.slice(a, step)
        terms, qf = lists(some, "terms"), lists(some, "qfs").flatten().to_numpy()
        q = np.repeat(np.arange(len(some)), terms.value_lengths().to_numpy())
        term = pa.compute.index_in(terms.flatten(), value_set=named.dictionary)
        met = term.is_valid().to_numpy(zero_copy_only=False)
        term, q, qf = term.drop_null().to_numpy(), q[met], qf[met]
        row, owner = spread(of, term)
        at, line = spread(start, rows[row])
        owner = owner[line]
        cells = np.bincount(q[owner] * len(ids) + text[at], qf[owner] * impact[at], len(some) * len(ids)).reshape(len(some), -1)
        alive = np.zeros((len(some), len(blocks)), bool)
        own = lists(some, "blocks")
        asked = np.repeat(np.arange(len(some)), own.value_lengths().to_numpy())
        where = np.searchsorted(blocks, own := own.flatten().to_numpy())
        held = np.flatnonzero(where < len(blocks))
        held = held[blocks[where[held]] == own[held]]
        alive[asked[held], where[held]] = True
        reach = alive[:, place] & (cells >= lists(some, "floor").to_numpy()[:, None] - SLACK) & (cells > 0)
        q, t = np.nonzero(reach)
        score = cells[q, t]
        if digits is not None:
            score = np.floor(score * 10.0**digits + 0.5) / 10.0**digits
        kept = best_of_each(q, ids[t], score, k)
        kept = kept[score[kept] > 0]
        out.append(pa.table({"qid": lists(some, "qid").to_numpy()[q[kept]], "id": ids[t[kept]], "score": score[kept]}))
    return pa.concat_tables(out) if out else pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
