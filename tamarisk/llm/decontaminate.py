"""Benchmark decontamination by latent semantic retrieval.

Inverse document frequencies are counted over all documents, exactly for the words of the benchmark
and by hash buckets for the others. A distributed randomised SVD of the TF-IDF rows of benchmark
passages and of all documents gives a latent space; every window of every
document is folded into it, and the passages whose cosine with it reaches a threshold are
candidates. A bound on the cosine (the window's weight in benchmark vocabulary over its whole
weight) spares windows that cannot reach it. Windows are as long as short items, and long items are
cut into passages of about a window; exact copies are also looked for by a run of the item's words,
whatever their cosine. Candidates are verified by the longest common subsequence of words with the
item around the window, and paraphrases by the item's answer words.

The space keeps as many leading directions as leave no passage with less than ``ENERGY`` of its
squared length; what a passage lacks even then is added as a direction of its own. So the cosine of
an exact copy is at least the square root of ``ENERGY`` times the one without any projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks, discard, local_table, materialise, word_hashes

#: Buckets by which words outside the benchmark are counted. Words that share one seem more frequent than they are,
#: which shortens windows and raises cosines: no candidate is lost by it.
BUCKETS = 1 << 18
#: Windows are three segments of so many words; each segment starts one. The first number for which
#: a window holds an item of that many words is the item's.
SEGMENTS, SPAN = ((3, 1), (6, 2), (14, 5), (1 << 62, 16)), 3
#: Items of more words are cut into equal passages of no more.
PASSAGE = 96
#: Words of the run by which exact copies are looked for; all of a shorter item.
ANCHOR = 8
#: Share of a passage's squared length that the latent space keeps at least.
ENERGY = 0.85
#: What all documents weigh together against the benchmark's passages when the latent space is learned; each weighs the same.
FIT_WEIGHT = 0.25
#: Rows of a sparse matrix that a task multiplies at a time, tasks that multiply, and cells of a sum that is added up in one place.
SPARSE_ROWS, SPARSE_TASKS, STRIP = 1024, 128, 1 << 15
#: Windows whose latent vectors a task holds at a time.
WINDOWS = 1024


def corpus_words(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    """(place, n, words, counts): each document's words of the sorted ``vocabulary``, as places in it, and how often it has them (words, counts).

    Beside these rows, of each task: how many documents have a word of a hash bucket (place from 0), each word of the
    vocabulary (place below 0), and how many there are (place ``BUCKETS``). One pass over the texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        buckets, exact, n = np.zeros(BUCKETS, dtype=np.int64), np.zeros(len(known), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for a, b in chunks(batch.column(0), 1_000_000):
                hashes, _, words = word_hashes([t.as_py() or b"" for t in batch.column(0)[a:b]])
                if not len(hashes):
                    continue
                owner = np.repeat(np.arange(len(words)), words)
                buckets += np.bincount(_distinct(owner * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)) % BUCKETS, minlength=BUCKETS)
                if len(known):
                    place, inside = find(known, hashes)
                    keys, counts = np.unique(owner[inside] * len(known) + place[inside], return_counts=True)
                    document, place = np.divmod(keys, len(known))
                    exact += np.bincount(place, minlength=len(known))
                    sizes = np.bincount(document, minlength=len(words))
                    ends = pa.array(np.concatenate(([0], np.cumsum(sizes[sizes > 0]))), pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (place, counts)]
                    none = pa.nulls(len(lists[0]), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, *lists], names=["place", "n", "words", "counts"])
        if n:
            place = np.concatenate((np.flatnonzero(buckets), -1 - np.flatnonzero(exact), [BUCKETS]))
            none = pa.nulls(len(place), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate((buckets[buckets > 0], exact[exact > 0], [n]))), none, none], names=["place", "n", "words", "counts"])

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "place long, n long, words array<int>, counts array<int>")


def document_frequency(found: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents by hash bucket of the words they have, documents that have each word of the ``vocabulary``, and their number, from ``corpus_words``.

    Summed by the engine over the numbers of each task, so no task gathers them.
    """
    rows = found.where("place IS NOT NULL").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = rows["place"].to_numpy(), rows["n"].to_numpy()
    buckets, exact = np.zeros(BUCKETS, dtype=np.int64), np.zeros(len(vocabulary), dtype=np.int64)
    other = (place >= 0) & (place < BUCKETS)
    buckets[place[other]] = n[other]
    exact[-1 - place[place < 0]] = n[place < 0]
    return buckets, exact, int(n[place == BUCKETS].sum())


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def find(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in a sorted vocabulary of each word, and whether it is there."""
    place = np.searchsorted(vocabulary, hashes).clip(max=max(0, len(vocabulary) - 1))
    return place, vocabulary[place] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)


def sparse_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (at, value) that are lists: all places, all values, and the end of each row in them."""
    at, value = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
    return at, value, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))


def _times(q: np.ndarray, at: np.ndarray, value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, begin = np.zeros((len(ends), q.shape[1])), 0
    for k, end in enumerate(ends.tolist()):
        if end > begin:
            out[k] = value[begin:end] @ q[at[begin:end]]
        begin = end
    return out


def _gram(total: np.ndarray, q: np.ndarray, at: np.ndarray, value: np.ndarray, ends: np.ndarray) -> None:
    """Adds to ``total`` what rows make of ``q`` when the matrix and then its transpose are multiplied by it."""
    y = _times(q, at, value, ends)
    order = np.argsort(at, kind="stable")
    row, value, at = np.searchsorted(ends, order, side="right"), value[order], at[order]
    cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        total[at[a]] += value[a:b] @ y[row[a:b]]


def _moments(total: np.ndarray, q: np.ndarray, at: np.ndarray, value: np.ndarray, ends: np.ndarray) -> None:
    """Adds to ``total`` the products of the rows' coordinates in ``q``."""
    y = _times(q, at, value, ends)
    total += y.T @ y


def randomised_svd(rows: DataFrame, width: int, rank: int, oversample: int = 10, power: int = 1, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (width by rank) and singular values of a sparse matrix.

    ``rows`` has its rows as ``at array<int>, value array<double>``. Each pass multiplies by the
    matrix and its transpose on the executors; only width-by-rank blocks come to the driver, and
    from the last pass a square of the rank.
    """
    size = min(rank + oversample, width)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    context = rows.sparkSession.sparkContext

    def summed(q: np.ndarray, product, height: int) -> np.ndarray:
        shared = context.broadcast(q)

        def run(batches):
            total, any_row = np.zeros((height, shared.value.shape[1])), False
            for batch in batches:
                for k in range(0, batch.num_rows, SPARSE_ROWS):
                    at, value, ends = sparse_rows(batch.slice(k, SPARSE_ROWS))
                    if len(at):
                        product(total, shared.value, at, value, ends)
                        any_row = True
            if any_row:
                step = max(1, STRIP // total.shape[1])
                for i in range(0, len(total), step):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i : i + step].tobytes()], pa.binary())], names=["at", "sums"])

        def add(part: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(c.as_py()) for c in part["sums"])
            return pa.table({"at": part["at"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

        # a strip is added up from one piece of each task: their number is bounded, so that no task gathers more as rows grow
        parts = rows.select("at", "value").coalesce(SPARSE_TASKS).mapInArrow(run, "at int, sums binary").groupBy("at").applyInArrow(add, "at int, sums binary").collect()
        out = np.zeros((height, q.shape[1]))
        for r in parts:
            block = np.frombuffer(r.sums).reshape(-1, q.shape[1])
            out[r.at : r.at + len(block)] = block
        return out

    for _ in range(power):
        q = np.linalg.qr(summed(q, _gram, width))[0]
    values, vectors = np.linalg.eigh(summed(q, _moments, size))
    order = np.argsort(-values)[:rank]
    order = order[values[order] > 1e-9 * max(values.max(), 1e-300)]
    return q @ vectors[:, order], np.sqrt(values[order])


@dataclass
class Space:
    """Passages of benchmark items in a latent space."""

    segment: int  # words of a third of a window
    owners: np.ndarray  # the item of each passage
    offsets: np.ndarray  # the passage's first word in the item
    rows: np.ndarray  # by place in the block's vocabulary: the word's row in ``vectors``, or -1
    vectors: np.ndarray  # words by directions, weighted
    passages: np.ndarray  # passages by directions: unit vectors


@dataclass
class Block:
    """Benchmark items that one pass over the documents looks for."""

    ids: list
    words: list[np.ndarray]  # the items' word hashes, in order
    answers: list[np.ndarray]  # hashes of the words an answer check looks for
    vocabulary: np.ndarray  # sorted word hashes of all items
    weight: np.ndarray  # and their idf
    buckets: np.ndarray  # idf of other words by bucket
    spaces: list[Space]
    anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by number of words: sorted hashes of the items' runs, items, places in the items


def item_blocks(items: DataFrame, most: int) -> Iterator[list]:
    """Lists of (row, words) of items (item_id, text, answer) with about ``most`` passages, never dividing an item."""
    held, n = [], 0
    for r in items.where("text IS NOT NULL").toLocalIterator():
        if len(words := word_hashes([r.text.encode()])[0]):
            held.append((r, words))
            n += -(-len(words) // PASSAGE)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def build_block(docs: DataFrame, text_col: str, items: list, rank: int, answer_words: int) -> Block:
    vocabulary = np.unique(np.concatenate([w for _, w in items]))
    found = materialise(corpus_words(docs, text_col, vocabulary), "words")
    buckets, exact, n = document_frequency(found, vocabulary)
    weight, other = (np.log((1 + n) / (1 + c)) + 0.01 for c in (exact, buckets))
    weigh = lambda w: weight[np.searchsorted(vocabulary, w)]
    answers, passages, runs = [], {}, {}
    for i, (r, w) in enumerate(items):
        if r.answer:
            answers.append(np.unique(word_hashes([r.answer.encode()])[0]))
        else:  # without an answer, the item's rarest words that a document has stand for it
            own = np.unique(w)
            own = own[exact[np.searchsorted(vocabulary, own)] > 0]
            answers.append(own[np.argsort(-weigh(own), kind="stable")[:answer_words]])
        segment = next(k for most, k in SEGMENTS if len(w) <= most)
        cuts = np.linspace(0, len(w), -(-len(w) // PASSAGE) + 1).astype(int).tolist()
        passages.setdefault(segment, []).extend((i, a, w[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
        size = min(ANCHOR, len(w))
        at = int(np.convolve(weigh(w), np.ones(size), "valid").argmax())
        runs.setdefault(size, []).append((int(run_hashes(w[at : at + size], size)[0]), i, at))
    anchors = {size: tuple(np.array(x, t) for x, t in zip(zip(*sorted(own), strict=True), (np.uint64, np.int64, np.int64), strict=True)) for size, own in runs.items()}
    corpus = found.where("words IS NOT NULL").select("words", "counts")
    spaces = [build_space(corpus, segment, some[k : k + rank], vocabulary, weight) for segment, some in sorted(passages.items()) for k in range(0, len(some), rank)]
    discard(found)
    return Block([r.item_id for r, _ in items], [w for _, w in items], answers, vocabulary, weight, other.astype(np.float32), spaces, anchors)


def build_space(corpus: DataFrame, segment: int, passages: list, vocabulary: np.ndarray, weight: np.ndarray) -> Space:
    """Fits passages (item, first word, words) together with all documents, as ``corpus`` (words, counts) has them; a document's row has length one."""
    spark = corpus.sparkSession
    places = [np.searchsorted(vocabulary, w) for _, _, w in passages]
    used = np.unique(np.concatenate(places))
    rows = np.full(len(vocabulary), -1, dtype=np.int32)
    rows[used] = np.arange(len(used))
    dense = np.zeros((len(passages), len(used)))
    for k, p in enumerate(places):
        np.add.at(dense[k], rows[p], weight[p])
    shared = spark.sparkContext.broadcast((rows, weight))

    def unit(batches):
        rows, weight = shared.value
        for batch in batches:
            words, counts, ends = sparse_rows(batch)
            owner, inside = np.searchsorted(ends, np.arange(len(words)), side="right"), rows[words] >= 0
            owner, words, value = owner[inside], words[inside], (counts * weight[words])[inside]
            length = np.sqrt(np.bincount(owner, value * value, minlength=len(ends)))
            sizes = np.bincount(owner, minlength=len(ends))
            ends = pa.array(np.concatenate(([0], np.cumsum(sizes[sizes > 0]))), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x)) for x in (rows[words], value / length[owner])], names=["at", "value"])

    # written, so that a task that multiplies needs one Python worker and not another for its rows, and each pass reads them as they are
    documents = materialise(corpus.mapInArrow(unit, "at array<int>, value array<double>"), "unit")
    scale = np.sqrt(FIT_WEIGHT * (dense**2).sum() / max(1, corpus.count()))  # passages are divided by what documents would be multiplied by
    own = [(np.flatnonzero(d).tolist(), (d[d != 0] / scale).tolist()) for d in dense]
    v, _ = randomised_svd(local_table(spark, own, "at array<int>, value array<double>").unionByName(documents), len(used), len(passages))
    discard(documents)
    v = keep_directions(v, dense)
    latent = dense @ v
    owners, offsets = (np.array([x[k] for x in passages]) for k in (0, 1))
    unit_length = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return Space(segment, owners, offsets, rows, (weight[used][:, None] * v).astype(np.float32), unit_length.astype(np.float32))


def keep_directions(v: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """The fewest leading directions that leave no passage with less than ``ENERGY`` of its squared length, or all and what passages then lack."""
    whole = np.maximum((passages**2).sum(axis=1), 1e-300)
    kept = np.cumsum((passages @ v) ** 2, axis=1) / whole[:, None]
    enough = np.flatnonzero((kept >= ENERGY).all(axis=0))
    if len(enough):
        return v[:, : enough[0] + 1]
    lacking = kept[:, -1] < ENERGY if kept.shape[1] else np.ones(len(whole), bool)
    rest = passages[lacking] - passages[lacking] @ v @ v.T
    return np.column_stack((v, np.linalg.qr(rest.T)[0]))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    total = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(total)]
    return total


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for k, c in enumerate(a.tolist()):
        where[c] = where.get(c, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for c in b.tolist():
        if m := where.get(c):
            x = row & m
            row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


def near_windows(hashes: np.ndarray, counts: np.ndarray, block: Block, least: float):
    """(text, first word in it, space, passage, cosine) of each window of a batch of texts that is near a passage."""
    place, inside = find(block.vocabulary, hashes)
    squares = np.where(inside, block.weight[place], block.buckets[(hashes & np.uint64(BUCKETS - 1)).astype(np.intp)]) ** 2
    starts = np.cumsum(counts) - counts
    for segment in sorted({s.segment for s in block.spaces}):
        n = -(-counts // segment)
        text = np.repeat(np.arange(len(counts)), n)
        cuts = np.repeat(starts, n) + segment * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        ends = np.append(cuts[1:], len(hashes))

        def spanned(x, text=text):
            out = x.copy()
            for k in range(1, SPAN):
                out[:-k] += np.where(text[k:] == text[:-k], x[k:], 0)
            return out

        total = spanned(np.add.reduceat(squares, cuts))
        for space in (s for s in block.spaces if s.segment == segment):
            row = np.where(inside, space.rows[place], -1)
            live = np.flatnonzero(spanned(np.add.reduceat(np.where(row >= 0, squares, 0), cuts)) >= least * least * np.maximum(total, 1e-12))
            for a in range(0, len(live), WINDOWS):
                some = live[a : a + WINDOWS]
                wanted = np.unique(np.concatenate([some + k for k in range(SPAN)]).clip(max=len(text) - 1))
                sums = _segment_sums(row, cuts[wanted], ends[wanted], space.vectors)
                at = np.searchsorted(wanted, some)
                latent = sums[at]
                for k in range(1, SPAN):
                    ok = (some + k < len(text)) & (text[np.minimum(some + k, len(text) - 1)] == text[some])
                    latent[ok] += sums[np.searchsorted(wanted, some[ok] + k)]
                cosine = (latent @ space.passages.T) / np.sqrt(np.maximum(total[some], 1e-12))[:, None]
                for k, p in zip(*np.nonzero(cosine >= least), strict=True):
                    w = some[k]
                    yield int(text[w]), int(cuts[w] - starts[text[w]]), space, int(p), float(cosine[k, p])


def _segment_sums(row: np.ndarray, first: np.ndarray, end: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The sum of the vectors of each segment's words."""
    size = end - first
    words = row[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)]
    n = np.bincount(np.repeat(np.arange(len(size)), size)[words >= 0], minlength=len(size))
    sums = np.zeros((len(size), vectors.shape[1]), dtype=np.float32)
    full = n > 0
    if full.any():
        sums[full] = np.add.reduceat(vectors[words[words >= 0]], (np.cumsum(n) - n)[full], axis=0)
    return sums


def copies(hashes: np.ndarray, counts: np.ndarray, block: Block):
    """(text, item, first word) of each place in a batch of texts where an item's anchor stands, the item beginning before it."""
    ends = np.cumsum(counts)
    for size, (runs, items, offsets) in block.anchors.items():
        own = run_hashes(hashes, size)
        hit = np.flatnonzero(runs[np.minimum(np.searchsorted(runs, own), len(runs) - 1)] == own)
        for at in hit.tolist():
            text = int(np.searchsorted(ends, at, side="right"))
            first = at - int(ends[text] - counts[text])
            if at + size <= ends[text]:
                for k in range(*(int(np.searchsorted(runs, own[at], side=side)) for side in ("left", "right"))):
                    if first >= offsets[k]:
                        yield text, int(items[k]), first - int(offsets[k])


@dataclass
class Rules:
    """When a candidate counts as found: cosine, and shares of the item's words in common subsequence and of its answer words."""

    least: float = 0.35
    verbatim: float = 0.75
    paraphrase: float = 0.5
    answer: float = 0.5


def check_texts(hashes: np.ndarray, counts: np.ndarray, block: Block, rules: Rules) -> dict[int, dict]:
    """By text of a batch: item: (cosine, share of its words in common subsequence, share of its answer words) for each item found.

    An exact copy that no window shows has cosine 1.
    """
    found: dict[int, dict] = {}
    starts = np.cumsum(counts) - counts

    def check(text: int, i: int, first: int, to: int, cosine: float) -> None:
        item, span = block.words[i], hashes[starts[text] + max(0, first) : starts[text] + min(to, counts[text])]
        there = set(span.tolist())
        if sum(map(there.__contains__, item.tolist())) < min(rules.verbatim, rules.paraphrase) * len(item):
            return  # a common subsequence is no longer than the words in common
        share = common_subsequence(item, span) / len(item)
        known = np.isin(block.answers[i], span).mean() if len(block.answers[i]) else 0.0
        if share >= rules.verbatim or (share >= rules.paraphrase and known >= rules.answer):
            value, own = (min(1.0, cosine), share, float(known)), found.setdefault(text, {})
            if value[1:] > own.get(i, (0, 0, 0))[1:] or i not in own:
                own[i] = value

    if not len(hashes):
        return found
    seen = set()
    for text, start, space, p, cosine in near_windows(hashes, counts, block, rules.least):
        i, window = int(space.owners[p]), SPAN * space.segment
        n, first = len(block.words[i]), start - int(space.offsets[p])  # where the item would begin
        if n <= PASSAGE:
            check(text, i, first - n, first + window + n, cosine)
        elif (text, i, first // (n // 4)) not in seen:  # its passages mostly show one place again and again
            seen.add((text, i, first // (n // 4)))
            first -= first % (n // 4)
            check(text, i, first - n, first + n // 4 + window + n, cosine)
    for text, i, first in copies(hashes, counts, block):
        item = block.words[i]
        if found.get(text, {}).get(i, (0, 0))[1] < 1 and np.array_equal(hashes[starts[text] + first : starts[text] + min(first + len(item), counts[text])], item):
            check(text, i, first, first + len(item), 1.0)
    return found


def _found(texts: pa.Array, block: Block, rules: Rules) -> Iterator[tuple[int, dict]]:
    """(row, items found) of the texts of a batch in which an item is found."""
    for a, b in chunks(texts, 1_000_000):
        hashes, _, words = word_hashes([t.as_py() or b"" for t in texts[a:b]])
        for text, items in sorted(check_texts(hashes, words, block, rules).items()):
            yield a + text, items


def _blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, rank: int, answer_words: int, block_items: int) -> Iterator[Block]:
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"),
        (F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")).alias("answer"),
    )
    for held in item_blocks(items, block_items):
        yield build_block(docs, text_col, held, rank, answer_words)


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), rank: int = 256, answer_words: int = 8, block_items: int = 2000,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) of every document and benchmark item found in it.

    ``benchmark``: item_id, text and, if there is one, answer. Items are taken in blocks of
    ``block_items`` passages, or one item with more, each against all documents, and within a
    block in latent spaces of at most ``rank`` passages. Null and empty texts and items match
    nothing; a null id is kept; repeated rows are repeated; other columns are ignored; without
    documents or items the result is empty.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for block in _blocks(docs, benchmark, text_col, rank, answer_words, block_items):
        shared = spark.sparkContext.broadcast(block)  # block_items passages, or one item with more

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                made = [(batch.column(0)[k].as_py(), block.ids[i], *v) for k, items in _found(batch.column(1), block, rules) for i, v in sorted(items.items())]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), *[pa.float64()] * 3), strict=True)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return local_table(spark, [], schema) if out is None else out


def holds_item(spark, block: Block, rules: Rules, text: Column) -> Column:
    """Whether an item of the block is found in a text."""
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            held = np.zeros(len(texts), dtype=bool)
            for k, _ in _found(texts, shared.value, rules):
                held[k] = True
            yield pa.array(held)

    return arrow_udf(run, "boolean")(text.cast("binary"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), rank: int = 256, answer_words: int = 8, block_items: int = 2000, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in which an item of the benchmark is found. Every row is decided by its own text, so nothing is shuffled."""
    out = docs
    for block in _blocks(docs, benchmark, text_col, rank, answer_words, block_items):
        out = out.where(~holds_item(docs.sparkSession, block, rules, F.col(text_col)))
    return out
