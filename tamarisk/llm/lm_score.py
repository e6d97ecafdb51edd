"""Language-model scoring by deleted interpolation of n-gram estimates.

The whole corpus is counted and every n-gram of every document looked up, without a row for each
token. Documents are cut into blocks of a few megabytes; a block asks for the totals of its
distinct n-grams, already counted within the block, with one packed row for each range of hashes;
a range adds up what all blocks have and answers with packed totals. Words are told apart by
64-bit hashes; longer n-grams by 40 bits below those that give the range, and as ranges grow in
number with the corpus, a range's n-grams do not, which bounds false matches at about one in a
million. Interpolation weights are learned by expectation-maximisation for each context-frequency
bucket from deleted counts: each training token is predicted from the counts of all others.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import chunks, materialise, mix64, word_hashes

END, START = np.uint64(0x9D5C1A7B3E2F4861), np.uint64(0x3C6EF372FE94F82B)
BUCKETS, GRID = 20, 4
KEY_BYTES = {1: 8}
LONG_KEY_BYTES = 5


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, all first bytes first: equal high bytes then compress well."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T
    return out.view(np.uint64).ravel()


def tokenise(docs: DataFrame, block_bytes: int, id_col: str, text_col: str, train_col: str) -> DataFrame:
    """Blocks of documents: ids, training flags, numbers of tokens, distinct word hashes, and word places by token."""

    def run(batches):
        task, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for a, b in chunks(batch.column(1), block_bytes):
                texts = [t.as_py() or b"" for t in batch.column(1)[a:b]]
                hashes, _, words = word_hashes(texts)
                ends = np.cumsum(words)
                tokens = np.insert(hashes, ends, END)
                distinct, place, n = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")  # common words get small numbers
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                made += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task + made], pa.int64()),
                        pa.array([batch.column(0)[a:b].to_pylist()], pa.list_(pa.int64())),
                        pa.array([batch.column(2)[a:b].to_pylist()], pa.list_(pa.bool_())),
                        pa.array([(words + 1).astype(np.int32).tobytes()], pa.binary()),
                        pa.array([distinct[order].tobytes()], pa.binary()),
                        pa.array([_planes(rank[place], 4)], pa.binary()),
                    ],
                    names=["block", "ids", "train", "sizes", "words", "places"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(train_col).alias("train"))
    return rows.mapInArrow(run, "block long, ids array<long>, train array<boolean>, sizes binary, words binary, places binary")


def _levels(words: bytes, places: bytes, sizes: bytes, order: int):
    """For each n up to ``order``: the distinct n-gram hashes of a block, sorted, and each token's place in them."""
    base = np.frombuffer(words, dtype=np.uint64)[_from_planes(places, 4).astype(np.intp)]
    n = np.frombuffer(sizes, dtype=np.int32)
    first = np.cumsum(n) - n
    grams = base
    yield np.unique(grams, return_inverse=True)
    for _ in range(2, order + 1):
        before = np.concatenate((np.array([START]), grams[:-1]))
        before[first] = START
        grams = mix64(before * np.uint64(0x9E3779B97F4A7C15) + base)
        yield np.unique(grams, return_inverse=True)


def _requests(blocks: DataFrame, bits: int, order: int) -> DataFrame:
    def run(batches):
        ranges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["sizes"], dtype=np.int32)
                train = np.repeat(np.array(row["train"], dtype=bool), n)
                for level, (keys, place) in enumerate(_levels(row["words"], row["places"], row["sizes"], order), 1):
                    counts = np.bincount(place[train], minlength=len(keys))
                    cut = np.concatenate((np.searchsorted(keys, ranges), [len(keys)]))
                    if level > 1:
                        keys = (keys >> np.uint64(24 - bits)) & np.uint64((1 << 8 * LONG_KEY_BYTES) - 1)
                    width = KEY_BYTES.get(level, LONG_KEY_BYTES)
                    parts = [p for p in range(1 << bits) if cut[p + 1] > cut[p]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(parts, pa.int32()),
                            pa.array([row["block"]] * len(parts), pa.int64()),
                            pa.array([level] * len(parts), pa.int32()),
                            pa.array([_planes(np.diff(keys[cut[p] : cut[p + 1]], prepend=np.uint64(0)), width) for p in parts], pa.binary()),
                            pa.array([_planes(counts[cut[p] : cut[p + 1]], 4) for p in parts], pa.binary()),
                        ],
                        names=["part", "block", "level", "keys", "counts"],
                    )

    return blocks.mapInArrow(run, "part int, block long, level int, keys binary, counts binary")


def _answers(requests: DataFrame, bits: int) -> DataFrame:
    """Packed totals for each request, and for each range (block -1) the training tokens and distinct words it has."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        part, level, block = (t.column(c).to_numpy() for c in ("part", "level", "block"))
        keys, counts = t.column("keys"), t.column("counts")
        for p, n in sorted(set(zip(part.tolist(), level.tolist(), strict=True))):
            rows = np.flatnonzero((part == p) & (level == n))
            asked = [np.cumsum(_from_planes(keys[int(r)].as_py(), KEY_BYTES.get(n, LONG_KEY_BYTES)), dtype=np.uint64) for r in rows]
            distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
            n_each = np.concatenate([_from_planes(counts[int(r)].as_py(), 4) for r in rows]).astype(np.float64)
            total = np.bincount(place, weights=n_each, minlength=len(distinct)).astype(np.int64)
            sizes = np.cumsum([len(a) for a in asked])
            packed = [_planes(total[x], 5) for x in np.split(place, sizes[:-1])]
            yield _answer([int(block[r]) for r in rows], n, p, packed, 0, 0)
            if n == 1:
                yield _answer([-1], n, p, [b""], int(total.sum()), int((total > 0).sum()))

    def _answer(blocks, level, part, packed, tokens, distinct):
        k = len(blocks)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip((blocks, [level] * k, [part] * k, packed, [tokens] * k, [distinct] * k), schema, strict=True)], schema=schema
        )

    schema = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("totals", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64())])
    return requests.repartition(1 << bits, "part").mapInArrow(run, "block long, level int, part int, totals binary, tokens long, distinct long")


def _by_block(blocks: DataFrame, answers: DataFrame, make, schema: str) -> DataFrame:
    """``make`` applied to each block with its n-grams' training totals, by level, in the order of the sorted hashes.

    The blocks are bucketed by block, so only the answers are shuffled.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        for level, _, k in sorted(zip(right["level"].to_pylist(), right["part"].to_pylist(), range(right.num_rows), strict=True)):
            found.setdefault(level, []).append(_from_planes(right["totals"][k].as_py(), 5))
        totals = [np.concatenate(found[n]) for n in sorted(found)]
        return pa.Table.from_batches([make(row, totals) for row in left.to_pylist()])

    return blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(run, schema)


def _counts(row: dict, found: list, order: int):
    """For each token and n: the total of its n-gram; and of each context (for n = 2, of the word before)."""
    n = np.frombuffer(row["sizes"], dtype=np.int32)
    first = np.cumsum(n) - n
    totals = []
    for total, (_, place) in zip(found, _levels(row["words"], row["places"], row["sizes"], order), strict=True):
        totals.append(total.astype(np.float64)[place])
    return n, first, totals


def _contexts(totals: list, first: np.ndarray, documents: int) -> list:
    """The count of the context of each token's n-gram, n from 2; a document's start is a context that each one has."""
    out = []
    for t in totals[:-1]:
        c = np.concatenate(([0.0], t[:-1]))
        c[first] = documents
        out.append(c)
    return out


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count < 1, 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)))


def _histogram(blocks: DataFrame, answers: DataFrame, order: int, tokens: int, documents: int) -> DataFrame:
    """Training tokens by context bucket and by deleted estimate of each order (logarithms on a grid)."""

    def grid(p):
        return np.where(p > 0, np.round(GRID * np.log(np.maximum(p, 1e-300))), 1).astype(np.int64)  # 1: no estimate

    def make(row: dict, found: list) -> pa.RecordBatch:
        n, first, totals = _counts(row, found, order)
        train = np.repeat(np.array(row["train"], dtype=bool), n)
        contexts = [(c - 1)[train] for c in _contexts(totals, first, documents)]
        totals = [(t - 1)[train] for t in totals]
        cells = [_bucket(contexts[0]) if contexts else np.zeros(len(totals[0]), np.int64), grid(totals[0] / max(1, tokens - 1))]
        cells += [grid(np.where(c > 0, t / np.maximum(c, 1), 0)) for t, c in zip(totals[1:], contexts, strict=True)]
        code = np.zeros(len(totals[0]), dtype=np.int64)  # a cell as one number: estimates are -4096 to 1
        for c in cells:
            code = code * 8192 + (c + 4096)
        _, at, size = np.unique(code, return_index=True, return_counts=True)
        found_cells = np.stack([c[at] for c in cells], axis=1).tolist()
        return pa.RecordBatch.from_arrays([pa.array(found_cells, pa.list_(pa.int64())), pa.array(size, pa.int64())], names=["cell", "n"])

    return _by_block(blocks, answers, make, "cell array<long>, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def fit_weights(cells: np.ndarray, n: np.ndarray, order: int, vocabulary: int, rounds: int = 100) -> np.ndarray:
    """Mixture weights (buckets by orders 0 to ``order``) by expectation-maximisation on deleted counts.

    A bucket without training tokens gives its weight to order 1, and to order 0 as much as all buckets do together.
    """
    weights = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    if not len(n):
        return np.tile(np.eye(order + 1)[0], (BUCKETS, 1))
    p = np.where(cells[:, 1:] == 1, 0.0, np.exp(cells[:, 1:] / GRID))
    p = np.column_stack((np.full(len(n), 1.0 / (vocabulary + 1)), p))
    bucket = cells[:, 0]
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(order + 1)], axis=1)
        total = sums.sum(axis=1, keepdims=True)
        pooled = sums.sum(axis=0)
        rest = np.zeros(order + 1)
        rest[:2] = pooled[0] / pooled.sum(), 1 - pooled[0] / pooled.sum()
        weights = np.where(total > 0, sums / np.maximum(total, 1e-300), rest)
    return np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum(axis=1, keepdims=True)


def _scores(blocks: DataFrame, answers: DataFrame, order: int, tokens: int, distinct: int, documents: int, weights: np.ndarray) -> DataFrame:
    def make(row: dict, found: list) -> pa.RecordBatch:
        n, first, totals = _counts(row, found, order)
        contexts = _contexts(totals, first, documents)
        w = weights[_bucket(contexts[0]) if contexts else np.zeros(len(totals[0]), np.int64)]
        p = w[:, 0] / (distinct + 1) + w[:, 1] * totals[0] / max(1, tokens)
        for k, (t, c) in enumerate(zip(totals[1:], contexts, strict=True), 2):
            p += w[:, k] * np.where(c > 0, t / np.maximum(c, 1), 0)
        base = np.log10((totals[0] + 0.5) / (tokens + 0.5 * (distinct + 1)))
        known = (totals[0] > 0).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(row["ids"], pa.int64()),
                pa.array(n.astype(np.int64)),
                pa.array(np.add.reduceat(known, first)),
                pa.array(np.full(len(n), tokens, dtype=np.int64)),
                pa.array(np.add.reduceat(base, first)),
                pa.array(np.add.reduceat(np.log10(p), first)),
            ],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _by_block(blocks, answers, make, schema)


def lm_scores(docs: DataFrame, train, order: int = 2, block_bytes: int = 2_500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every row's whole text by an n-gram model of the rows for which ``train`` holds.

    Result: doc_id, n_tokens (words and one end), n_known (tokens that the training rows have),
    train_tokens, base_score (add-half unigram) and score (log10 probability by the mixture). Null
    text counts as empty, which is one end token. Null ids and repeated rows are kept; a null
    ``train`` is not training; other columns are ignored; an empty table gives an empty result.
    Without training rows every score is zero.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    name = f"lm_blocks_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tokenise(marked, block_bytes, "id", "text", "train").write.format("parquet").bucketBy(buckets, "block").saveAsTable(name)
    blocks = spark.table(name)
    size = blocks.agg(F.count("*").alias("n"), F.sum(F.size(F.filter("train", lambda x: x))).alias("docs")).first()
    bits = min(20, max(1, (max(buckets, size["n"]) - 1).bit_length()))
    answers = materialise(_answers(_requests(blocks, bits, order), bits), "answers")
    found = answers.where("block = -1").agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    tokens, distinct, documents = found["n"] or 0, found["v"] or 0, size["docs"] or 0
    cells = _histogram(blocks, answers, order, tokens, documents).collect()  # buckets by grid points: bounded
    cells.sort(key=lambda r: tuple(r.cell))
    weights = fit_weights(np.array([r.cell for r in cells], dtype=np.int64).reshape(len(cells), order + 1), np.array([r.n for r in cells], dtype=float), order, distinct)
    return _scores(blocks, answers, order, tokens, distinct, documents, weights)
