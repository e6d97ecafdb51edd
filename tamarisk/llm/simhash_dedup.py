"""SimHash near-dedup by a binary trie self-join.

Only distinct fingerprints are joined. Two fingerprints within the error budget agree on at least
one of ``budget + 1`` bit blocks, so each fingerprint enters that many tries, each with a different
block on top (or ten, with two blocks of five on top, where there are very many fingerprints); in each trie the subtrees below the common block are joined with
themselves. Node pairs are traversed together, level by level, accumulating differing bits; a pair
is dropped once its errors exceed the budget, or once both of its subtrees are known to lie in
one component. A task returns a star for each of its components, never all pairs.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import chunks, discard, fresh, materialise
from .components import connected_components, merge

BITS = 64
#: Distinct fingerprints below one block of bits up to which tries with one block on top are used; beyond, those with two blocks of five.
SUBTREE = 4096
#: Rows that one task joins, about.
TASK_ROWS = 2_000_000


def _lanes() -> np.ndarray:
    """For each byte: its 8 bits as the 8 bytes of a 64-bit word, lowest bit in the lowest byte."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return (bits.astype(np.uint64) << (8 * np.arange(8)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)


LANES = _lanes()
#: The lowest bit of every lane; and a factor that brings those bits together in the top byte.
LANE, GATHER = np.uint64(0x0101010101010101), np.uint64(0x0102040810204080)


def majority(hashes: np.ndarray, counts: np.ndarray, width: int = 8) -> np.ndarray:
    """For each run of ``counts`` hashes: which of their lowest ``width`` bytes' bits are set in over half of them. An empty run gives zero.

    Bits are counted eight at a time in byte lanes over stretches of at most 255 hashes, whose
    sums are then added up, so no array of 64 columns per hash is made. The lanes of a run of up to
    127 hashes are compared with its half all at once.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    pieces = -(-n // 255)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(starts, pieces) + 255 * within
    first = np.cumsum(pieces) - pieces
    few = n <= 127
    least = (127 - n[few] // 2).astype(np.uint64) * LANE  # what lifts a lane's top bit if it has over half
    rest = np.repeat(~few, pieces)
    more, n_more = (np.cumsum(pieces[~few]) - pieces[~few]), n[~few]
    part = np.zeros(len(full), dtype=np.uint64)
    for byte in range(width):
        sums = np.add.reduceat(LANES[((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.intp)], cuts)
        part[few] = ((((sums[first[few]] + least) >> np.uint64(7)) & LANE) * GATHER) >> np.uint64(56)
        if len(more):
            long, found = sums[rest], np.zeros(len(more), dtype=np.uint64)
            for bit in range(8):
                ones = np.add.reduceat(((long >> np.uint64(8 * bit)) & np.uint64(255)).astype(np.int64), more)
                found |= (2 * ones > n_more).astype(np.uint64) << np.uint64(bit)
            part[~few] = found
        out[full] |= part << np.uint64(8 * byte)
    return out


def shingle_hashes(text: bytes, width: int, seed: int) -> tuple[bytes, int]:
    """Big-endian XXH64 digests of the word shingles of a text, and their number."""
    words = text.lower().split()
    if len(words) > width:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        return b"".join(map(xxh64_digest, shingles, repeat(seed))), len(words) - width + 1
    return (xxh64_digest(b" ".join(words), seed), 1) if words else (b"", 0)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and SimHash (a signed long) of every row's whole text; null text counts as empty."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            found = [np.empty(0, np.uint64)]
            for a, b in chunks(texts, 2_000_000):
                made = [shingle_hashes(t.as_py() or b"", width, seed) for t in texts[a:b]]
                hashes = np.frombuffer(b"".join(x for x, _ in made), dtype=">u8").astype(np.uint64)
                found.append(majority(hashes, np.array([n for _, n in made], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def tries(count: int, budget: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each trie: the order of the fingerprint's bit ranges (start, size) from the top, and how many bits of it a subtree shares.

    Two fingerprints within ``budget`` bits agree on one of ``budget + 1`` blocks, and on two of
    ``budget + 2``. The more fingerprints, the longer the shared part, so that subtrees stay small;
    either way all pairs within budget are found.
    """
    shared = 1 if count <= SUBTREE << (BITS // (budget + 1)) else 2
    cuts = [BITS * k // (budget + shared) for k in range(budget + shared + 1)]
    blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    made = []
    for top in combinations(range(len(blocks)), shared):
        order = [blocks[k] for k in (*top, *(k for k in range(len(blocks)) if k not in top))]
        made.append((order, sum(size for _, size in order[:shared])))
    return made


def _turned(fps: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their bit ranges in the given order; ranges are counted from the lowest bit."""
    out = np.zeros_like(fps)
    for start, size in order:
        out = ((out << np.uint64(size)) if size < BITS else out) | ((fps >> np.uint64(start)) & np.uint64((1 << size) - 1))
    return out


def _key(order: list[tuple[int, int]], top: int, turn: int):
    """The shared part of a fingerprint and its trie, as one number."""
    key, left = F.lit(turn << top).cast("long"), top
    for start, size in order:
        if not left:
            break
        left -= size
        key = key + F.shiftleft(F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << size) - 1)), left)
    return key


def trie_components(fps: np.ndarray, side: np.ndarray | None, budget: int, top: int, step: int = 200_000) -> np.ndarray:
    """Component labels (positions) of sorted fingerprints, linking those that share the first ``top`` bits
    and differ in at most ``budget`` of the others.

    With ``side`` (0 or 1) only links between the two sides are looked for.
    """
    n = len(fps)
    label = np.arange(n)
    runs = np.flatnonzero(np.concatenate(([True], (fps[1:] ^ fps[:-1]) >> np.uint64(BITS - top) != 0))) if n else np.empty(0, int)
    ends = np.concatenate((runs[1:], [n]))
    many = ends - runs > 1
    s, e = runs[many], ends[many]
    stack = [(top, s, e, s, e, np.zeros(len(s), np.int8))]
    while stack:
        depth, s, e, t, f, errors = stack.pop()
        if len(s) > step:
            stack.append((depth, s[step:], e[step:], t[step:], f[step:], errors[step:]))
            s, e, t, f, errors = s[:step], e[:step], t[:step], f[:step], errors[:step]
        change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        same = (change[s] == change[e - 1]) & (change[t] == change[f - 1]) & (label[s] == label[t])
        own = s == t
        live = ~same & ~(own & (e - s < 2))
        s, e, t, f, errors, own = s[live], e[live], t[live], f[live], errors[live], own[live]
        if not len(s):
            continue
        small = (e - s) * (f - t) <= 16 if depth < BITS else np.ones(len(s), bool)
        if small.any():
            p, q = s[small], t[small]
            rows, cols = (e - s)[small], (f - t)[small]
            size = rows * cols
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            a = np.repeat(p, size) + k // np.repeat(cols, size)
            b = np.repeat(q, size) + k % np.repeat(cols, size)
            near = np.bitwise_count(fps[a] ^ fps[b]) <= budget
            near &= a != b
            if side is not None:
                near &= side[a] != side[b]
            label = merge(label, a[near], b[near])
            s, e, t, f, errors, own = (x[~small] for x in (s, e, t, f, errors, own))
        if not len(s):
            continue
        # the first position in each subtree whose next bit is set
        bit = (fps >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
        zeros = np.concatenate(([0], np.cumsum(bit == 0)))
        m, g = s + zeros[e] - zeros[s], t + zeros[f] - zeros[t]
        pairs = [(s, m, t, g, errors, None), (m, e, g, f, errors, None), (s, m, g, f, errors + 1, None), (m, e, t, g, errors + 1, ~own)]
        parts = []
        for s1, e1, t1, f1, err, only in pairs:
            ok = (e1 > s1) & (f1 > t1) & (err <= budget)
            ok = ok if only is None else ok & only
            parts.append((s1[ok], e1[ok], t1[ok], f1[ok], err[ok].astype(np.int8)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    return label


def near_links(nodes: DataFrame, budget: int = 3, limit: int = 8192, plan: list | None = None) -> DataFrame:
    """Links (a, b) that join distinct fingerprints (fp) into their components; ``plan``: the tries, if not those for their number.

    A subtree with more than ``limit`` fingerprints is dealt out as pairs of slices of at most about
    that many, so that no task gathers it whole; slices are joined within themselves and pairwise.
    """
    count = nodes.count()
    plan = plan or tries(count, budget)
    turned = nodes.select("fp", F.posexplode(F.array(*(_key(order, top, k) for k, (order, top) in enumerate(plan)))).alias("turn", "key"))
    large = materialise(turned.groupBy("key").count().where(f"count > {limit}").withColumn("n", F.ceil(F.col("count") / limit).cast("int")).select("key", "n"), "large")
    if large.isEmpty():
        turned = turned.withColumns({"i": F.lit(0), "j": F.lit(0), "slice": F.lit(0)})
    else:
        n = F.coalesce("n", F.lit(1))
        dealt = turned.join(large, "key", "left").withColumn("slice", F.pmod(F.xxhash64("fp", F.lit(7)), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        turned = dealt.withColumns({"i": F.least("slice", "other"), "j": F.greatest("slice", "other")})
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * len(plan) // TASK_ROWS))
    packed = turned.select("fp", "turn", "i", "j", "slice", "key").repartition(tasks, "key", "i", "j")

    def join(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        fp, turn, i, j, part = (t.column(c).to_numpy() for c in ("fp", "turn", "i", "j", "slice"))
        group = np.lexsort((j, i, turn))
        bounds = np.flatnonzero(np.concatenate(([True], (np.diff(turn[group]) != 0) | (np.diff(i[group]) != 0) | (np.diff(j[group]) != 0))))
        for at, to in zip(bounds, [*bounds[1:], len(group)], strict=True):
            rows = group[at:to]
            order, top = plan[int(turn[rows[0]])]
            prints = _turned(fp[rows].view(np.uint64), order)
            by = np.argsort(prints)
            rows, prints = rows[by], prints[by]
            side = (part[rows] == j[rows]).astype(np.int8) if i[rows[0]] != j[rows[0]] else None
            label = trie_components(prints, side, budget, top)
            near = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[rows[near]]), pa.array(fp[rows[label[near]]])], names=["a", "b"])

    return packed.mapInArrow(join, "a long, b long")


def near_components(prints: DataFrame, budget: int = 3, limit: int = 8192) -> DataFrame:
    """``prints`` (doc_id, fp) with component_id: the least doc_id of the rows whose fingerprints are linked; null if none has one."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = connected_components(near_links(nodes, budget, limit))
    rooted = materialise(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(materialise(rooted.join(least, "root").select("fp", "component_id"), "groups"), "fp")


def simhash_groups(docs: DataFrame, width: int = 3, seed: int = 42, budget: int = 3, limit: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Texts without a word have fingerprint zero and are linked like any other. Rows with a null id
    take part; a component of such rows only has a null component_id. Repeated rows are repeated
    in the result. An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, width, seed, id_col, text_col), "prints")
    return near_components(prints, budget, limit).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def text_key(text_col: str):
    """What a text is told apart by where rows are grouped."""
    return F.xxhash64(F.col(text_col).cast("string"))


def one_of_each(docs: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that have the smallest id (null last), then text key, of their group; ``roots`` (node, root) are groups of text keys.

    Only rows that go are shuffled by text key and id, and rows that are equal in both share one fate.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("h")).distinct()
    grouped = materialise(own.join(roots, F.col("h") == F.col("node"), "left").select("id", "h", F.coalesce("root", "h").alias("g")), "grouped")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    first = grouped.groupBy("g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    i, h = fresh(docs, "id"), fresh(docs, "h")
    gone = materialise(grouped.join(first, "g").where(place != F.col("first")).select(F.col("id").alias(i), F.col("h").alias(h)), "gone")
    discard(grouped)
    key, same = fresh(docs, "key"), F.col(id_col).cast("long").eqNullSafe(F.col(i))
    marked = docs.withColumn(key, text_key(text_col))
    return marked.join(gone, (F.col(key) == F.col(h)) & same, "left_anti").select(*docs.columns)


def simhash_dedup(docs: DataFrame, width: int = 5, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id (null last). Rows that are equal in id and text share one fate."""
    rows = docs.select(text_key(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    bits = near_components(materialise(fingerprints(rows, width, id_col="h"), "prints"), budget)
    return one_of_each(docs, bits.select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")).distinct(), id_col, text_col)
