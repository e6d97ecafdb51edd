"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, one occurrence per group.

Lines are normalised (A-Z lower-cased, white space collapsed) and equal ones collapsed by hash. The
distinct words of a line are dealt out to blocks by their hash, and each block has the SimHash of its
own words; lines that share a block are candidates. A word that changes disturbs its block only, so
by the pigeonhole principle two lines that differ in fewer words than there are blocks share one.
There are sixteen blocks in a long line, eight in others and also four and two in short ones; blocks
of too few words tell too little and are left out. Candidates within ``budget`` bits of a 128-bit
SimHash of the whole line are verified by edit similarity and joined into connected groups, of which the first occurrence
stays. Lines of few words but of some length, as in scripts without spaces, are compared by their
runs of three characters instead of words; still shorter lines are only compared for equality.

A block value that many lines share does not hand out its pairs. Lines within budget of a leader are
compared with the leader; whatever lines of the value are within budget of one that is then still in a
different group meet in one task with their texts, which compares them all there and returns only the links
that join groups. The groups are those that all pairs of each value make.
"""

from __future__ import annotations

from functools import partial
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest, xxh64_intdigest

from .common import chunks, discard, fresh, materialise, mix64, word_hashes
from .components import connected_components
from .simhash_dedup import majority

#: (parts, words, least): into how many blocks the distinct words of a line are dealt, for lines of so many distinct
#: words, and how many words a block needs to be a candidate.
DIVISIONS = ((16, (49, 1 << 30), 4), (8, (17, 48), 3), (8, (1, 16), 2), (4, (1, 16), 2), (2, (1, 16), 3), (1, (1, 4), 1))
VALUE_BITS = 26
#: Lines with fewer words are compared by characters, if they have so many.
FEW_WORDS, SOME_CHARS = 5, 20
SALT = np.uint64(0x5851F42D4C957F2D)
#: Pairs that a task holds while it compares the lines of one value, about; and how many it compares at a time.
PAIRS, AT_ONCE = 1 << 18, 512
#: Lines of a value, and bytes of their text, that one task compares with each other; a value with more is dealt out as pairs of slices.
SLICE_ROWS, SLICE_BYTES = 1024, 32_000_000
#: Characters up to which edit distances are found side by side, and how many pairs at a time.
LANE_CHARS, LANES = 4096, 32
#: Rows that one task compares, about.
TASK_ROWS = 1_000_000


def _signatures(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines with the given words: two 64-bit halves of the signature, and block keys with the number of each line's."""
    n = len(counts)
    line = np.repeat(np.arange(n, dtype=np.uint64), counts)
    keys = np.sort((line << np.uint64(40)) | (words >> np.uint64(24)))  # under 2**24 lines at a time; the part is in a word's top bits
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    owner, bits = (keys >> np.uint64(40)).astype(np.int64), mix64(keys & np.uint64((1 << 40) - 1))
    distinct = np.bincount(owner, minlength=n)

    owners, made = [], []
    for parts, (low, high), least in DIVISIONS:
        chosen = (distinct >= low) & (distinct <= high)
        lines, inside = np.flatnonzero(chosen), chosen[owner]
        block = (np.cumsum(chosen) - 1)[owner[inside]] * parts + ((keys[inside] >> np.uint64(41 - parts.bit_length())) & np.uint64(parts - 1)).astype(np.int64)
        size = np.bincount(block, minlength=len(lines) * parts)
        value = majority(bits[inside], size, 4)
        ok = np.flatnonzero(size >= least)
        owners.append(lines[ok // parts])
        made.append((value[ok] & np.uint64((1 << VALUE_BITS) - 1)).astype(np.int64) | (parts - 1 + ok % parts) << VALUE_BITS)
    owner, made = np.concatenate(owners), np.concatenate(made)
    order = np.argsort(owner, kind="stable")
    return majority(bits, distinct), majority(mix64(bits ^ SALT), distinct), made[order], np.bincount(owner, minlength=n)


def _features(line: bytes, words: list[bytes]) -> bytes:
    """What a line is compared by, as words: its words, or runs of three characters, or nothing."""
    if len(words) >= FEW_WORDS:
        return line
    text = line.decode("utf-8", "replace")
    return " ".join(text[k : k + 3].replace(" ", "_") for k in range(len(text) - 2)).encode() if len(text) >= SOME_CHARS else b""


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, line, h, c, s0, s1, keys, text) of every line that is not blank; row tells texts with equal ids apart."""

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch.column(2), 2_000_000):
                rows, ids, numbers, texts, features = [], [], [], [], []
                for row, i, t in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist(), strict=True):
                    for k, line in enumerate((t or b"").split(b"\n")):
                        if words := line.lower().split():
                            rows.append(row)
                            ids.append(i)
                            numbers.append(k)
                            texts.append(b" ".join(words))
                            features.append(_features(texts[-1], words))
                if not texts:
                    continue
                words, _, counts = word_hashes(features)
                s0, s1, keys, n_keys = _signatures(words, counts)
                h = np.fromiter(map(xxh64_intdigest, texts), dtype=np.uint64, count=len(texts))
                c = np.fromiter(map(xxh32_intdigest, texts), dtype=np.uint32, count=len(texts))
                values = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_keys))), pa.int32()), pa.array(keys, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(h.view(np.int64)), pa.array(c.view(np.int32)),
                     pa.array(s0.view(np.int64)), pa.array(s1.view(np.int64)), values, pa.array(texts, pa.binary())],
                    names=["row", "id", "line", "h", "c", "s0", "s1", "keys", "text"],
                )

    rows = docs.select(_row(id_col, text_col), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "row long, id long, line int, h long, c int, s0 long, s1 long, keys array<int>, text binary")


def _row(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("row")


def deal_out(lines: DataFrame, values, limit: int) -> DataFrame:
    """(grp, h, s0, s1): each line under each of its ``values`` (below 2**31); hot values dealt out as pairs of slices.

    ``grp`` is the value, and below it the two slices in 16 bits each. Hot values are looked for in
    a sixteenth of the lines, chosen by hash: this settles how work is dealt out, never what is
    compared.
    """
    values = values.cast("array<long>")
    rows = lines.select("h", "s0", "s1", F.explode(values).alias("key"))
    sampled = lines.where(F.col("h").bitwiseAND(F.lit(15)) == 0).select(F.explode(values).alias("key"))
    large = materialise(sampled.groupBy("key").count().where(f"count * 16 > {limit // 2}").select("key", F.ceil(F.col("count") * 16 / limit).cast("int").alias("n")), "large")
    if large.isEmpty():
        return rows.select(F.shiftleft("key", 32).alias("grp"), "h", "s0", "s1")
    n = F.coalesce("n", F.lit(1))
    dealt = rows.join(large, "key", "left").withColumn("own", F.pmod(F.xxhash64("h", F.lit(7)), n)).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1).cast("array<long>")))
    return dealt.select((F.shiftleft("key", 32) + F.shiftleft(F.least("own", "other"), 16) + F.greatest("own", "other")).alias("grp"), "h", "s0", "s1")


def _close_pairs(group: np.ndarray, s0: np.ndarray, s1: np.ndarray, budget: int):
    """Positions (a, b) of all pairs within budget of the same group; ``group`` is sorted and its groups are small."""
    at = np.arange(len(group) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        near = np.bitwise_count(s0[at] ^ s0[at + step]) + np.bitwise_count(s1[at] ^ s1[at + step]) <= budget
        yield at[near], at[near] + step
        step += 1


def _leader_pairs(s0: np.ndarray, s1: np.ndarray, budget: int):
    """Positions (a, b) that link each line with the first line within budget that leads others."""
    left = np.arange(len(s0))
    while len(left) > 1:
        k, left = left[0], left[1:]
        near = np.bitwise_count(s0[k] ^ s0[left]) + np.bitwise_count(s1[k] ^ s1[left]) <= budget
        if near.any():
            yield left[near], np.full(int(near.sum()), k)
            left = left[~near]


def _apart_pairs(s0: np.ndarray, s1: np.ndarray, root: np.ndarray, budget: int):
    """For each line: its position, and those of the later lines within budget that are in a different component, with the bits that differ."""
    for k in range(len(s0) - 1):
        other = k + 1 + np.flatnonzero(root[k + 1 :] != root[k])
        bits = np.bitwise_count(s0[k] ^ s0[other]) + np.bitwise_count(s1[k] ^ s1[other])
        if (near := bits <= budget).any():
            yield k, other[near], bits[near]


def candidates(blocks: DataFrame, budget: int, small: int, rows: int) -> DataFrame:
    """(a, b, s0, s1): candidate pairs (s0 null); and, for block values of over ``small`` lines, their lines (a) by value (b).

    ``rows`` is about how many rows ``blocks`` has: it sets the number of tasks.
    """

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        group, h, s0, s1 = (t.column(c).to_numpy() for c in ("grp", "h", "s0", "s1"))
        order = np.lexsort((h, group))
        group, h, s0, s1 = group[order], h[order], s0[order].view(np.uint64), s1[order].view(np.uint64)
        cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        few = np.flatnonzero((size > 1) & (size <= small))
        found = [(few[a], few[b]) for a, b in _close_pairs(group[few], s0[few], s1[few], budget)]
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            if to - at > small:
                found += [(a + at, b + at) for a, b in _leader_pairs(s0[at:to], s1[at:to], budget)]
        if found:
            a, b = h[np.concatenate([a for a, _ in found])], h[np.concatenate([b for _, b in found])]
            a, b = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1) if len(a) else (a, b)
            yield _batch(a, b, None, None)
        many = np.flatnonzero(size > small)
        if len(many):
            yield _batch(h[many], group[many], s0[many].view(np.int64), s1[many].view(np.int64))

    def _batch(a, b, s0, s1):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none if s0 is None else pa.array(s0), none if s1 is None else pa.array(s1)], names=["a", "b", "s0", "s1"])

    tasks = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return blocks.select("grp", "h", "s0", "s1").repartition(tasks, "grp").mapInArrow(run, "a long, b long, s0 long, s1 long")


def still_apart(members: DataFrame, budget: int) -> DataFrame:
    """The rows of ``members`` (h, value, s0, s1, root) that have one of their value within budget in another component."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("value").combine_chunks()
        value, s0, s1, root = (t.column(c).to_numpy() for c in ("value", "s0", "s1", "root"))
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
        keep = np.zeros(len(value), dtype=bool)
        cuts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1], [True])))
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            if not (root[at:to] == root[at]).all():
                for k, other, _ in _apart_pairs(s0[at:to], s1[at:to], root[at:to], budget):
                    keep[at + k] = True
                    keep[at + other] = True
        yield from t.filter(pa.array(keep)).to_batches()

    columns = members.select("h", "value", "s0", "s1", "root")
    return columns.repartition("value").mapInArrow(run, "h long, value long, s0 long, s1 long, root long")


def _sliced(members: DataFrame) -> DataFrame:
    """``members`` (value, h, size, ...) with the group ``x``, ``y`` to compare a row in; a value with much text or many lines is dealt out as pairs of slices."""
    wide = members.groupBy("value").agg(F.ceil(F.greatest(F.count("*") / SLICE_ROWS, F.sum("size") / SLICE_BYTES)).cast("int").alias("n")).where("n > 1")
    wide = materialise(wide, "wide")
    if wide.isEmpty():
        return members.withColumns({"x": F.lit(0), "y": F.lit(0)})
    n = F.coalesce("n", F.lit(1))
    dealt = members.join(wide, "value", "left").withColumn("own", F.pmod(F.xxhash64("h", F.lit(5)), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("n", "own", "other")


def joining_links(members: DataFrame, texts: DataFrame, test, budget: int) -> DataFrame:
    """(a, b): links of alike lines of one value within budget that join what ``members`` (h, value, s0, s1, root) have as different components.

    Every such pair of a value is compared, unless links found before it join the two; no more links
    are returned than there are lines. ``test`` is as in ``verify``.
    """

    def run(t: pa.Table) -> pa.Table:
        h, s0, s1, root = (t.column(c).to_numpy() for c in ("h", "s0", "s1", "root"))
        label = np.unique(root, return_inverse=True)[1]
        found, held, n = [], [], 0
        compare = None

        def settle():
            nonlocal label, compare
            a, b, bits = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(bits, kind="stable")  # the nearest first: what they join need not be compared
            for at in range(0, len(order), AT_ONCE):
                x, y = a[order[at : at + AT_ONCE]], b[order[at : at + AT_ONCE]]
                apart = label[x] != label[y]
                if apart.any():
                    compare = compare or test(t.column("text").to_pylist())
                    x, y = x[apart], y[apart]
                    ok = compare(x, y)
                    for u, v in zip(x[ok], y[ok], strict=True):
                        if label[u] != label[v]:
                            found.append((h[u], h[v]))
                            label = np.where(label == label[u], label[v], label)

        for k, other, bits in _apart_pairs(s0.view(np.uint64), s1.view(np.uint64), root, budget):
            held.append((np.full(len(other), k), other, bits))
            n += len(other)
            if n >= PAIRS:
                settle()
                held, n = [], 0
        if held:
            settle()
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = materialise(members.join(texts, "h").withColumn("size", F.length("text")), "apart")
    # a number of tasks is given, as the work of a group is not told by its bytes, by which small tasks would be joined
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _sliced(rows).select("value", "x", "y", "h", "s0", "s1", "root", "text").repartition(tasks, "value", "x", "y")
    return materialise(dealt.groupBy("value", "x", "y").applyInArrow(run, "a long, b long"), "links")


def trimmed(a, b) -> tuple:
    """Two sequences without what they share at the ends, which leaves their Levenshtein distance as it is."""
    at, n = 0, min(len(a), len(b))
    if a[:n] == b[:n]:
        return a[n:], b[n:]
    low, high = 0, n  # the longest common prefix by bisection on slices
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    at, low, high = low, 0, n - low
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle :] == b[len(b) - middle :] else (low, middle - 1)
    return a[at : len(a) - low], b[at : len(b) - low]


def edit_distance(a, b, most: int) -> int:
    """Levenshtein distance of two sequences, or more than ``most``: bit-parallel."""
    a, b = trimmed(a, b)
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most or not a:
        return len(b)
    where: dict = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for k, c in enumerate(b):
        match = where.get(c, 0)
        x = match | down
        d = ((((match & up) + up) ^ up) | match) & full
        plus, minus = down | (~(d | up) & full), up & d
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        if distance - (len(b) - k - 1) > most:
            return most + 1
        plus, minus = ((plus << 1) | 1) & full, (minus << 1) & full
        up, down = minus | (~(x | plus) & full), plus & x
    return distance


def between(u: bytes, v: bytes) -> int:
    """The bytes that differ once what two strings share at their ends is taken off: a bound from above on their edit distance."""
    n = min(len(u), len(v))
    at = end = 0
    while at < n and u[at] == v[at]:
        at += 1
    while end < n - at and u[-1 - end] == v[-1 - end]:
        end += 1
    return max(len(u), len(v)) - at - end


def alignment_cost(a: list[bytes], b: list[bytes], most: int, look: int = 8) -> int:
    """What one greedy alignment of words costs in bytes, or more than ``most``: a bound from above on the edit distance."""
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        x, y = min(look, len(a) - i), min(look, len(b) - j)
        for k in range(1, look):
            if i + k < len(a) and a[i + k] in b[j : j + k + 1]:
                x, y = k, b.index(a[i + k], j) - j
                break
            if j + k < len(b) and b[j + k] in a[i : i + k + 1]:
                x, y = a.index(b[j + k], i) - i, k
                break
        cost += between(b" ".join(a[i : i + x]), b" ".join(b[j : j + y])) if x and y else sum(map(len, a[i : i + x])) + x + sum(map(len, b[j : j + y])) + y
        if cost > most:
            return most + 1
        i, j = i + x, j + y
    return cost + max(sum(map(len, a[i:])) + len(a) - i, sum(map(len, b[j:])) + len(b) - j)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def edit_distances(pairs: list[tuple[str, str]]) -> list[int]:
    """Levenshtein distances of pairs of strings, side by side in lanes of long integers (bit-parallel, a lane for each pair)."""
    pairs = [sorted(trimmed(a, b), key=len) for a, b in pairs]
    out = [0] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][1]))
    for at in range(0, len(order), LANES):
        own = order[at : at + LANES]
        width = max(len(pairs[k][0]) for k in own) // 8 + 1  # bytes: a lane's top bit, at least, is spare and takes its carry
        none = bytes(width)
        streams, lanes, low = [], [], []
        for lane, k in enumerate(own):
            a, b = map(_codes, pairs[k])
            known = np.unique(a)
            bits = np.zeros((len(known), 8 * width), dtype=bool)
            bits[:, : len(a)] = a == known[:, None]
            masks = dict(zip(known.tolist(), map(bytes, np.packbits(bits, axis=1, bitorder="little")), strict=True))
            streams.append([masks.get(c, none) for c in b.tolist()])
            lanes.append(((1 << len(a)) - 1) << 8 * width * lane)
            low.append(1 << 8 * width * lane if len(a) else 0)
        full, ones = sum(lanes), sum(low)
        ends = [len(x) for x in streams]
        up, down, step, done = full, 0, 0, 0
        for parts in zip_longest(*streams, fillvalue=none):
            while ends[done] == step:
                out[own[done]] = step + (up & lanes[done]).bit_count() - (down & lanes[done]).bit_count()
                done += 1
            match = int.from_bytes(b"".join(parts), "little")
            x = match | down
            d = ((((match & up) + up) ^ up) | match) & full
            plus, minus = down | (full & ~(d | up)), up & d
            plus, minus = (plus << 1) | ones, (minus << 1) & full
            up, down = (minus | ~(x | plus)) & full, plus & x & full
            step += 1
        for k in range(done, len(own)):
            out[own[k]] = ends[k] + (up & lanes[k]).bit_count() - (down & lanes[k]).bit_count()
    return out


class SimilarLines:
    """Tells which pairs of some normalised lines have an edit similarity, in characters, of at least ``least``."""

    def __init__(self, texts: list[bytes], least: float):
        self.least, self.bytes, self.chars = least, texts, [t.decode("utf-8", "replace") for t in texts]
        self.size = np.array([len(t) for t in self.chars], dtype=np.int64)
        bags = [np.empty((0, 128), dtype=np.int32)]
        for at in range(0, len(texts), 256):
            part = self.size[at : at + 256]
            places = np.repeat(128 * np.arange(len(part)), part) + (_codes("".join(self.chars[at : at + 256])) & 127)
            bags.append(np.bincount(places, minlength=128 * len(part)).astype(np.int32).reshape(-1, 128))
        self.bags = np.concatenate(bags)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of positions, whether the lines are similar."""
        most = ((1 - self.least) * np.maximum(self.size[a], self.size[b]) + 1e-9).astype(np.int64)
        ok = np.zeros(len(a), dtype=bool)
        open_ = np.flatnonzero(np.abs(self.size[a] - self.size[b]) <= most)
        more = self.bags[a[open_]] - self.bags[b[open_]]  # characters that have no counterpart: no edit takes away more than one of each side
        open_ = open_[np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1)) <= most[open_]]
        rest, cores = [], []
        for k, x, y, limit in zip(open_.tolist(), a[open_].tolist(), b[open_].tolist(), most[open_].tolist(), strict=True):
            # most pairs differ in a few words, which a bound shows; bytes are no fewer than characters
            if alignment_cost(self.bytes[x].split(b" "), self.bytes[y].split(b" "), limit) <= limit:
                ok[k] = True
            elif max(self.size[x], self.size[y]) > LANE_CHARS:
                ok[k] = edit_distance(self.chars[x], self.chars[y], limit) <= limit
            else:
                rest.append(k)
                cores.append((self.chars[x], self.chars[y]))
        ok[rest] = np.array(edit_distances(cores), dtype=np.int64) <= most[rest]
        return ok


def similar(a: bytes, b: bytes, least: float) -> bool:
    """Whether the edit similarity of two normalised lines, in characters, is at least ``least``."""
    return bool(SimilarLines([a, b], least)(np.array([0]), np.array([1]))[0])


def pair_by_pair(alike):
    """A test, as ``verify`` takes it, of a function of two texts."""
    return lambda texts: lambda a, b: np.array([alike(texts[x], texts[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)


def verify(pairs: DataFrame, texts: DataFrame, test) -> DataFrame:
    """The pairs whose lines are alike; ``texts`` (h, text) has each candidate line once.

    ``test`` takes a list of texts and gives a function of two arrays of positions in it, which says of each pair whether its texts are alike.
    """

    def run(batches):
        for batch in batches:
            for at, to in chunks(batch.column(2), 4_000_000):
                part = batch.slice(at, to - at)
                n = part.num_rows
                ok = test(part.column(2).to_pylist() + part.column(3).to_pylist())(np.arange(n), np.arange(n, 2 * n))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a, b = texts.select(F.col("h").alias("a"), F.col("text").alias("x")), texts.select(F.col("h").alias("b"), F.col("text").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, text) of every line that is ``wanted`` (h). Before texts are shuffled, lines are sifted by 20 bits of their hash."""
    wanted = materialise(wanted.distinct(), "wanted")
    bits = F.shiftrightunsigned("h", 44)
    sieve = F.broadcast(wanted.select(bits.alias("bits")).distinct())  # 2**20 rows at most
    sifted = lines.select("h", "text", bits.alias("bits")).join(sieve, "bits", "left_semi")
    return materialise(sifted.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text")), "texts")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that lie in different components and are not a line with the least that it is paired with."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rooted = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    return rooted.join(pairs.groupBy("a").agg(F.min("b").alias("b")), ["a", "b"], "left_anti")


def linked(found: DataFrame, source: DataFrame, alike, budget: int, test=None) -> DataFrame:
    """(node, root) of the components that the ``candidates`` make whose texts in ``source`` (h, text) are ``alike``.

    Of values with many lines links with leaders are tried first. Then the lines of a value that are
    still apart from one within budget are compared in one place. After that every pair of a value
    within budget was tried or is in one component. ``test``, as in ``verify``, may stand for ``alike``.
    """
    test = test or pair_by_pair(alike)
    pairs = materialise(found.where("s0 IS NULL").select("a", "b").distinct(), "pairs")
    many = found.where("s0 IS NOT NULL").select(F.col("a").alias("h"), F.col("b").alias("value"), "s0", "s1")
    texts = _texts(source, found.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))))
    # each line with the least that it is paired with: in a group of copies that makes all its other pairs needless
    first = verify(pairs.groupBy("a").agg(F.min("b").alias("b")), texts, test)
    links = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = connected_components(first)
    apart = _apart(pairs, roots)
    roots = connected_components(links(roots).unionByName(verify(apart, texts, test)))
    if not many.isEmpty():
        members = many.join(roots, F.col("h") == F.col("node"), "left").withColumn("root", F.coalesce("root", "h"))
        more = joining_links(still_apart(members, budget), texts, test, budget)
        if not more.isEmpty():
            roots = connected_components(links(roots).unionByName(more))
    discard(texts)
    return roots


def line_groups(lines: DataFrame, least: float = 0.8, budget: int = 36, small: int = 32, limit: int = 8192) -> DataFrame:
    """(h, c, g): each distinct line that repeats or has a similar one, and its group. Lines are told apart by h and c, 96 bits."""
    distinct = materialise(lines.groupBy("h").agg(*(F.first(c).alias(c) for c in ("c", "s0", "s1", "keys")), F.count("*").alias("n")), "distinct")
    found = materialise(candidates(deal_out(distinct, F.col("keys"), limit), budget, small, distinct.count() * 8), "candidates")
    roots = linked(found, lines, partial(similar, least=least), budget, partial(SimilarLines, least=least))
    grouped = distinct.select("h", "c", "n").join(roots, F.col("h") == F.col("node"), "left").where("n > 1 OR root IS NOT NULL")
    groups = materialise(grouped.select("h", "c", F.coalesce("root", "h").alias("g")), "groups")
    discard(distinct)
    discard(found)
    return groups


def dropped_lines(docs: DataFrame, least: float = 0.8, budget: int = 36, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, drop): for each text that loses lines, the numbers of those lines, from 0."""
    lines = materialise(lines_of(docs, id_col, text_col), "lines")
    groups = line_groups(lines, least, budget)
    seen = materialise(lines.select("h", "c", "id", "row", "line").join(groups, ["h", "c"]).drop("h", "c"), "seen")
    discard(lines)
    first = materialise(seen.groupBy("g").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "line")).alias("keep")), "first")
    gone = seen.join(first, "g").where(~((F.col("row") == F.col("keep.row")) & (F.col("line") == F.col("keep.line"))))
    return materialise(gone.groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("drop")), "drop")


def _without(docs: DataFrame, drop: DataFrame, id_col: str, text_col: str, number: str) -> DataFrame:
    """``docs`` with lines taken out, and a column ``number`` with how many."""
    row, gone = fresh(docs, "row"), fresh(docs, "drop")
    keyed = docs.withColumn(row, _row(id_col, text_col)).join(drop.select(F.col("row").alias(row), F.col("drop").cast("array<int>").alias(gone)), row, "left")
    # what lies between two dropped lines is a slice: linear in the lines of a text, which are divided once
    between = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.lit(None).cast("int"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = lambda x: F.flatten(F.transform(between, lambda g: F.slice(x, g["a"] + 2, F.coalesce(g["b"], F.size(x)) - g["a"] - 1)))
    rest = F.array_join(F.get(F.transform(F.array(F.split(F.col(text_col), "\n")), lambda x: kept(x)), F.lit(0)), "\n")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest)
    return keyed.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(number))


def line_dedup(docs: DataFrame, least: float = 0.8, budget: int = 36, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text's repeated lines taken out, and a column ``dropped_lines`` (their number).

    Lines are divided by line feeds; blank ones always stay. Of a group of similar lines the
    occurrence with the smallest id (null last) and line number stays; lines of under ``FEW_WORDS``
    words and ``SOME_CHARS`` characters are similar when equal. Null text stays null; an empty text
    has no line to lose; rows that are equal in id and text share one fate. All columns are kept, but
    a column ``dropped_lines`` of the input gives way; an empty table gives an empty result.
    """
    docs = docs.drop("dropped_lines")
    return _without(docs, dropped_lines(docs, least, budget, id_col, text_col), id_col, text_col, "dropped_lines")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` after line dedup, without the texts that lost every line; ``n_chars`` is kept true if it is there."""
    number = fresh(docs, "dropped")
    out = _without(docs, dropped_lines(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col, number)
    out = out.where((F.col(number) == 0) | (F.trim(F.regexp_replace(text_col, r"[\x09-\x0D]", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(number) > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
