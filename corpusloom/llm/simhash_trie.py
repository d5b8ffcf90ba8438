"""Near duplicates by SimHash: a self-join of binary tries of fingerprints.

Fingerprints are 64-bit SimHashes over a text's word shingles, repeats included. Two of them link when they differ in
``radius`` bits at most.

The join walks pairs of nodes of a binary trie. A pair starts at the root with itself, splits by the next bit into the
pairs of its children, of which those whose bits differ spend one of the ``radius`` errors, and ends when the errors are
spent or few enough fingerprints are left to be compared. A trie is no structure of its own here: over sorted
fingerprints a node is a range, its children meet where the next bit turns to one, and a task walks whole arrays of node pairs.

* A pair within the radius agrees on one of radius + 1 blocks of bits. Every distinct fingerprint goes to the tries of its
  blocks, radius + 1 narrow rows whatever the size of the corpus, so a trie holds those that share a block.
* A trie of more than ``crowd`` fingerprints is walked by Spark first: its fingerprints are dealt to nodes of the bits that
  divide them best, and each goes to all pairs of its node with nodes that differ in ``radius`` bits at most.
* Of the links found, a task keeps a star for each group of fingerprints that it joined: fewer rows than fingerprints, and
  the same components. Components are then found over all tasks' stars.

Copies meet in an aggregation before anything is compared, and nodes are fingerprints, not documents.

Defined results: null and empty texts and those without words have the fingerprint zero and are linked like others; texts of any
length are read whole; repeated rows are rows of the result; a row without an id has the class of its fingerprint, null if
no row of the class has an id; a class is named by its least id; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows
from corpusloom.llm.common import cut, small_side
from corpusloom.llm.graph import components

BITS, SEED = 64, 42
#: Fingerprints of a trie that one task walks; node pairs in an array; pairs of fingerprints that are compared rather than split.
CROWD, BLOCK, FEW = 200_000, 262_144, 16
#: Shingles whose bits are counted at once.
SLICE = 65_536
U = np.uint64


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles of a text's words, in slices."""
    found = (text or "").encode().lower().split()
    if not found:
        return
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    size = min(size, len(found))
    first, last = (ends - lengths)[: len(found) - size + 1], ends[size - 1 :]
    for k in range(0, len(first), SLICE):
        a, b = first[k : k + SLICE].tolist(), last[k : k + SLICE].tolist()
        yield np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b)), dtype=U, count=len(a))


def fingerprint(text: str | None, size: int = 3) -> int:
    """As a signed 64-bit number."""
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for h in shingle_hashes(text, size):
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print bigint) of every row."""

    def make():
        return lambda ids, texts: [(i, fingerprint(t, size)) for i, t in zip(ids, texts, strict=True)]

    return map_rows(df.select(id_col, text_col), make, f"{id_col} {dict(df.dtypes)[id_col]}, print bigint")


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """(first bit from the top, bits) of the radius + 1 blocks."""
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def union(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i[k] and j[k]; a label is the least member of its class."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (further := labels[labels]) is not None and (further != labels).any():
            labels[:] = further


class Trie:
    """The tries over some ranges of ``keys``, each sorted and without repeats; ``bits`` of a key count, from the top."""

    def __init__(self, keys: np.ndarray, bits: int, radius: int):
        self.keys, self.bits, self.radius = keys, bits, radius
        self.labels = np.arange(len(keys))
        self._ones: dict[int, np.ndarray] = {}
        self._found: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def split(self, bit: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the keys of nodes [low, high) turn to one."""
        if bit not in self._ones:
            self._ones[bit] = np.concatenate([[0], np.cumsum(self.keys >> U(bit) & U(1), dtype=np.int32)])
        ones = self._ones[bit]
        return high - (ones[high] - ones[low])

    def compare(self, a0, a1, b0, b1) -> None:
        """Looks at every pair of fingerprints of small node pairs."""
        wide = b1 - b0
        n = (a1 - a0) * wide
        at = np.repeat(np.arange(len(n)), n)
        t = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        i, j = a0[at] + t // wide[at], b0[at] + t % wide[at]
        near = (i < j) & (np.bitwise_count(self.keys[i] ^ self.keys[j]) <= self.radius)
        if near.any():
            self._found.append((i[near], j[near]))
            self._waiting += int(near.sum())
            if self._waiting > len(self.keys):
                self.settle()

    def settle(self) -> None:
        if self._found:
            union(self.labels, *(np.concatenate(x) for x in zip(*self._found)))
        self._found, self._waiting = [], 0

    def walk(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """The labels once all pairs of nodes, [a0, a1) with [b0, b1), equal or a before b, are walked, deepest arrays first."""
        todo = [(self.bits - 1, a0, a1, b0, b1, np.zeros(len(a0), dtype=np.int8))]
        while todo:
            bit, a0, a1, b0, b1, errors = todo.pop()
            few = (a1 - a0) * (b1 - b0) <= FEW
            if few.any():
                self.compare(a0[few], a1[few], b0[few], b1[few])
                a0, a1, b0, b1, errors = (x[~few] for x in (a0, a1, b0, b1, errors))
            if not len(a0):
                continue
            am, bm = self.split(bit, a0, a1), self.split(bit, b0, b1)
            other = a0 != b0  # one node with itself has three pairs of children, two nodes have four
            more = errors + 1
            pairs = [
                np.concatenate(x)
                for x in zip((a0, am, b0, bm, errors), (am, a1, bm, b1, errors), (a0, am, bm, b1, more), tuple(x[other] for x in (am, a1, b0, bm, more)))
            ]
            live = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= self.radius)
            pairs = [x[live] for x in pairs]
            todo += [(bit - 1, *(x[k : k + BLOCK] for x in pairs)) for k in range(0, len(pairs[0]), BLOCK)]
        self.settle()
        return self.labels


def _stars(blocks: list[tuple[int, int]], radius: int):
    """Sorted (k, v, a, b, side, rest) to links (a, b): v is block k of a fingerprint and ``rest`` its other bits, from those
    below the block on; a and b are the nodes of a pair and ``side`` which of the two a row is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, 0), dtype=np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns]).astype(np.int64)], axis=1)
            if held.shape[1] >= CROWD:  # whole tries only
                edge = starts_of(held)[-1]
                yield from walked(held[:, :edge])
                held = held[:, edge:]
        yield from walked(held)

    def starts_of(rows: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)]))

    def walked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.unique(rows[0]).tolist():
            first, bits = blocks[k]
            mine = rows[:, rows[0] == k]
            starts = starts_of(mine)
            ends = np.append(starts[1:], mine.shape[1])
            second = starts + np.add.reduceat((mine[4] == 0).astype(np.int64), starts)  # where a pair's second node begins
            own = mine[2, starts] == mine[3, starts]
            live = np.where(own, ends - starts > 1, (starts < second) & (second < ends))  # a missing node links with nothing
            a1, b0 = np.where(own, ends, second), np.where(own, starts, second)
            rest = mine[5].view(U)
            labels = Trie(rest, BITS - bits, radius).walk(starts[live], a1[live], b0[live], ends[live])
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            if len(moved):
                whole = mine[1].view(U) << U(BITS - bits) | rest
                whole = whole >> U(first) | whole << U(BITS - first) if first else whole
                yield pa.RecordBatch.from_arrays([pa.array(whole[x].view(np.int64)) for x in (moved, labels[moved])], names=["a", "b"])

    return run


def stars(prints: DataFrame, radius: int = 3, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that join the fingerprints of ``prints`` (print, without repeats) as all links do."""
    blocks = blocks_of(radius)
    turned = lambda first: f"(shiftleft(print, {first}) | shiftrightunsigned(print, {BITS - first}))" if first else "print"
    keys = [
        f"named_struct('k', {k}, 'v', shiftrightunsigned({turned(first)}, {BITS - bits}), 'rest', {turned(first)} & {2 ** (BITS - bits) - 1}L)"
        for k, (first, bits) in enumerate(blocks)
    ]
    keyed = prints.select(F.inline(F.expr(f"array({', '.join(keys)})")))
    whole = [F.lit(0).alias(c) for c in ("a", "b", "side")]
    crowds = cut(keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd))
    largest = crowds.agg(F.max("n")).first()[0]
    if largest is None:
        tries = keyed.select("k", "v", *whole, "rest")
    else:
        known = small_side(crowds)  # of at most one for each ``crowd`` rows
        tries = keyed.join(known, ["k", "v"], "left_anti").select("k", "v", *whole, "rest").union(_dealt(keyed, known, radius, int(largest), crowd, blocks))
    order = ["k", "v", "a", "b", "side", "rest"]
    return tries.repartition(*order[:4]).sortWithinPartitions(*order).mapInArrow(_stars(blocks, radius), "a bigint, b bigint")


def _dealt(keyed: DataFrame, crowds: DataFrame, radius: int, largest: int, crowd: int, blocks: list[tuple[int, int]]) -> DataFrame:
    """The fingerprints of crowded tries in each pair of nodes that they may have links in. Nodes are the values of the
    bits, twice as many as would do if they were independent, of which a trie's fingerprints have ones and zeros most evenly."""
    widest = BITS - min(bits for _, bits in blocks)
    depth = min(24, widest, 2 * max(1, (largest // crowd).bit_length()))
    inside = keyed.join(crowds.select("k", "v"), ["k", "v"], "left_semi")
    ones = [f"sum(shiftrightunsigned(rest, {b}) & 1)" for b in range(widest)]
    even = F.expr(
        f"slice(transform(array_sort(transform(array({', '.join(ones)}), (x, b) -> named_struct('off', abs(2 * x - count(1)), 'b', b))), s -> s.b), 1, {depth})"
    )
    bits = inside.groupBy("k", "v").agg(even.alias("bits"))  # a row for each crowded trie
    masks = [sum(1 << i for i in chosen) for r in range(min(radius, depth) + 1) for chosen in combinations(range(depth), r)]
    node = F.expr("aggregate(bits, 0, (x, b) -> x * 2 + cast(shiftrightunsigned(rest, b) & 1 AS int))")
    at = inside.join(small_side(cut(bits)), ["k", "v"]).select("k", "v", "rest", node.alias("node"))
    pairs = at.select("k", "v", "rest", "node", F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn("other", F.col("node").bitwiseXOR(F.col("mask")))
    side = (F.col("node") > F.col("other")).cast("int").alias("side")
    return pairs.select("k", "v", F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), side, "rest")


def classes(df: DataFrame, radius: int = 3, size: int = 3, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(id, print, component_id): every row's fingerprint and the least id that links lead to."""
    prints = cut(fingerprints(df, size, id_col, text_col))
    distinct = cut(prints.groupBy("print").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")))
    linked = cut(components(stars(distinct.select("print"), radius, crowd)))
    named = distinct.join(linked.withColumnRenamed("node", "print"), "print", "left")
    roots = cut(named.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("first")))
    # Only fingerprints of several rows have another class than their row's own id.
    several = named.where("n > 1 OR root IS NOT NULL").join(small_side(roots), "root", "left")
    several = cut(several.select("print", F.coalesce("first", "least").alias("component_id")))
    return prints.join(small_side(several), "print", "left").select(id_col, "print", F.coalesce("component_id", id_col).alias("component_id"))


def hexed(prints: str) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(prints), 16, "0"))
