"""Merkle manifest of a dataset: a tree for each source, a tree over the sources, and a proof for each row.

Leaves are hashes of rows, made by built-in functions from one scan, and only they move. A source's leaves are numbered by a
range sort and the counts of its partitions; consecutive leaves then form chunks of a fixed number, wherever runs
begin or end.

* Up. A chunk is read left to right onto a mountain-range stack: a node that ends a run of its siblings carries the
  run into their parent, as an odometer of base ``FANOUT`` does, and leaves a record of parent and children. The tree's
  size is known, so a short last run is completed without padding. What stays on the stack are the chunk's peaks: whole
  subtrees whose siblings lie, at an unaligned edge, in a neighbouring chunk. They are merged by the same stack,
  ``WIDTH`` chunks a task and round after round, until a tree has one peak, its subroot.
* The subroots are the leaves of the last tree, built in the same way, whose peak is the root.
* Down. Each task takes its inputs again, and what leads from its peaks to the root, and hands to each input the
  siblings on its own way; at the leaves these are the proofs. No task holds more than a chunk or the peaks of WIDTH chunks.

Defined results: a null field is hashed as ``-``, an empty one as ``0:``; texts of any length are hashed whole; leaves of one
source ascend by id, null ids first, rows that repeat an id by their hash, and equal rows are leaves of their own whose
places are interchangeable; null sources are a tree of their own, first of all; a lone leaf is its subroot and a lone
subroot the root; rows without an id are never tampered with; an empty table gives no rows; columns that are not hashed
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, small_side

FANOUT = 3
#: Consecutive leaves in a chunk, and chunks whose peaks one task merges.
CHUNK, WIDTH = 20_000, 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PEAKS = "tree string, part long, level int, at long, node binary, size long"
_WAYS = "tree string, part long, level int, at long, way binary, subroot binary, root binary"


def join_hash(digests: list[bytes]) -> bytes:
    """The hash of a run: of its digests' lowercase hex, one after the other."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def levels_of(size: int) -> list[int]:
    """Nodes at each level of a tree of ``size`` leaves, up to the one at its top."""
    found = [size]
    while found[-1] > 1:
        found.append(-(-found[-1] // FANOUT))
    return found


class Node:
    __slots__ = ("level", "at", "digest", "children")

    def __init__(self, level: int, at: int, digest: bytes, children: tuple = ()):
        self.level, self.at, self.digest, self.children = level, at, digest, children


def peaks(nodes: Iterator[Node], size: int) -> list[Node]:
    """The mountain-range stack after all ``nodes``, which stand side by side from left to right."""
    widths, stack = levels_of(size), []
    for node in nodes:
        stack.append(node)
        while True:
            top = stack[-1]
            run = top.at % FANOUT + 1
            if widths[top.level] == 1 or run < FANOUT and top.at + 1 < widths[top.level]:
                break  # the tree's top, or a run that goes on
            family = stack[-run:]
            if len(family) < run or any(n.level != top.level or n.at != top.at - run + 1 + k for k, n in enumerate(family)):
                break  # an elder sibling is elsewhere
            del stack[-run:]
            stack.append(Node(top.level + 1, top.at // FANOUT, join_hash([n.digest for n in family]), tuple(family)))
    return stack


# A way: for each level the place in the run, the number of siblings, and their digests.
def step(place: int, family: tuple[Node, ...]) -> bytes:
    return bytes((place, len(family) - 1)) + b"".join(n.digest for k, n in enumerate(family) if k != place)


def steps(way: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(way):
        place, n = way[at], way[at + 1]
        yield place, [way[k : k + 32] for k in range(at + 2, at + 2 + 32 * n, 32)]
        at += 2 + 32 * n


def fold(digest: bytes, way: bytes) -> bytes:
    """The root that a digest and the siblings on its way give."""
    for place, others in steps(way):
        digest = join_hash([*others[:place], digest, *others[place:]])
    return digest


def proof_hash(way: bytes) -> str:
    return hashlib.sha256("".join(d.hex() for _, others in steps(way) for d in others).encode()).hexdigest()


def below(node: Node, way: bytes, found: Callable[[Node, bytes], None]) -> None:
    """Hands the way from each input under a peak to ``found``."""
    todo = [(node, way)]
    while todo:
        node, way = todo.pop()
        if not node.children:
            found(node, way)
        for place, child in enumerate(node.children):
            todo.append((child, step(place, node.children) + way))


def _inputs(table: pa.Table) -> tuple[list[Node], np.ndarray]:
    """A group's nodes from left to right, and their rows."""
    level, at = (table.column(c).to_numpy() for c in ("level", "at"))
    order = np.argsort([int(a) * FANOUT ** int(b) for a, b in zip(at, level)], kind="stable")
    digests = table.column("node").to_pylist()
    return [Node(int(level[k]), int(at[k]), digests[k]) for k in order], order


def _up(table: pa.Table) -> pa.Table:
    nodes, _ = _inputs(table)
    first = table.slice(0, 1).to_pylist()[0]
    rows = [(first["tree"], first["part"], n.level, n.at, n.digest, first["size"]) for n in peaks(iter(nodes), first["size"])]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["tree", "part", "level", "at", "node", "size"])


def _ways(inputs: pa.Table, ways: pa.Table) -> tuple[list[bytes], bytes, bytes]:
    """The way from each of a group's inputs, by row, its subroot and the root."""
    nodes, order = _inputs(inputs)
    row = {(n.level, n.at): int(k) for n, k in zip(nodes, order)}
    known = {(r["level"], r["at"]): r for r in ways.to_pylist()}
    found: list[bytes] = [b""] * len(nodes)

    def take(n: Node, way: bytes) -> None:
        found[row[n.level, n.at]] = way

    for peak in peaks(iter(nodes), inputs.column("size")[0].as_py()):
        below(peak, known[peak.level, peak.at]["way"], take)
    one = next(iter(known.values()))
    return found, one["subroot"], one["root"]


def _down(inputs: pa.Table, ways: pa.Table) -> pa.Table:
    if not inputs.num_rows:
        return pa.table({c: pa.array([], t) for c, t in zip(("tree", "part", "level", "at", "way", "subroot", "root"), (pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3))})
    found, subroot, root = _ways(inputs, ways)
    same = lambda v: pa.array([v] * inputs.num_rows, pa.binary())
    return pa.table(
        [inputs.column(c) for c in ("tree", "below", "level", "at")] + [pa.array(found, pa.binary()), same(subroot), same(root)],
        names=["tree", "part", "level", "at", "way", "subroot", "root"],
    )


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the place from 0 in its tree, and ``size``, the tree's leaves: a range sort, and the counts of each
    partition. ``leaves`` is a cut table; equal rows are told apart by where they stand in it, so that none of
    them have to meet in one task."""
    names = leaves.columns
    spread = leaves.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "_tie"]
    ordered = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_p", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tree = 0, None
        for b in batches:
            inside = np.empty(b.num_rows, dtype=np.int64)
            for k, t in enumerate(b.column(b.schema.get_field_index("tree")).to_pylist()):
                seen, tree = (0 if t != tree else seen), t
                inside[k] = seen
                seen += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(inside)], names=[*b.schema.names, "_inside"])

    placed = cut(ordered.mapInArrow(count, ordered.select("*", F.lit(0).cast("long").alias("_inside")).schema))
    counts = placed.groupBy("tree", "_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition that a tree has leaves in
    mine = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(mine.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select("tree", "_p", before.alias("_before"), F.sum("_n").over(mine).alias("size")))
    return placed.join(small_side(offsets), ["tree", "_p"]).select(*names, (F.col("_before") + F.col("_inside")).alias("at"), "size")


def forest(placed: DataFrame, chunk: int, width: int) -> list[DataFrame]:
    """Tables of peaks, from those of the chunks to one peak a tree; ``part`` numbers the tasks of a round, ``below`` those of
    the round before."""
    nodes = placed.select("tree", (F.col("at") / chunk).cast("long").alias("part"), F.lit(0).alias("level"), "at", "node", "size")
    rounds = []
    while True:
        made = cut(nodes.groupBy("tree", "part").applyInArrow(_up, _PEAKS).withColumn("below", F.col("part")))
        rounds.append(made)
        if not (made.agg(F.max("part")).first()[0] or 0):
            return rounds
        nodes = made.select("tree", (F.col("part") / width).cast("long").alias("part"), "level", "at", "node", "size")


def ways_down(rounds: list[DataFrame], tops: DataFrame, width: int) -> DataFrame:
    """_WAYS of the chunks' peaks; ``tops`` has those of the subroots."""
    ways = tops
    for made in reversed(rounds[:-1]):
        inputs = made.select("tree", (F.col("below") / width).cast("long").alias("part"), "below", "level", "at", "node", "size")
        down = inputs.groupBy("tree", "part").cogroup(ways.groupBy("tree", "part")).applyInArrow(_down, _WAYS)
        ways = cut(down)
    return ways


def field(value: Column) -> Column:
    """A value as it is hashed: its length in UTF-8 bytes, a colon and itself; ``-`` if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def manifest(
    df: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    tampered: Column | None = None, chunk: int = CHUNK, width: int = WIDTH,
) -> DataFrame:
    """(id, leaf, subroot, root, way, folded): for each row the digests of its manifest, the siblings on its way to the root
    (see ``steps``), and the root that its row gives on that way once ``tampered`` rows have lost the line feeds of their
    text."""
    values = {c: F.col(c) for c in fields}
    without = F.translate(F.col(text_col), "\n", "")
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False)) & F.col(text_col).contains("\n")
    # '=' keeps the order of sources and puts all of them after the null one.
    tree = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    leaves = cut(
        df.select(
            F.col(id_col).alias("id"), tree.alias("tree"), row_hash(list(values.values())).alias("node"),
            F.when(changed, row_hash([without if c == text_col else v for c, v in values.items()])).alias("other"),
        )
    )
    placed = cut(numbered(leaves, ["id", "node"]))
    rounds = forest(placed, chunk, width)
    subroots = rounds[-1].select("tree", F.col("node").alias("subroot"))

    # The tree over the sources: its leaves are the subroots.
    over = cut(numbered(cut(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("subroot").alias("node"))), ["key"]))
    above = forest(over, chunk, width)
    root = above[-1].select("tree", F.lit(0).cast("long").alias("part"), "level", "at", F.lit(b"").alias("way"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    inner = ways_down(above, root, width)
    ends = over.select("tree", (F.col("at") / chunk).cast("long").alias("part"), F.lit(0).alias("level"), "at", "node", "size", "key")
    tops = cut(ends.groupBy("tree", "part").cogroup(inner.groupBy("tree", "part")).applyInArrow(_top, "tree string, way binary, subroot binary, root binary"))
    highest = rounds[-1].select("tree", "part", "level", "at")
    ways = ways_down(rounds, highest.join(tops, "tree").select("tree", "part", "level", "at", "way", "subroot", "root"), width)

    ends = placed.select("tree", (F.col("at") / chunk).cast("long").alias("part"), F.lit(0).alias("level"), "at", "node", "size", "id", "other")
    schema = f"id {dict(df.dtypes)[id_col]}, leaf binary, subroot binary, root binary, way binary, folded binary"
    return ends.groupBy("tree", "part").cogroup(ways.groupBy("tree", "part")).applyInArrow(_proofs, schema)


def _top(inputs: pa.Table, ways: pa.Table) -> pa.Table:
    found, _, root = _ways(inputs, ways)
    return pa.table({"tree": inputs.column("key"), "way": pa.array(found, pa.binary()), "subroot": inputs.column("node"), "root": pa.array([root] * len(found), pa.binary())})


def _proofs(inputs: pa.Table, ways: pa.Table) -> pa.Table:
    found, subroot, root = _ways(inputs, ways)
    leaves, others = inputs.column("node").to_pylist(), inputs.column("other").to_pylist()
    folded = [fold(leaf if other is None else other, way) for leaf, other, way in zip(leaves, others, found)]
    same = lambda v: pa.array([v] * len(found), pa.binary())
    return pa.table(
        [inputs.column("id"), inputs.column("node"), same(subroot), same(root), pa.array(found, pa.binary()), pa.array(folded, pa.binary())],
        names=["id", "leaf", "subroot", "root", "way", "folded"],
    )


def verified(proofs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``manifest``'s rows: hex digests, a hash of each proof, and whether the row gives the root."""
    digest = F.pandas_udf(lambda ways: ways.map(proof_hash), "string")
    hexed = lambda c: F.lower(F.hex(c)).alias({"folded": "folded_root"}.get(c, c))
    return proofs.select(
        F.col("id").alias(id_col), hexed("leaf"), hexed("subroot"), hexed("root"), digest("way").alias("proof_sha256"), hexed("folded"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
