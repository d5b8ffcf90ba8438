"""Benchmark decontamination in DataFrame and SQL functions only.

Texts are words (lower-cased runs of letters and digits) and five-word shingles. A document is contaminated
by an item if some window of it, as long as the item, reaches a similarity of ``threshold``: the weighted
Jaccard similarity of the two bags of shingles, a shingle weighing as often as it occurs.

1. Where to look. A window as long as the item that reaches the threshold t holds k = 2t / (1 + t) of the item's
   n shingles at least, in any order, so it starts within n shingles before the first of some k neighbours among
   the document's shared shingles, no later than at that first one, and ends after the last of them. A document
   shorter than the item is its own window and holds t n of them at least. All such windows are looked at.
2. SimHash of these windows and of the items, 64 bits over their bags of shingles.
3. Multi-index blocks: fingerprints within ``radius`` bits differ by at most radius // blocks bits in one of
   the blocks, so an index of each item's blocks with all their neighbours finds every pair of fingerprints
   of equal item size within the radius.
4. The exact similarity of each candidate decides.

Only texts that hold a window move, and only where the windows are too many to be broadcast. Item shingles are broadcast up
to ``broadcast_rows`` of them, the index of blocks up to a bound of its own; beyond, they are shuffled. Windows of a
weighted similarity of 0.8 differ in about 10 of 64 bits, with a deviation of 3; ``radius`` lies beyond four deviations.

Defined results: null and empty texts, and items of fewer than five words, match nothing; texts of any length are read
whole, and very long ones in runs of neighbouring windows; repeated rows of
a document or an item count once; of equally similar windows the first is reported; empty tables give an
empty result; only the id and text columns are read.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, cut, small_side

WIDTH = 5
#: Neighbouring starts whose windows are cut from one split of their text.
RUN = 256
BITS, BLOCK_BITS = 64, 8
BLOCKS = BITS // BLOCK_BITS
#: Counters of 16 and of 32 bits in a long, and the largest bag that the first can count: the top one is signed.
LANE, WIDE_LANE, FULL = 0x0001000100010001, 0x0000000100000001, 32767


def words(text: str) -> Column:
    """array<string> of a text column's words."""
    return F.expr(rf"array_remove(split(lower(coalesce({text}, '')), r'[^\p{{L}}\p{{N}}]+'), '')")


def shingles(words_col: str) -> Column:
    """array<bigint>: hashes of the five-word shingles of an array of words, in order."""
    return F.expr(
        f"CASE WHEN size({words_col}) >= {WIDTH} THEN transform(sequence(1, size({words_col}) - {WIDTH - 1}), "
        f"i -> xxhash64(slice({words_col}, i, {WIDTH}))) ELSE cast(array() AS array<bigint>) END"
    )


def simhash(bag: str) -> Column:
    """64-bit SimHash of an array of shingle hashes. A long carries four 16-bit counters, one for each of the
    bits k, k + 16, k + 32 and k + 48, so sixteen sums count all bits; of bags that these cannot count, two of
    32 bits each in 32 sums."""
    return F.when(F.size(F.col(bag)) <= FULL, _counted(bag, 16, LANE)).otherwise(_counted(bag, 32, WIDE_LANE))


def _counted(bag: str, width: int, mask: int) -> Column:
    lanes = [f"aggregate({bag}, 0L, (a, h) -> a + (shiftrightunsigned(h, {k}) & {mask}L))" for k in range(width)]
    counted = F.expr(f"array({', '.join(lanes)})")
    # The array of lanes is bound once, as the element of an array of one.
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    return F.transform(F.array(counted), lambda x: F.aggregate(bits, F.lit(0).cast("long"), _bit(x, bag, width)))[0]


def _bit(lanes: Column, bag: str, width: int):
    """Sets bit b where more than half of the shingles have it; counters are ``width`` bits wide."""
    zero, one, low = (F.lit(v).cast("long") for v in (0, 1, 2**width - 1))

    def step(done: Column, b: Column) -> Column:
        count = F.call_function("shiftrightunsigned", lanes[b % width], b - b % width).bitwiseAND(low)
        return done.bitwiseOR(F.when(count * 2 > F.size(F.col(bag)), F.call_function("shiftleft", one, b)).otherwise(zero))

    return step


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two bags given as arrays."""
    plain = f"size(array_intersect({a}, {b}))"
    bag = (
        f"aggregate(array_distinct({a}), 0, (n, h) -> n + least(size(filter({a}, x -> x = h)), size(filter({b}, x -> x = h))))"
    )
    sets = f"size(array_distinct({a})) = size({a}) AND size(array_distinct({b})) = size({b})"
    common = f"CASE WHEN {sets} THEN {plain} ELSE {bag} END"
    return F.expr(f"transform(array({common}), c -> cast(c AS double) / (size({a}) + size({b}) - c))[0]")


def index_items(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, m words, bag, fingerprint) of the items that have a shingle."""
    return (
        items.where(F.col(item_col).isNotNull())
        .select(F.col(item_col).alias("item_id"), words(text_col).alias("ws"))
        .where(F.size("ws") >= WIDTH)
        .withColumn("bag", shingles("ws"))
        .select("item_id", F.size("ws").alias("m"), "bag")
        .dropDuplicates(["item_id", "bag"])
        .withColumn("fingerprint", simhash("bag"))
    )


def block(fingerprint: str, k: str) -> str:
    return f"(shiftrightunsigned({fingerprint}, {BLOCK_BITS} * cast({k} AS int)) & {2**BLOCK_BITS - 1})"


def contaminated(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: Fraction = Fraction(4, 5),
    radius: int = 23,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(id, item_id, similarity, start): the best window of every contaminated pair; start is its first word."""
    t = Fraction(threshold)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = cut(index_items(items, item_col, item_text_col))
    n_item = known.select(F.sum(F.size("bag"))).first()[0] or 0
    small = (lambda df: F.broadcast(df)) if n_item <= broadcast_rows else (lambda df: df)

    # 1. Shared shingles, and the windows that hold enough of them.
    lookup = known.select("item_id", "m", F.explode("bag").alias("shingle")).groupBy("item_id", "m", "shingle").agg(F.count(F.lit(1)).alias("times"))
    found = (
        docs.select("id", words("text").alias("ws"))
        .select("id", F.posexplode(shingles("ws")).alias("p", "shingle"))  # nothing else may be carried along by every row
        .join(small(lookup), "shingle")
    )
    share = 2 * t / (1 + t)
    n = f"(m - {WIDTH - 1})"
    needed = f"cast(({n} * {share.numerator} + {share.denominator - 1}) div {share.denominator} AS int)"
    pairs = cut(  # else each use of it makes the shingles again
        found.groupBy("id", "item_id", "m")
        .agg(F.array_sort(F.collect_set("p")).alias("ps"), F.collect_set(F.struct("shingle", "times")).alias("kinds"))
        .select("id", "m", "ps", F.expr("aggregate(kinds, 0L, (a, x) -> a + x.times)").alias("shared"), F.expr(needed).alias("k"))
        .where(f"shared * {t.denominator} >= {n} * {t.numerator}")
    )
    # Each k neighbours from the i-th on: the starts of windows around them that those from the one before have not.
    low = f"greatest(0, element_at(ps, i + k - 1) - {n} + 1, if(i > 1, element_at(ps, greatest(i - 1, 1)) + 1, 0))"
    long = (
        pairs.where("shared >= k AND size(ps) >= k")
        .select("id", "m", "ps", "k", F.explode(F.expr("sequence(1, size(ps) - k + 1)")).alias("i"))
        .where(f"element_at(ps, i + k - 1) - element_at(ps, i) < {n}")
        .select("id", "m", F.explode(F.expr(f"sequence({low}, element_at(ps, i))")).alias("s"), F.lit(False).alias("whole"))
    )
    windows = cut(long.union(pairs.select("id", "m", F.lit(0).alias("s"), F.lit(True).alias("whole"))).distinct())

    # 2. Fingerprints of the windows: a text is split once for each run of neighbouring starts, and its shingles are sliced.
    runs = cut(
        windows.groupBy("id", "m", F.expr(f"cast(s div {RUN} AS int)").alias("run"))
        .agg(F.collect_list(F.struct("s", "whole")).alias("starts"), F.min("s").alias("low"), F.max("s").alias("high"))
    )
    light = F.broadcast if windows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df.hint("shuffle_hash")
    held = docs.join(small_side(cut(windows.select("id").distinct())), "id", "left_semi")  # no other text moves
    near_by_words = (
        held.join(light(runs), "id")
        .select("id", "m", "starts", "low", "high", words("text").alias("all"))
        .select("id", "m", "starts", "low", F.size("all").alias("total"), F.expr("slice(all, low + 1, high - low + m)").alias("ws"))
        .withColumn("hs", shingles("ws"))
    )
    fits = "CASE WHEN w.whole THEN total < m ELSE w.s <= total - m END"
    # The shingles are bound once, as the element of an array of one.
    bags = F.expr(
        f"transform(array(hs), h -> transform(filter(starts, w -> {fits}), w -> named_struct('start', cast(w.s AS int), 'bag', slice(h, w.s - low + 1, {n}))))[0]"
    )
    printed = cut(  # also keeps conditions on fingerprints from being pushed, and computed, below them
        near_by_words.select("id", "m", F.explode(bags).alias("w"))
        .select("id", "m", "w.start", "w.bag")
        .withColumn("fingerprint", simhash("bag"))
    )

    # 3. Blocks and their neighbours.
    near = radius // BLOCKS
    all_values = f"sequence(0, {2**BLOCK_BITS - 1})"
    index = known.select(
        "item_id", "m", F.col("fingerprint").alias("item_print"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("k")
    ).select(
        "*", F.explode(F.expr(f"filter({all_values}, v -> bit_count(v ^ cast({block('item_print', 'k')} AS int)) <= {near})")).alias("v")
    )
    keyed = printed.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("k")).select(
        "*", F.expr(f"cast({block('fingerprint', 'k')} AS int)").alias("v")
    )
    apart = "bit_count(fingerprint ^ item_print)"
    first = f"array_min(filter(sequence(0, {BLOCKS - 1}), j -> bit_count({block('(fingerprint ^ item_print)', 'j')}) <= {near}))"
    neighbours = sum(comb(BLOCK_BITS, j) for j in range(near + 1))
    slim = F.broadcast(index) if known.count() * BLOCKS * neighbours <= BROADCAST_ROWS else index
    near_by = keyed.drop("bag").join(slim, ["m", "k", "v"]).where(F.expr(f"{apart} <= {radius} AND {first} = k"))
    candidates = cut(near_by.select("id", "item_id", "m", "start").distinct())

    # 4. The exact similarity, of each candidate once: in the first block that finds it.
    return (
        printed.select("id", "m", "start", "bag")
        .join(small_side(candidates), ["id", "m", "start"])
        .join(small(known.select("item_id", F.col("bag").alias("item_bag"))), "item_id")
        .select("id", "item_id", "start", similarity("bag", "item_bag").alias("similarity"))
        .where(F.col("similarity") >= float(t))
        .groupBy("id", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
        .select(F.col("id").alias(id_col), "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"))
    )


def drop_contaminated(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that no item contaminates, with all their columns; null ids are kept."""
    bad = cut(contaminated(documents, items, id_col=id_col, **options).select(id_col).distinct())
    return documents.join(small_side(bad), id_col, "left_anti").select(*documents.columns)
