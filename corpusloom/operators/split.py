"""Deduplication, deterministic splits and samples. Order always comes from hashes and ids, never from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.leakage import assert_empty


def split_dedup(df: DataFrame, category: Column, copy: Column, order: str, eval_size: int = 60, cap: int = 3) -> DataFrame:
    """``df`` with split: the first row of each of the ``eval_size`` keys least by SHA-1 is eval, no other row of
    those keys stays; of every other key the first ``cap`` rows are train. A key is (category, copy); rows
    without copy are never held out.

    The held keys are a top-k over distinct keys (no global window) and are broadcast: their number is
    ``eval_size``."""
    keyed = df.withColumn("_copy", copy).withColumn("_key", F.sha1(F.concat_ws("::", category, F.col("_copy"))))
    held = F.broadcast(keyed.where("_copy <> ''").select("_key").distinct().orderBy("_key").limit(eval_size)).withColumn("_held", F.lit(True))
    first = Window.partitionBy("_key").orderBy(order)
    return (
        keyed.withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= max(cap, 1))
        .join(held, "_key", "left")
        .where((F.col("_held") & (F.col("_n") == 1)) | (F.col("_held").isNull() & (F.col("_n") <= cap)))
        .withColumn("split", F.when(F.col("_held"), "eval").otherwise("train"))
        .drop("_key", "_copy", "_n", "_held")
    )


def shared_keys(df: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """(key) in more than one split; empty for splits without leaks."""
    return df.groupBy(key.alias("key")).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1").select("key")


def first_by(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The row of each key with the least ``order``, chosen by a map-side combined aggregation; of rows that are equal in
    both any fixed one."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.min_by(F.struct(*df.columns), F.struct(F.col(order), F.xxhash64(*df.columns)))
    return df.groupBy(*named).agg(row.alias("_row")).select("_row.*")


def hash_sample(df: DataFrame, key: Column, n: int, seed: str) -> DataFrame:
    """The ``n`` rows with the least SHA-1 of seed and key: a sample that every engine repeats."""
    return df.withColumn("_h", F.sha1(F.concat(F.lit(seed), key.cast("string")))).orderBy("_h").limit(n).drop("_h")


def side(key: Column, a: Column, b: Column) -> Column:
    """0 or 1 by the parity of the SHA-1 of key, a and b."""
    return (F.conv(F.right(F.sha1(F.concat_ws("|", key, a, b)), F.lit(1)), 16, 10).cast("int") % 2).cast("int")


def hash_split(key: Column, share: float, seed: str) -> Column:
    """'test' for about ``share`` of the keys, else 'train'."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(share * 10_000), "test").otherwise("train")


def capped(df: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


#: Rows that ``cycled`` may broadcast.
BROADCAST_ROWS = 1_000_000


def cycled(df: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows: those of a table over and over, by an ``order`` without ties."""
    size = df.count()
    if not size:
        return df
    rows = ranked(df, order, "_i").withColumn("_i", F.col("_i") - 1)
    slots = df.sparkSession.range(n).select((F.col("id") % size).alias("_i"), F.col("id").alias("slot"))
    return slots.join(F.broadcast(rows) if size <= BROADCAST_ROWS else rows, "_i").drop("_i")


def pages(df: DataFrame, order: str, size: int = 4) -> DataFrame:
    """Adds page, counted from 0, by an ``order`` without ties."""
    return ranked(df, order, "_i").withColumn("page", F.floor((F.col("_i") - 1) / size).cast("int")).drop("_i")


def by_position(a: DataFrame, order_a: str, b: DataFrame, order_b: str, agree: tuple[str, str] | None = None) -> DataFrame:
    """Rows of two tables by rank. Ranks come from value ranges and their counts, so neither table is gathered in one
    task. ``agree``: a column of either table that have to be equal in every pair; else GateError."""
    both = ranked(a, order_a, "_at").join(ranked(b, order_b, "_at"), "_at").withColumnRenamed("_at", "position")
    if agree is not None:
        assert_empty(both.where(~F.col(agree[0]).eqNullSafe(F.col(agree[1]))).select("position", *agree), f"{agree[0]} and {agree[1]} differ")
    return both


def ranges(df: DataFrame, order: str, buckets: int = 256, sample: int = 4096) -> Column:
    """The number of the range, of ``buckets`` about equally full ones, that ``order`` lies in. Bounds are quantiles of a
    sample of distinct values, the first by their hash, so values of any type and spread are dealt evenly."""
    some = df.select(F.col(order).alias("v")).where("v IS NOT NULL").distinct().orderBy(F.xxhash64("v")).limit(sample)
    values = sorted(r["v"] for r in some.collect())  # at most ``sample`` values
    bounds = values[:: max(1, len(values) // buckets)]
    if not bounds:
        return F.lit(0)
    kind = df.schema[order].dataType
    listed = F.array(*[F.lit(v).cast(kind) for v in bounds])
    return F.size(F.filter(listed, lambda b: b <= F.col(order)))


def ranked(df: DataFrame, order: str, name: str, buckets: int = 256) -> DataFrame:
    """Adds the rank, from 1, of each row by an ``order`` without ties, of any type that sorts."""
    cut = df.withColumn("_b", ranges(df, order, buckets))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over a few hundred rows
    offsets = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(order)
    return (
        cut.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(offsets), "_b")
        .withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_r", "_before")
    )
