"""Throughput, cost and rate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import wilson
from corpusloom.operators.leakage import GateError, assert_empty
from corpusloom.operators.split import ranges


def run_summary(rows: DataFrame, prompt: str, completion: str, valid: Column, changed: Column, elapsed_s: float, load_s: float, usd_per_hour: float) -> DataFrame:
    """One row: counts, tokens, strings an hour, money a thousand strings and money measured."""
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n = rows.agg(
        F.count(F.lit(1)).alias("strings"), F.coalesce(F.sum(prompt), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(completion), F.lit(0)).alias("completion_tokens"), flag(valid).alias("valid_json"), flag(changed).alias("changed"),
    )
    per_hour = F.col("strings") / elapsed_s * 3600 if elapsed_s else F.lit(0.0)
    return n.select(
        "*",
        (F.col("strings") - F.col("changed")).alias("kept"),
        F.round(per_hour).cast("long").alias("strings_per_hour"),
        F.round(1000 / F.nullif(per_hour, F.lit(0.0)) * usd_per_hour, 2).alias("usd_per_1k_strings"),
        F.lit(round((elapsed_s + load_s) / 3600 * usd_per_hour, 2)).alias("measured_usd"),
    )


def at_list_prices(run: DataFrame, prices: DataFrame) -> DataFrame:
    """What one run's tokens cost by each price (model, input, output per million), the cheapest first. Both are small."""
    usd = F.round(F.col("prompt_tokens") / 1e6 * F.col("input") + F.col("completion_tokens") / 1e6 * F.col("output"), 2)
    return (
        prices.crossJoin(F.broadcast(run)).withColumn("usd", usd)
        .select(
            "model", "usd", F.round(F.col("usd") / F.nullif(F.col("strings"), F.lit(0)) * 1000, 2).alias("usd_per_1k_strings"),
            F.round(F.col("usd") / F.nullif(F.col("measured_usd"), F.lit(0.0)), 1).alias("multiple"),
        ).orderBy("usd", "model")
    )


def complete_runs(runs: DataFrame) -> DataFrame:
    """The runs; GateError if one is the checkpoint of an unfinished run."""
    assert_empty(runs.where(~F.coalesce("complete", F.lit(False))), "unfinished runs")
    return runs


def running_totals(batches: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Adds running sums in an order without ties: inside ranges of ``order``, plus the sums of the ranges before."""
    cut = batches.withColumn("_b", ranges(batches, order))
    sums = cut.groupBy("_b").agg(*[F.sum(c).alias(f"_s{k}") for k, c in enumerate(columns)])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over a few hundred rows
    offsets = sums.select("_b", *[F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in range(len(columns))])
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(offsets), "_b")
    return joined.select(*batches.columns, *[(F.sum(c).over(inside) + F.col(f"_o{k}")).alias(f"total_{c}") for k, c in enumerate(columns)])


def ok_of_total(df: DataFrame, bucket: Column, ok: Column) -> DataFrame:
    """(bucket, ok, total) by class of failure; rows without a class do not count."""
    return df.select(bucket.alias("bucket"), ok.alias("_ok")).where("bucket IS NOT NULL").groupBy("bucket").agg(
        F.count_if("_ok").alias("ok"), F.count(F.lit(1)).alias("total")
    )


def assert_counts(df: DataFrame, label: str, expected: dict[str, int], anchors: tuple[str, list[str]] | None = None) -> None:
    """GateError unless every label occurs as often as expected, and all anchors occur in their column: a sample that was
    drawn again is the same one."""
    seen = {r["l"]: r["n"] for r in df.where(F.col(label).isin(*expected)).groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    off = {k: (n, seen.get(k, 0)) for k, n in expected.items() if seen.get(k, 0) != n}
    if off:
        raise GateError(f"counts drifted (expected, found): {off}")
    if anchors is not None:
        column, wanted = anchors
        there = {r["v"] for r in df.where(F.col(column).isin(*wanted)).select(F.col(column).alias("v")).distinct().collect()}
        if set(wanted) - there:
            raise GateError(f"anchors missing: {sorted(set(wanted) - there)}")


def rates(df: DataFrame, by: list[str], hit: Column, population: Column | None = None) -> DataFrame:
    """(x, n, share, low, high) by group with the Wilson interval; with a population also what it scales to."""
    out = df.groupBy(*by).agg(F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("x"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("x"), F.col("n"))
    out = out.withColumns({"share": F.col("x") / F.col("n"), "low": low, "high": high})
    if population is None:
        return out
    return out.withColumns({f"scaled_{c}": F.round(F.col(c) * population).cast("long") for c in ("share", "low", "high")})


def rollup_prefix(df: DataFrame, label: str, prefix: str) -> DataFrame:
    """(label counts, and those of labels with a prefix together)."""
    one = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    together = one.where(F.col("label").startswith(prefix)).agg(F.lit(f"{prefix}*").alias("label"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return one.union(together)
