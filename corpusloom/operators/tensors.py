"""Norms of low-rank weight differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def low_rank_norm(a: Column, b: Column, rank: int) -> Column:
    """Frobenius norm of B A for row-major A (rank x n) and B (m x rank), through the two Gram matrices, so the
    product is never made: |BA|^2 is the sum of (B'B) * (AA')."""

    @F.pandas_udf("double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(x, y) -> float:
            p, q = np.asarray(x, dtype=np.float64).reshape(rank, -1), np.asarray(y, dtype=np.float64).reshape(-1, rank)
            return float(np.sqrt(max(0.0, ((q.T @ q) * (p @ p.T)).sum())))

        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(xs, ys)], dtype="float64")

    return run(a, b)


def pair_factors(tensors: DataFrame) -> DataFrame:
    """(layer, module, a, b) of tensors (name, data) named ...layers.<n>.<module>.lora_A/B...."""
    named = tensors.select(
        F.regexp_extract("name", r"layers\.(\d+)\.", 1).cast("int").alias("layer"),
        F.regexp_extract("name", r"layers\.\d+\.(.*)\.lora_[AB]", 1).alias("module"),
        F.regexp_extract("name", r"\.lora_([AB])", 1).alias("side"),
        "data",
    ).where("side <> '' AND layer IS NOT NULL")
    a, b = (named.where(F.col("side") == s).select("layer", "module", F.col("data").alias(s.lower())) for s in "AB")
    return a.join(b, ["layer", "module"])


def intensities(norms: DataFrame) -> DataFrame:
    """Adds intensity, the norm over the largest one; the largest is an aggregation of one row."""
    peak = norms.agg(F.max("norm").alias("_peak"))
    return norms.crossJoin(F.broadcast(peak)).withColumn("intensity", F.col("norm") / F.nullif(F.col("_peak"), F.lit(0.0))).drop("_peak")


def hottest(norms: DataFrame) -> DataFrame:
    return norms.orderBy(F.desc("norm"), "layer", "module").limit(1)


def module_counts(names: DataFrame, tower: Column) -> DataFrame:
    """(tower, suffix, n) of module names."""
    return names.groupBy(tower.alias("tower"), F.substring_index("name", ".", -1).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


def extent(norms: DataFrame) -> DataFrame:
    """(n_modules, n_layers): distinct modules, and the last layer's number and one."""
    return norms.agg(F.count_distinct("module").alias("n_modules"), (F.max("layer") + 1).cast("long").alias("n_layers"))


def peak_share(norms: DataFrame, by: str) -> DataFrame:
    """The norm over the largest one of its group."""
    return norms.withColumn("share", F.col("norm") / F.max("norm").over(Window.partitionBy(by)))
