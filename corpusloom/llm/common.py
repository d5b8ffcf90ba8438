"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids that a join may broadcast (16 bytes each); beyond, it shuffles.
BROADCAST_ROWS = 2_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; set a local folder only where none is set (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (a cut table of a few narrow columns) as a side of a join: broadcast if it has at most ``most`` rows, else
    hashed after a shuffle, of which the adaptive planner splits uneven partitions of the other side."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("shuffle_hash")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
