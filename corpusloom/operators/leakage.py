"""Leak and duplicate gates: copied phrases, content hashes, denylists, resumed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import stem
from corpusloom.operators.phrases import holding


class GateError(RuntimeError):
    """A gate that has to be empty is not."""


def copies_source(df: DataFrame, sources: DataFrame, id_col: str, text: str = "text", source_text: str = "text", n: int = 14) -> DataFrame:
    """(id) of the rows that hold an n-word phrase of a source."""
    return holding(df, sources, id_col, text, source_text, n)


def collisions(df: DataFrame, known: DataFrame, content: str, known_content: str, known_path: str) -> DataFrame:
    """The rows whose content's SHA-256 is that of a known row, with ``matched``: the first path of such a row."""
    paths = known.groupBy(F.sha2(F.col(known_content), 256).alias("_h")).agg(F.min(known_path).alias("matched"))
    return df.withColumn("_h", F.sha2(F.col(content), 256)).join(paths, "_h").drop("_h")


def same_content(df: DataFrame, known: DataFrame, content: str, known_content: str) -> DataFrame:
    """The rows whose content's SHA-256 is that of a known row."""
    hashes = known.select(F.sha2(F.col(known_content), 256).alias("_h")).distinct()
    return df.withColumn("_h", F.sha2(F.col(content), 256)).join(hashes, "_h", "left_semi").drop("_h")


def denied(df: DataFrame, denylist: list[str], path: Column, substrate: Column) -> DataFrame:
    """``df`` with by_name (the path's stem is on the list) and by_substrate (the text names an entry),
    rows with neither left out. The list is a literal of a few entries, so no join is needed."""
    low = F.lower(F.coalesce(substrate, F.lit("")))
    denylist = [entry.lower() for entry in denylist]
    by_text = F.lit(False)
    for entry in denylist:
        by_text = by_text | low.contains(entry)
    return (
        df.withColumn("by_name", F.coalesce(F.lower(stem(path)).isin(*denylist), F.lit(False)))
        .withColumn("by_substrate", by_text).where("by_name OR by_substrate")
    )


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of an interrupted run."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def missing(wanted: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Referenced keys that the index does not have."""
    return wanted.select(key).distinct().join(index, key, "left_anti")


def assert_empty(df: DataFrame, what: str) -> None:
    """Fails closed if ``df`` has rows."""
    rows = df.take(3)
    if rows:
        raise GateError(f"{what}: {rows}")


def by_priority(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables by key; of rows with one key that of the first table stays."""
    union = None
    for k, t in enumerate(tables):
        part = t.withColumn("_p", F.lit(k))
        union = part if union is None else union.unionByName(part)
    value = [c for c in union.columns if c not in (key, "_p")]
    return union.groupBy(key).agg(F.min(F.struct("_p", *value)).alias("_m")).select(key, *[F.col(f"_m.{c}").alias(c) for c in value])
