"""Query of the SimHash near duplicates. DuckDB has no XXH64 with a seed; tests/llm/test_simhash_trie.py holds it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import table
from corpusloom.llm.simhash_trie import classes, hexed


def op12_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), radius=3, size=3)
    return found.select("doc_id", hexed("print").alias("fingerprint"), "component_id")
