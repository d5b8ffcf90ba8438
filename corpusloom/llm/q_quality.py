"""Query of the quality classifier; tests/llm/test_quality.py holds weights and rows against brute force and measures held-out labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import quality
from corpusloom.llm.common import cut, table


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    weighed = cut(quality.weigh(documents, model))
    edge = quality.edge_of(weighed, quality.size_of(weighed, model))
    return weighed.select("doc_id", "log_weight", "key", quality.in_top(edge).cast("int").alias("kept"))
