"""Query of the media columns; tests/llm/test_progressive_jpeg.py holds them against round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import table
from corpusloom.llm.progressive_jpeg import media_features, store_texts


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_texts(table(spark, sf_dir, "documents")))
