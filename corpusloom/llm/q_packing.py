"""Query of the packing operator. SQL cannot tokenise; tests/llm/test_packing.py holds it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import packing
from corpusloom.llm.common import table


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), tighten=True)
