"""Query of the toxicity scorer; tests/llm/test_toxicity.py measures its held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import toxicity as T
from corpusloom.llm.common import table


def _held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def op10_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = T.train(documents, table(spark, sf_dir, "labels").where(~_held_out("doc_id")))
    located = F.transform("sentences", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return T.score(documents, model).select(
        "doc_id",
        _held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.array_join(located, ",").alias("offending"),
    )
