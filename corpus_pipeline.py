"""The training-data pipeline: documents in, packed sequences out.

Each stage is a function (spark, docs, sf_dir) to a DataFrame, of which ``run`` writes the rows as Parquet in
the folder that spark.checkpoint.dir names, and reads them again as the next stage's documents. All stages
but the last return the columns of the documents they were given, those of other names included.

Null, empty and other texts without n-grams pass every filter; null and empty ones are packed as documents of the end id
alone. Rows without a doc_id end in the near-duplicate stage; of repeated rows, and of rows that repeat an id, one
stays; an empty table packs into nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, jaccard_join, packing, pii, quality
from corpusloom.llm.common import cut, ensure_checkpoint_dir, small_side, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the Gumbel top-k of the importance weights."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group that links of 0.8 between five-word shingles join."""
    kept = jaccard_join.keep_first(docs, shingle_words=5, num=4, den=5)
    again = small_side(cut(kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")))
    row = F.min_by(F.struct(*kept.columns), F.xxhash64("text"))  # only rows of repeated ids are shuffled
    one = kept.join(again, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("key")).agg(row.alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*kept.columns).union(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window that an item of the benchmark matches."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    masked = pii.mask_pii(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), tighten=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the join and the tokeniser are no SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
