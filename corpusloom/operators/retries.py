"""Asking a model in rounds that commit: rows that fail come back in a later round, and a run that dies goes on where it was.

The answers are a table of their own, a line a request and try. A round asks one share of what has no answer yet and adds its
lines in one commit, so a run that is stopped loses a share's replies at most, and none of them is there twice."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.review import Predictor, asked
from corpusloom.sources import committed, stores

ANSWERS = "request string, try int, reply string, error string"


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(request, try, reply, error) of every try that was committed."""
    return spark.read.schema(ANSWERS).json(path) if stores.exists(path) else spark.createDataFrame([], ANSWERS)


def answered(candidates: DataFrame, keys: list[str], prompt: str, predict: Predictor, path: str, tries: int = 3, shares: int = 4, at_once: int = 64, batch: int = 16, wait: float = 0.0) -> DataFrame:
    """``candidates`` with tries, reply and error: of the last try of each, at most ``tries``. Answers are kept under ``path``;
    what has one there is not asked again. A round asks a part of ``shares`` in ``at_once`` tasks, each a request of ``batch``
    prompts at a time; after a round over all shares, ``wait`` seconds pass before those that failed are asked again.

    Rows of the same keys and prompt, nulls too, are one request and share its answer; a null prompt is asked as ''. An error
    is null once a try has a reply. No candidates: no rows, and nothing is asked."""
    spark = candidates.sparkSession
    request = F.sha2(F.to_json(F.struct(F.struct(*keys).alias("k"), F.col(prompt).alias("p"))), 256)
    wanted = candidates.select(request.alias("request"), F.col(prompt).alias("_prompt")).dropDuplicates(["request"])
    number = idle = 0
    if stores.exists(path):
        committed.recover(path)
    while idle < shares:  # a whole turn of the shares without a request: all is answered
        known = answers(spark, path).groupBy("request").agg(F.max("try").alias("try"), F.bool_or(F.col("error").isNull()).alias("ok"))
        mine = F.pmod(F.xxhash64("request"), F.lit(shares)) == number % shares
        left = wanted.where(mine).join(known.where(mine), "request", "left").where(~F.coalesce("ok", F.lit(False)) & (F.coalesce("try", F.lit(0)) < tries))
        if left.isEmpty():
            idle += 1
        else:
            if wait and left.where("try IS NULL").isEmpty():
                time.sleep(wait)
            idle = 0
            due = left.select("request", (F.coalesce("try", F.lit(0)) + 1).alias("try"), "_prompt").repartition(at_once, "request")
            lines = asked(due, predict, "_prompt", batch).drop("_prompt")
            committed.commit({"answers": (lines, committed.json_line(lines), path)}, path)
        number += 1
    last = answers(spark, path).groupBy("request").agg(F.max("try").alias("tries"), F.max_by(F.struct("reply", "error"), "try").alias("_last"))
    done = candidates.withColumn("request", request).join(last, "request", "left")
    return done.select(*candidates.columns, "tries", "_last.reply", "_last.error")
