"""Predictions of a model behind a narrow boundary: what is asked, how replies are read, and what a failure becomes.

A predictor is a function from a list of prompts to a list of replies (strings). It runs over Arrow batches on the
executors, so that rows are asked in parallel and nothing is gathered; a predictor that fails on a batch is asked row
by row, and a row that fails keeps the run going with the reason in its ``risk``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.functions.contract import bound, last_object, object_text
from corpusloom.operators.extract import escape

Predictor = Callable[[list[str]], list[str]]
#: Risks that a run records.
NOT_JSON, FAILED, ESCAPE = "Model returned non-JSON output.", "endpoint_error", "contract_escape"


def identity(prompts: list[str]) -> list[str]:
    """A predictor that keeps the copy."""
    import json

    return [json.dumps({"rewrite": p, "reason": "kept", "risk": ""}) for p in prompts]


def _ask(predict: Predictor, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt."""
    try:
        replies = predict(prompts) if len(prompts) > 1 else []  # a single one is asked below, and not twice
        if replies and len(replies) == len(prompts):
            return [(r, None) for r in replies]
    except Exception:  # noqa: BLE001
        pass
    out = []
    for p in prompts:
        try:
            (reply,) = predict([p])
            out.append((reply, None))
        except Exception as e:  # noqa: BLE001
            out.append((None, f"request failed: {e}"))
    return out


def asked(df: DataFrame, predict: Predictor, prompt: str, batch: int = 16) -> DataFrame:
    """``df`` with reply and error, one of which is null; ``batch`` prompts are asked together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts = frame[prompt].fillna("").tolist()
            got = [x for k in range(0, len(prompts), batch) for x in _ask(predict, prompts[k : k + batch])]
            yield frame.assign(reply=[r for r, _ in got], error=[e for _, e in got])

    schema = StructType([*df.schema.fields, StructField("reply", StringType()), StructField("error", StringType())])
    return df.mapInPandas(run, schema)


def predictions(replies: DataFrame) -> DataFrame:
    """``replies`` (reply, error) with rewrite, reason, risk: of the last valid object in a reply; a reply without one
    is the reason itself, and a failed request says so. A rewrite that is code has the risk contract_escape."""

    @F.pandas_udf("rewrite string, reason string, risk string")
    def read(s: pd.Series) -> pd.DataFrame:
        rows = []
        for text in s:
            o = last_object(text)
            rows.append((o["rewrite"], o["reason"] or "", o["risk"] or "") if o["ok"] else ("", text, NOT_JSON))
        return pd.DataFrame(rows, columns=["rewrite", "reason", "risk"])

    failed = F.col("error").isNotNull()
    pick = lambda c, other: F.when(failed, other).otherwise(F.coalesce(F.col("_r")[c], F.lit("")))
    out = replies.withColumn("_r", read("reply"))
    out = out.withColumns({"rewrite": pick("rewrite", F.lit("")), "reason": pick("reason", F.col("error")), "risk": pick("risk", F.lit(FAILED))}).drop("_r")
    return out.withColumn("risk", F.when(escape(F.col("rewrite")), ESCAPE).otherwise(F.col("risk")))


def review(candidates: DataFrame, prompt: str, predict: Predictor | None = None, batch: int = 16) -> DataFrame:
    """``candidates`` with suggested_copy, reason, risk. Without a predictor nothing is asked and nothing suggested."""
    if predict is None:
        return candidates.withColumns({"suggested_copy": F.lit(""), "reason": F.lit("Dry run: no predictor."), "risk": F.lit("")})
    done = predictions(asked(candidates, predict, prompt, batch))
    return done.withColumnRenamed("rewrite", "suggested_copy").drop("reply", "error")


def replied(reply: Column) -> Column:
    """struct<rewrite, reason, risk> of a benchmark's reply, which as a whole has to be an object."""
    whole = F.from_json(object_text(reply), "rewrite string, reason string, risk string")
    plain = F.struct(F.lit("").alias("rewrite"), F.coalesce(reply, F.lit("")).alias("reason"), F.lit(NOT_JSON).alias("risk"))
    return bound(whole, lambda v: F.when(v.isNotNull(), v).otherwise(plain))
