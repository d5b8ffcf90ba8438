"""Sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.leakage import not_done
from corpusloom.operators.rows import storage
from corpusloom.sources import committed, stores


def jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, replacing what was there; characters are not escaped."""
    df.write.mode("overwrite").json(path)


def append_missing(df: DataFrame, path: str, key: str, job: str | None = None) -> None:
    """Appends the rows whose key the sink does not have, so that an interrupted run can go on: all of them in one commit, so a
    job that fails leaves none of its rows, and a retry adds each once. A ``job`` that was committed adds nothing."""
    spark = df.sparkSession
    if stores.reachable(path):
        committed.recover(path)
    try:
        df = not_done(df, spark.read.json(path), key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    if stores.reachable(path):
        committed.commit({"rows": (df, committed.json_line(df), path)}, path, job)
    else:  # a store that only Spark reaches: its own committer moves files task by task
        df.write.mode("append").json(path)


def by_split(rows: DataFrame, path: str) -> None:
    """Storage rows, a folder for each split and task, which readers prune."""
    storage(rows).write.mode("overwrite").partitionBy("split", "task").parquet(path)


def sheets(blinded: DataFrame, sheet: str, key: str, id_col: str, shown: list[str]) -> None:
    """A blind sheet with empty columns to fill in, and its key, replacing what was there: both in one commit, so a sheet never
    meets the key of another one."""
    page = blinded.select(id_col, *shown, "option_a", "option_b", F.lit("").alias("preferred"), F.lit("").alias("why"))
    answers = blinded.select(id_col, "a_is", "b_is")
    tables = {n: (df, committed.csv_line(*df.columns), path) for n, df, path in (("sheet", page, sheet), ("key", answers, key))}
    committed.commit(tables, sheet, heads={"sheet": ",".join(page.columns), "key": ",".join(answers.columns)}, ending=".csv", replace=True)


def report(one_row: DataFrame, path: str) -> None:
    """A report of one row as a JSON document."""
    one_row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small table as Markdown."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def checkpointed(stream: DataFrame, path: str, checkpoint: str, summary: Callable[[DataFrame, int], None] | None = None):
    """Writes each micro-batch, to a folder of its number, and hands it to ``summary``; started again with the same
    checkpoint it goes on, and a batch that is run twice is there once."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if summary is not None:
            summary(batch, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
