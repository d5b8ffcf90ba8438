import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import committed, readers, stores, writers


def rows(spark, low, high, parts=4):
    return spark.range(low, high, 1, parts).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("é\n"), "id").alias("text"))


def visible(path):
    return sorted(f for f in os.listdir(path) if not f.startswith(("_", "."))) if os.path.isdir(path) else []


def ids(spark, path):
    return sorted(int(r.id) for r in spark.read.schema("id string, text string").json(path).collect())


def broken(df, at):
    """Fails in the task of one row, after others have written."""
    return df.withColumn("text", F.when(F.col("id") == str(at), F.raise_error(F.lit("killed"))).otherwise(F.col("text")))


def test_a_failed_job_leaves_nothing_and_a_retry_adds_each_row_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    writers.append_missing(rows(spark, 0, 10), path, "id")
    before = visible(path)
    with pytest.raises(Exception, match="killed"):
        writers.append_missing(broken(rows(spark, 5, 40), 39), path, "id")
    assert visible(path) == before and not [f for f in os.listdir(path) if f.startswith(committed.STAGED)]
    for _ in range(2):
        writers.append_missing(rows(spark, 5, 40), path, "id")
    assert ids(spark, path) == list(range(40))
    assert [r.rows["rows"] for r in committed.jobs(spark, path).collect() if r.rows["rows"]].__len__() == 2
    assert {r.text for r in readers.jsonl(spark, path, "id string, text string").collect()} == {f"é\n{k}" for k in range(40)}


def test_a_named_job_is_done_once(spark, tmp_path):
    path, df = str(tmp_path / "sink"), rows(spark, 0, 7)
    for _ in range(3):
        committed.commit({"rows": (df, committed.json_line(df), path)}, path, job="night-7")
    assert ids(spark, path) == list(range(7))


def test_recovery_before_and_after_the_record(spark, tmp_path):
    path = tmp_path / "sink"
    writers.append_missing(rows(spark, 0, 3), str(path), "id")
    # A driver that died before its record: hidden files, which the next writer removes.
    dead = path / f"{committed.STAGED}dead"
    dead.mkdir()
    (dead / "part-0.json").write_text('{"id":"77","text":"x"}\n')
    assert ids(spark, str(path)) == [0, 1, 2]
    # One that died between its record and the second of two moves.
    late = path / f"{committed.STAGED}late"
    late.mkdir()
    (late / "b.json").write_text('{"id":"9","text":"x"}\n')
    (path / "a.json").write_text('{"id":"8","text":"x"}\n')
    moves = [[str(late / f), str(path / f)] for f in ("a.json", "b.json")]
    (path / committed.LOG / "late.json").write_text(json.dumps({"job": "late", "rows": {"rows": 2}, "removes": [], "moves": moves, "staged": [str(late)]}))
    writers.append_missing(rows(spark, 0, 10), str(path), "id")
    assert ids(spark, str(path)) == list(range(10)) and not dead.exists() and not late.exists()
    assert sum(r.rows["rows"] for r in committed.jobs(spark, str(path)).collect()) == 10


def test_a_sheet_and_its_key_are_one_commit(spark, tmp_path):
    sheet, key = str(tmp_path / "sheet"), str(tmp_path / "key")
    make = lambda n: spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit('say "a",\nb').alias("option_a"), F.lit("").alias("option_b"), F.lit("base").alias("a_is"), F.lit("new").alias("b_is"))
    writers.sheets(make(3), sheet, key, "id", [])
    bad = make(9).withColumn("b_is", F.when(F.col("id") == "8", F.raise_error(F.lit("killed"))).otherwise("x"))
    with pytest.raises(Exception, match="killed"):
        writers.sheets(bad, sheet, key, "id", [])
    assert readers.csv(spark, sheet).count() == readers.csv(spark, key).count() == 3
    writers.sheets(make(5), sheet, key, "id", [])
    got = readers.csv(spark, sheet).join(readers.csv(spark, key), "id").orderBy("id").collect()
    assert len(got) == 5 and got[0].option_a == 'say "a",\nb' and got[0].b_is == "new"


def test_paths():
    assert stores.at("file:/tmp/x")[1] == stores.at("file:///tmp/x")[1] == stores.at("/tmp/x")[1] == "/tmp/x"
    assert stores.reachable("/tmp") and not stores.reachable("viewfs://store/x")
