import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import sessions

VOTE = "session string, vote string, winner string, ts timestamp"
START = dt.datetime(2026, 1, 1, 12)


def votes(spark, low, high, minute=0):
    rows = [(f"s{k % 5}", f"v{k}", "abc"[k % 3], START + dt.timedelta(minutes=minute + k / 10)) for k in range(low, high)]
    return spark.createDataFrame(rows, VOTE)


def put(df, folder, name):
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}-tmp")
    (part,) = [f for f in os.listdir(f"{folder}-tmp") if f.startswith("part")]
    os.makedirs(folder, exist_ok=True)
    shutil.copy(f"{folder}-tmp/{part}", f"{folder}/{name}.parquet")


def counts(spark, path):
    return {r.winner: r.n for r in sessions.totals(spark, path).collect()}


def expected(n):
    return {w: sum(1 for k in range(n) if "abc"[k % 3] == w) for w in "abc"}


@pytest.mark.parametrize("shares", [1, 4])
def test_opened_replayed_and_resumed(spark, tmp_path, shares):
    folder, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    calls = []

    def scan():
        calls.append(1)
        return votes(spark, 0, 40).union(votes(spark, 0, 10))

    def run():
        stream = spark.readStream.schema(VOTE).option("maxFilesPerTrigger", 1).parquet(folder)
        sessions.resume(stream, path, checkpoint, scan, late="1 hour", shares=shares)

    put(votes(spark, 30, 60), folder, "a")  # ten of them were counted by the scan
    run()
    assert counts(spark, path) == expected(60) and calls == [1]
    put(votes(spark, 30, 60), folder, "b")  # the same votes in another file
    put(votes(spark, 55, 70), folder, "c")
    run()
    assert counts(spark, path) == expected(70) and calls == [1]  # the scan is not read again
    run()
    assert counts(spark, path) == expected(70)


def test_ids_are_forgotten_by_a_timer_and_late_copies_left_out(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema(VOTE).option("maxFilesPerTrigger", 1).parquet(folder)
        sessions.resume(stream, path, checkpoint, lambda: votes(spark, 0, 0), late="5 minutes")

    put(votes(spark, 0, 20), folder, "a")
    run()
    put(votes(spark, 100, 110, minute=60), folder, "b")  # an hour on: the watermark passes all earlier votes
    run()
    put(votes(spark, 200, 201, minute=120), folder, "c")
    run()
    state = spark.read.format("statestore").option("stateVarName", "tally").load(checkpoint)
    held = state.select(F.explode("value.ids").alias("id")).collect()
    assert not {r.id for r in held} & {f"v{k}" for k in range(20)}
    put(votes(spark, 0, 20), folder, "d")  # a copy of forgotten votes comes late
    run()
    want = [*range(20), *range(100, 110), 200]
    assert counts(spark, path) == {w: sum("abc"[k % 3] == w for k in want) for w in "abc"}


def test_states_are_as_many_as_buckets_whatever_the_sessions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sessions, "BUCKETS", 3, raising=False)
    folder, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    every = [(f"s{k % 60}", f"v{k % 97}", "abc"[k % 3], START + dt.timedelta(seconds=k)) for k in range(600)]

    def run(low, high, name):
        put(spark.createDataFrame(every[low:high], VOTE), folder, name)
        stream = spark.readStream.schema(VOTE).option("maxFilesPerTrigger", 1).parquet(folder)
        sessions.resume(stream, path, checkpoint, lambda: spark.createDataFrame(every[:250], VOTE), late="1 hour", shares=2)

    run(200, 400, "a")
    run(300, 600, "b")
    first = {}
    for session, vote, winner, _ in every:
        first.setdefault((session, vote), winner)  # sessions of a state may hold votes of the same id
    assert counts(spark, path) == {w: sum(x == w for x in first.values()) for w in "abc"}
    state = spark.read.format("statestore").option("stateVarName", "tally").load(checkpoint)
    assert state.count() <= 6
    assert state.select(F.explode("value.ids")).count() == len(first)
