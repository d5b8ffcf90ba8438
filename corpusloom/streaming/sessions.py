"""A tally of votes that opens from what was counted before, counts each vote once and resumes.

Sessions share a state by the hash of their name, ``BUCKETS`` of them in all, so that the calls to the state follow the votes and
not the sessions. The state of a bucket, or of a share of its votes where ``shares`` is over one, is what its sessions have counted
and the ids that they have counted lately. It is opened from a batch scan in the first micro-batch of a checkpoint; from then on the
checkpoint is all that a restart needs, and no earlier vote is read again. A vote whose id its session has counted, be it in the scan,
in an earlier file or in a copy of one, counts once. Ids are forgotten, by a timer, ``late`` and at most an eighth of that after the
last time that they could come again: a vote that is later than the watermark is left out, so a copy of a forgotten one is too."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The setting for the state that processors of their own need, and how many states the sessions share. A checkpoint
#: belongs to its number of buckets.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
BUCKETS = 2048
#: Sessions one after another: how many winners and ids each has, then those of all. ``due`` is the time of the one timer.
_STATE = "sessions array<string>, n_winners array<int>, n_ids array<int>, winners array<string>, counts array<bigint>, ids array<string>, times array<bigint>, due bigint"
_OUT = {"session": "object", "share": "int32", "winner": "object", "n": "int64"}


class SessionTally(StatefulProcessor):
    def __init__(self, late_ms: int):
        self.late, self.step = late_ms, max(1, late_ms // 8)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tally", _STATE)

    def _opened(self) -> tuple[dict[str, tuple[Counter, dict[str, int]]], int | None]:
        """Of each session the counts and the ids with their times; and the timer."""
        held = self.state.get()
        if held is None:
            return {}, None
        names, n_winners, n_ids, winners, counts, ids, times, due = held
        counted, seen = iter(zip(winners, counts)), iter(zip(ids, times))
        return {s: (Counter(dict(islice(counted, w))), dict(islice(seen, i))) for s, w, i in zip(names, n_winners, n_ids)}, due

    def _closed(self, tallies: dict[str, tuple[Counter, dict[str, int]]], due: int | None) -> None:
        """One timer, for the oldest id, at the next of eight steps of ``late``; it is only touched when it moves."""
        counts, seen = [c for c, _ in tallies.values()], [s for _, s in tallies.values()]
        times = [t for s in seen for t in s.values()]
        new = -(-(min(times) + self.late) // self.step) * self.step if times else None
        if new != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if new is not None:
                self.handle.registerTimer(new)
        self.state.update((
            list(tallies), [len(c) for c in counts], [len(s) for s in seen], [w for c in counts for w in c], [n for c in counts for n in c.values()],
            [v for s in seen for v in s], times, new,
        ))

    def _counted(self, rows: pd.DataFrame, tallies: dict[str, tuple[Counter, dict[str, int]]]) -> set[str]:
        """Counts the new votes and returns the sessions of all."""
        names = rows["session"].tolist()
        for session, vote, winner, ms in zip(names, rows["vote"].tolist(), rows["winner"].tolist(), rows["ms"].tolist()):
            if session not in tallies:
                tallies[session] = (Counter(), {})
            counts, seen = tallies[session]
            if vote not in seen:
                counts[winner] += 1
            seen[vote] = max(int(ms), seen.get(vote, int(ms)))
        return set(names)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        tallies, due = self._opened()
        self._counted(initialState, tallies)
        self._closed(tallies, due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tallies, due = self._opened()
        changed = set().union(*(self._counted(batch, tallies) for batch in rows))
        self._closed(tallies, due)
        # All winners of the session in this share: an opened one is told with the first vote that follows.
        out = [(s, key[1], w, n) for s in changed for w, n in tallies[s][0].items()]
        yield pd.DataFrame(out, columns=list(_OUT)).astype(_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tallies, due = self._opened()
        edge = timerValues.getCurrentWatermarkInMs() - self.late
        self._closed({s: (counts, {v: t for v, t in seen.items() if t > edge}) for s, (counts, seen) in tallies.items()}, due)
        yield pd.DataFrame({c: pd.Series(dtype=kind) for c, kind in _OUT.items()})

    def close(self) -> None:
        pass


def _shared(votes: DataFrame, shares: int) -> DataFrame:
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    session = F.col("session").cast("string")
    return votes.withColumn("ts", F.col("ts").cast("timestamp")).select(
        dealt(session, BUCKETS).alias("bucket"), session.alias("session"), dealt("vote", shares).alias("share"),
        F.col("vote").cast("string").alias("vote"), "winner", "ts", F.unix_millis("ts").alias("ms"),
    )


def tally(stream: DataFrame, opened: DataFrame | None, late: str = "1 hour", shares: int = 1) -> DataFrame:
    """(session, share, winner, n so far) of a stream of votes (session, vote, winner, ts), in update mode. ``opened`` has the
    votes that were counted before, of the same columns; a stream that resumes needs none."""
    spark = stream.sparkSession
    spark.conf.set(*PROVIDER)
    ms = int(spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL {late})").alias("ms")).first()["ms"])
    first = None if opened is None else _shared(opened, shares).select("bucket", "share", "session", "vote", "winner", "ms").groupBy("bucket", "share")
    return (
        _shared(stream, shares).withWatermark("ts", late).groupBy("bucket", "share")
        .transformWithStateInPandas(
            statefulProcessor=SessionTally(ms), outputStructType="session string, share int, winner string, n bigint",
            outputMode="Update", timeMode="EventTime", initialState=first,
        )
    )


def resume(stream: DataFrame, path: str, checkpoint: str, scan: Callable[[], DataFrame], late: str = "1 hour", shares: int = 1, **trigger) -> None:
    """Counts all that the stream has now (or as ``trigger`` says) into ``path``, one folder for each micro-batch, so that a
    batch that is run again is there once. ``scan`` gives the votes of before, of which a new checkpoint is opened and whose counts
    are written as a batch of their own; it is not called where there is a checkpoint."""
    spark = stream.sparkSession
    new = not _begun(spark, checkpoint)
    opened = scan() if new else None
    if opened is not None:
        counts = _shared(opened, shares).dropDuplicates(["session", "share", "vote"]).groupBy("session", "share", "winner").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counted = tally(stream, opened, late, shares).writeStream.foreachBatch(step).outputMode("update")
    counted.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def _begun(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a checkpoint has a micro-batch that was planned."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(files.exists(at) and files.listStatus(at))


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(winner, n): counts only grow, so the largest of each share is its last."""
    schema = "session string, share int, winner string, n bigint, batch int"
    last = spark.read.schema(schema).option("basePath", path).parquet(path).groupBy("session", "share", "winner").agg(F.max("n").alias("n"))
    return last.groupBy("winner").agg(F.sum("n").alias("n"))
