"""Running tallies of an append-only stream of votes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_tally(stream: DataFrame, winner: str = "winner") -> DataFrame:
    """(winner, n) so far; write it in complete or update mode. The state is a row for each winner."""
    return stream.groupBy(F.col(winner).alias("winner")).agg(F.count(F.lit(1)).alias("n"))


def windowed_tally(stream: DataFrame, ts: str, late: str, width: str, winner: str = "winner") -> DataFrame:
    """(start, winner, n) by windows of event time. Written in append or update mode, votes later than ``late`` are left out
    and their state is dropped; complete mode keeps the state of all windows."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = timed.groupBy(F.window("_ts", width), F.col(winner).alias("winner")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "winner", "n")


def drained(query_of: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """What the stream gives once all that is there now has been read."""
    name = f"drained_{uuid.uuid4().hex}"
    writer = query_of.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return query_of.sparkSession.table(name)
