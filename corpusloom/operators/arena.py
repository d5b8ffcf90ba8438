"""Blinded comparisons: sheets, keys, unblinding and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.split import hash_sample, side

#: The outcomes of a vote.
WINNERS = ("finetune", "base", "tie", "both_bad")


def blind(df: DataFrame, id_col: str, a: str, b: str, label_a: str, label_b: str) -> DataFrame:
    """``df`` with option_a, option_b, a_is, b_is: the sides are dealt by the parity of a hash, so that a sheet
    can be made again and neither side leads."""
    first = side(F.col(id_col).cast("string"), F.lit(label_a), F.lit(label_b)) == 0
    return (
        df.withColumn("option_a", F.when(first, F.col(a)).otherwise(F.col(b)))
        .withColumn("option_b", F.when(first, F.col(b)).otherwise(F.col(a)))
        .withColumn("a_is", F.when(first, label_a).otherwise(label_b))
        .withColumn("b_is", F.when(first, label_b).otherwise(label_a))
    )


def paired(benchmark: DataFrame, a: DataFrame, b: DataFrame, on: list[str], prediction: str = "prediction") -> DataFrame:
    """The benchmark's rows that both systems have predicted, with a and b: a sheet compares nothing else."""
    sides = [p.select(*on, F.col(prediction).alias(name)) for name, p in (("a", a), ("b", b))]
    return benchmark.join(sides[0], on).join(sides[1], on)


def choice(text: Column) -> Column:
    """a, b, tie or both_bad of what a reviewer wrote; null for all else. Whole words count, so that
    "both bad" is no vote for b."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.rlike("^both|^neither"), "both_bad").when(t.rlike("^t(ie)?$|^tied|^draw"), "tie").when(t.rlike("^(option[ _]?)?a$"), "a").when(t.rlike("^(option[ _]?)?b$"), "b")


def winner(pick: Column, a_is: Column, b_is: Column) -> Column:
    return F.when(pick == "a", a_is).when(pick == "b", b_is).otherwise(pick)


def tally(votes: DataFrame, column: str = "winner", buckets: tuple[str, ...] = WINNERS) -> DataFrame:
    """(winner, n) for all buckets, 0 where there are no votes; others do not count."""
    spark = votes.sparkSession
    all_ = spark.createDataFrame([(w,) for w in buckets], "winner string")
    counted = votes.groupBy(F.col(column).alias("winner")).agg(F.count(F.lit(1)).alias("n"))
    counted = F.broadcast(counted.where(F.col("winner").isin(*buckets)))  # a row for each bucket at most
    return all_.join(counted, "winner", "left").select("winner", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def win_rate(tallied: DataFrame, ours: str = WINNERS[0], theirs: str = WINNERS[1]) -> DataFrame:
    """(decisive, win_rate): null without decisive votes."""
    n = lambda w: F.sum(F.when(F.col("winner") == w, F.col("n")).otherwise(0))
    return tallied.agg((n(ours) + n(theirs)).alias("decisive"), (n(ours) / F.nullif(n(ours) + n(theirs), F.lit(0))).alias("win_rate"))


def bars(tallied: DataFrame, least: int = 4) -> DataFrame:
    """Adds width in percent of the most votes, ``least`` at least. For a tally, which has a few rows."""
    most = F.greatest(F.lit(1), F.max("n").over(Window.partitionBy()))
    return tallied.withColumn("width", F.greatest(F.lit(least), F.round(100 * F.col("n") / most)).cast("int"))


def drawn(briefs: DataFrame, key: Column, seed: str) -> DataFrame:
    """One brief, by the hash of seed and key: another seed draws another one."""
    return hash_sample(briefs, key, 1, seed)


def dealt_arm(session: Column, arms: tuple[str, str] = WINNERS[:2]) -> Column:
    """Which arm a session sees as a, by a hash that its arms do not show."""
    return F.when(side(session, F.lit(arms[0]), F.lit(arms[1])) == 0, arms[0]).otherwise(arms[1])


def pinned(rows: DataFrame, picks: DataFrame, keys: list[str], order: str, most: int = 10_000) -> DataFrame:
    """The picked rows by the picks' order; of rows with one key the one of the largest ``order`` counts. Picks are a short list, broadcast up to ``most`` of them."""
    if picks.limit(most + 1).count() <= most:
        picks = F.broadcast(picks)
    last = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rows.columns if c not in (*keys, order)])).alias("_r"))
    return last.join(picks, keys).select(*picks.columns, "_r.*")
