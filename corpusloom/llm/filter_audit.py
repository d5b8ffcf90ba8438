"""Audit of how filters interact, whatever the order in which they are applied.

Each row fails some of a few filters. An order of filters removes at each step the rows that fail its filter and that no
earlier one removed; so the rows left after some filters depend on which they were, not on their order. One SQL CUBE over
the failure flags and the part counts, for every subset of the filters and every part, the rows whose selected flags are all
false: that subset's survivors. A step is a pair of subsets, before and after its filter, and a join of such pairs gives
what every step of every order removes. The cube reads counts by part and combination of flags, so it is as small as
2 ** filters rows a part at any size of the corpus.

The copy filter looks at the whole table: a row fails it if an equal text has a smaller id anywhere. Copies are found by the
SHA-256 of their text; the least id of each is an aggregation, and rows meet it by text and id together, so that no group of
copies gathers in one task.

Defined results: null texts are empty, and equal to empty ones; empty texts fail only the filters they are defined to fail;
rows without an id count in their part, are never copies and make no row a copy; repeated rows count each, and of rows of one
text and the least id none is a copy; labels that repeat an id count as 1 if any of them is 1, and rows without one as 0; a
null part is the empty string; texts of any length are read whole; an empty table has no parts and no rows; other columns are
not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, small_side

#: The contract's white space, and its characters that fail D.
SPACE, ODD = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def text_filters(text: Column, least_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10) -> dict[str, Column]:
    """The failure conditions of A to D, booleans: few words, few distinct ones, many capitals, an odd character."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    return {
        "A": n < least_words,
        "B": F.size(F.array_distinct(words)) * 100 < n * distinct_percent,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * capital_percent,
        "D": text.rlike(ODD),
    }


def flags(
    documents: DataFrame, labels: DataFrame, copy_letter: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> tuple[DataFrame, str]:
    """((part, a boolean for each filter, n, good, toxic), letters): rows counted by part and combination of flags."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    conditions = text_filters(F.col("_text"))
    letters = "".join(conditions)
    read = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    tested = read.select("_id", "part", F.unhex(F.sha2("_text", 256)).alias("_digest"), *[c.alias(k) for k, c in conditions.items()])
    rows = cut(tested.groupBy("_id", "part", "_digest", *letters).agg(F.count(F.lit(1)).alias("n")))
    # The first row of each text, met by text and id: as many keys as rows, however many copies a text has.
    firsts = rows.where("_id IS NOT NULL").groupBy("_digest").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    marked = rows.join(firsts, ["_digest", "_id"], "left").withColumn(copy_letter, F.col("_id").isNotNull() & F.col("_first").isNull())
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"_{c}")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(one("quality"), one("toxic")).where("_quality + _toxic > 0")
    joined = marked.join(small_side(cut(known)), "_id", "left")
    total = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    letters += copy_letter
    counted = joined.groupBy("part", *letters).agg(F.sum("n").alias("n"), total("_quality").alias("good"), total("_toxic").alias("toxic"))
    return counted, letters


def survivors(counted: DataFrame, letters: str) -> DataFrame:
    """(part, subset, n, good, toxic): the rows of a part that fail no filter of a subset, zeros included; bit k of a subset
    is the filter ``letters[k]``."""
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    cube = counted.cube(*letters, "part").agg(*sums, *[F.grouping(c).alias(f"_{c}") for c in (*letters, "part")])
    subset = sum(((1 - F.col(f"_{c}").cast("int")) * (1 << k) for k, c in enumerate(letters)), F.lit(0))
    left = cube.where("_part = 0").where(" AND ".join(f"({c} IS NULL OR NOT {c})" for c in letters)).select("part", subset.alias("subset"), "n", "good", "toxic")
    grid = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(letters) - 1))).alias("subset"))
    return grid.join(left, ["part", "subset"], "left").na.fill(0, ["n", "good", "toxic"])


def audit(
    documents: DataFrame, labels: DataFrame, copy_letter: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): every step of
    every order of the filters in every part."""
    counted, letters = flags(documents, labels, copy_letter, id_col, text_col, part_col)
    left = cut(survivors(counted, letters))
    k, full = len(letters), 2 ** len(letters) - 1

    # Pairs of subsets that one filter sets apart.
    bit = lambda c: F.call_function("shiftleft", F.lit(1), F.col(c))
    before = left.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"b_{c}") for c in ("n", "good", "toxic")])
    free = before.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("before").bitwiseAND(bit("filter")) == 0)
    pairs = free.withColumn("subset", F.col("before").bitwiseOR(bit("filter"))).join(left, ["part", "subset"])
    steps = pairs.select(
        "part", "before", "filter", F.col("n").alias("kept"), (F.col("b_n") - F.col("n")).alias("removed"),
        (F.col("b_good") - F.col("good")).alias("good_lost"), (F.col("b_toxic") - F.col("toxic")).alias("toxic_lost"),
    )

    # What a filter does over all orders: of those with a subset before it there are |subset|! (k - 1 - |subset|)!.
    orders_of = F.element_at(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)]), F.bit_count("before") + 1)
    alone = F.col("before") == F.lit(full) - bit("filter")
    whole = steps.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"),
        F.sum(orders_of * F.col("removed")).alias("shapley"),
    )
    listed = [
        ("".join(letters[i] for i in order), step + 1, sum(1 << i for i in order[:step]), order[step])
        for order in permutations(range(k)) for step in range(k)
    ]
    orders = documents.sparkSession.createDataFrame(listed, "filter_order string, step int, before int, filter int")
    return (
        steps.join(whole, ["part", "filter"]).join(F.broadcast(orders), ["before", "filter"])  # k! * k rows at any size
        .select(
            "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
            "unique_fails", "good_lost", "toxic_lost", "shapley",
        )
    )
