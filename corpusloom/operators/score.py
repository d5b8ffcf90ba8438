"""Scores of rewrites and recall over sets of labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import words

#: Word lists of the rewrite score.
GENERIC = ("ok", "submit", "confirm", "proceed", "click here", "read more", "done", "error")
BLAME = ("invalid", "illegal", "bad", "wrong")
SPECIFIC = (
    "add", "cancel", "change", "choose", "clear", "close", "connect", "delete", "download", "enable", "retry", "save", "search", "send",
    "sign", "try", "update", "view",
)
METRICS = ("not_generic", "concise", "specific_action", "no_blame", "changed_when_needed")


def rewrite_metrics(df: DataFrame, current: Column, rewrite: Column, category: Column) -> DataFrame:
    """``df`` with the five metrics of a rewrite (0 to 1) and overall, their mean."""
    listed = lambda names: F.array(*[F.lit(x) for x in names])
    low, n = F.lower(F.trim(F.coalesce(rewrite, F.lit("")))), F.size("_words")
    generic = low.isin(*GENERIC)
    same = low == F.concat_ws(" ", words(current))
    blames = F.arrays_overlap("_words", listed(BLAME)) & (category != "inline_error")
    scored = {
        "not_generic": F.when(generic, 0.0).otherwise(1.0),
        "concise": F.when(n <= 12, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (n - 12) / 12)),
        "specific_action": F.when(F.arrays_overlap("_words", listed(SPECIFIC)), 1.0).otherwise(0.5),
        "no_blame": F.when(blames, 0.0).otherwise(1.0),
        "changed_when_needed": F.when(same & generic, 0.0).otherwise(1.0),
    }
    out = df.withColumn("_words", words(rewrite)).withColumns(scored).drop("_words")
    return out.withColumn("overall", sum((F.col(m) for m in METRICS[1:]), F.col(METRICS[0])) / len(METRICS))


def with_totals(df: DataFrame, by: list[str], aggregates: list[Column], total: str = "*") -> DataFrame:
    """Aggregates of each group of ``by``, and of what is left when its columns are dropped from the last to the first, in one
    pass: a rollup, whose partial aggregates meet once. A column that is summed over holds ``total``; a null group stays null."""
    rolled = df.rollup(*by).agg(*aggregates, *[F.grouping(c).alias(f"_{c}") for c in by])
    return rolled.withColumns({c: F.when(F.col(f"_{c}") == 1, total).otherwise(F.col(c)) for c in by}).drop(*[f"_{c}" for c in by])


def mean_metrics(scored: DataFrame, by: list[str] | None = None, digits: int = 4, total: str | None = None) -> DataFrame:
    """Rounded means of the metrics, overall being the mean of the rounded ones, and rows; with ``total`` also over all groups,
    under that name."""
    aggregates = [F.count(F.lit(1)).alias("n_rows"), *[F.round(F.avg(m), digits).alias(m) for m in METRICS]]
    means = scored.groupBy(*(by or [])).agg(*aggregates) if total is None else with_totals(scored, by or [], aggregates, total)
    return means.withColumn("overall", F.round(sum((F.col(m) for m in METRICS[1:]), F.col(METRICS[0])) / len(METRICS), digits))


def honest(scored: DataFrame, parsed: Column) -> DataFrame:
    """Rows that gave nothing to score count 0 on every metric."""
    return scored.withColumns({m: F.when(parsed, F.col(m)).otherwise(0.0) for m in (*METRICS, "overall")})


def recall(df: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(tp, fn, recall) of predicted label sets, 0 where there are no gold labels."""
    counted = df.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(F.size(F.array_intersect(gold, predicted))), F.lit(0)).cast("long").alias("tp"),
        F.coalesce(F.sum(F.size(F.array_except(gold, predicted))), F.lit(0)).cast("long").alias("fn"),
    )
    return counted.withColumn("recall", F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0)))


def slices(df: DataFrame, gold: str, predicted: str, natural: Column, types: tuple[str, ...]) -> DataFrame:
    """(slice, tp, fn, recall) of the rows with gold labels: natural, full, multi (two labels or more), and one
    slice for each label that some row has; one pass over the rows."""
    bugs = df.where(F.size(gold) > 0)
    names = F.array_compact(
        F.array(
            F.lit("full"), F.when(natural, "natural"), F.when(F.size(gold) >= 2, "multi"),
            *[F.when(F.array_contains(gold, t), f"type:{t}") for t in types],
        )
    )
    return recall(bugs.withColumn("slice", F.explode(names)), gold, predicted, ["slice"])


def two_systems(df: DataFrame, systems: dict[str, tuple[str, str]], natural: Column, types: tuple[str, ...]) -> DataFrame:
    """(system, slice, tp, fn, recall, over_flags, n) of rows with gold labels (gold, clean) for each system's columns
    (its label set, its number of flags). Slices are natural, full, multi and one for each type; recall is null
    where a type has no rows. over_flags and n are those of the slice clean, and n the rows of the others."""
    bugs, parts = df.where("NOT clean"), []
    spark = df.sparkSession
    wanted = spark.createDataFrame([(s,) for s in ("natural", "full", "multi", *[f"type:{t}" for t in types])], "slice string")
    for name, (predicted, flags) in systems.items():
        named = F.array_compact(
            F.array(F.lit("full"), F.when(natural, "natural"), F.when(F.size("gold") >= 2, "multi"), *[F.when(F.array_contains("gold", t), f"type:{t}") for t in types])
        )
        each = bugs.withColumn("slice", F.explode(named))
        n = each.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
        found = recall(each, "gold", predicted, ["slice"]).join(n, "slice")
        found = wanted.join(found, "slice", "left")  # a row a slice on either side
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fn")]
        empty = F.when(~F.col("slice").startswith("type:"), 0.0)
        parts.append(found.select(F.lit(name).alias("system"), "slice", *zero, F.coalesce("recall", empty).alias("recall"), F.lit(None).cast("long").alias("over_flags"), F.coalesce("n", F.lit(0)).alias("n")))
        null = F.lit(None)
        parts.append(
            df.where("clean").agg(F.coalesce(F.sum(flags), F.lit(0)).cast("long").alias("over_flags"), F.count(F.lit(1)).alias("n")).select(
                F.lit(name).alias("system"), F.lit("clean").alias("slice"), null.cast("long").alias("tp"), null.cast("long").alias("fn"),
                null.cast("double").alias("recall"), "over_flags", "n",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def over_flags(df: DataFrame, gold: str, n_flags: Column) -> DataFrame:
    """Flags on rows without gold labels."""
    return df.where(F.size(gold) == 0).agg(F.coalesce(F.sum(n_flags), F.lit(0)).cast("long").alias("over_flags"), F.count(F.lit(1)).alias("n_clean"))


def by_model(scored: DataFrame, models: list[str], category: str = "category", model: str = "model") -> DataFrame:
    """Mean overall by category, a column for each model, and the difference of the last to the first."""
    wide = scored.groupBy(category).pivot(model, models).agg(F.avg("overall"))
    return wide.withColumn("delta", F.col(models[-1]) - F.col(models[0]))


def new_first(df: DataFrame, category: str, known: list[str]) -> DataFrame:
    """``df`` with is_new, for categories that are not among the known ones, and place, by which new categories come
    first and others after them, each by name; places are counted on the distinct categories only."""
    names = df.select(category).distinct().withColumn("is_new", ~F.col(category).isin(*known))
    place = F.row_number().over(Window.orderBy(F.desc("is_new"), category))
    return df.join(F.broadcast(names.withColumn("place", place)), category)
