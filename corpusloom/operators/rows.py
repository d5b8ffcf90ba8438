"""Construction of chat, review and storage rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, stable_id
from corpusloom.operators.extract import escape


#: Variants of a scenario that a join may broadcast.
MOST_VARIANTS = 1_000


def code_sample(surface: Column, area: Column, copy: Column) -> Column:
    """A snippet that shows the copy where it is used."""
    safe = F.replace(copy, F.lit('"'), F.lit('\\"'))
    return F.concat_ws("\n", F.concat(F.lit("// on "), surface, F.lit(", "), area), F.concat(F.lit('<Button title="'), safe, F.lit('">'), safe, F.lit("</Button>")))


def prompt(fields: dict[str, Column]) -> Column:
    """Labelled lines, in the order given."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit(""))) for label, value in fields.items()])


def chat_rows(scenarios: DataFrame, variants: DataFrame, system: str) -> DataFrame:
    """Every scenario (category, area, state, current, rewrite, reason, risk, policy_ids) in every variant
    (surface, audience, constraint) as a chat row. Variants are a short list, which is checked, and are broadcast."""
    if variants.limit(MOST_VARIANTS + 1).count() > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} variants")
    both = scenarios.crossJoin(F.broadcast(variants))
    user = prompt(
        {
            "Surface": F.col("surface"), "Audience": F.col("audience"), "State": F.col("state"), "Type": F.col("category"),
            "Current copy": F.col("current"), "Code": code_sample(F.col("surface"), F.col("area"), F.col("current")), "Constraint": F.col("constraint"),
        }
    )
    answer = F.to_json(F.struct("rewrite", "reason", F.coalesce("risk", F.lit("")).alias("risk")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return both.select(
        stable_id(F.col("category"), F.col("current"), F.col("surface")).alias("id"),
        F.array(message("system", F.lit(system)), message("user", user), message("assistant", answer)).alias("messages"),
        F.create_map(F.lit("category"), F.col("category"), F.lit("product_surface"), F.col("area")).alias("metadata"),
        F.struct(
            F.coalesce("policy_ids", F.array(F.lit("default"))).alias("source_policy_ids"), F.lit("template").alias("generation_method")
        ).alias("provenance"),
    )


def placeholder_rows(candidates: DataFrame, order: list[str]) -> DataFrame:
    """Scanned candidates as rows that wait for a rewrite; the id holds the candidate's place, not a counter."""
    return candidates.select(
        stable_id(F.lit("scan"), F.col("path"), F.col("line").cast("string"), F.col("current_copy")).alias("id"),
        prompt({"Path": F.col("path"), "Type": F.col("kind"), "Current copy": F.col("current_copy"), "Context": F.col("context")}).alias("prompt"),
        *order,
    )


def tagged(
    df: DataFrame, task: str, modality: str, source: Column, split: str, image: Column | None = None, provenance: Column | None = None
) -> DataFrame:
    """Constant columns of one dataset; an image keeps its base name under screens/, and rows without a provenance get the
    dataset's."""
    if provenance is not None:
        df = df.withColumn("provenance", F.coalesce("provenance", provenance))
    name = F.lit(None).cast("string") if image is None else F.concat(F.lit("screens/"), F.substring_index(image, "/", -1))
    return df.withColumns({"task": F.lit(task), "modality": F.lit(modality), "source": source, "split": F.lit(split), "image": name})


def storage(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, so that rows of all tasks share one table of strings."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(
        *[text(c).alias(c) for c in ("id", "task", "modality", "source", "split", "image")],
        *[F.to_json(c).alias(f"{c}_json") for c in ("messages", "metadata", "provenance")],
    )


def existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there."""
    return df.select(*[c for c in wanted if c in df.columns])


def numbered_ids(df: DataFrame, prefix: Column, position: Column) -> DataFrame:
    """id: prefix, _n and the position in two digits or more."""
    return df.withColumn("id", F.concat(prefix, F.lit("_n"), F.when(position < 10, F.concat(F.lit("0"), position.cast("string"))).otherwise(position.cast("string"))))


def normal_prediction(df: DataFrame, id_col: str, fields: tuple[str, ...] = ("rewrite", "reason", "risk", "confidence")) -> DataFrame:
    """All fields as trimmed strings, '' where missing."""
    have = [F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) if f in df.columns else F.lit("") for f in fields]
    return df.select(F.col(id_col).cast("string").alias("id"), *[c.alias(f) for c, f in zip(have, fields)])


def gold_answer(messages: Column) -> Column:
    """The first assistant content."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(1))["content"]


def without_answers(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "assistant")


def prompt_part(messages: Column) -> Column:
    return F.slice(messages, 1, 2)


def reviewed(candidates: DataFrame, predictions: DataFrame, on: list[str]) -> DataFrame:
    """Candidates with suggestion, reason, risk; a suggestion that is code has the risk contract_escape, a missing
    one keeps the copy. changed: an edit beyond white space."""
    both = candidates.join(predictions, on, "left")
    suggestion = F.coalesce("suggested_copy", F.lit(""))
    return both.withColumns(
        {
            "suggested_copy": suggestion,
            "risk": F.when(escape(suggestion), "contract_escape").otherwise(F.coalesce("risk", F.lit(""))),
            "changed": (collapse(F.col("current_copy")) != collapse(suggestion)) & (collapse(suggestion) != "") & ~escape(suggestion),
        }
    )


def highlights(rows: DataFrame, order: list[str], most: int = 48) -> DataFrame:
    """Short, valid edits, ``most`` of them, as before, after and reason."""
    short = F.length("current_copy").between(4, 60) & (F.length("suggested_copy") <= 70)
    return rows.where(F.col("changed") & F.col("valid_json") & short).orderBy(*order).limit(most).select(
        *order, F.col("current_copy").alias("before"), F.col("suggested_copy").alias("after"), "reason"
    )


#: Columns that a reviewer sees only after the vote.
HIDDEN = ("reason", "risk", "tokens", "latency", "a_is", "b_is")


def before_vote(df: DataFrame) -> DataFrame:
    return df.drop(*HIDDEN)


def after_vote(df: DataFrame, id_col: str) -> DataFrame:
    """What the vote revealed: the id and the columns that were hidden."""
    return df.select(id_col, *[c for c in df.columns if c in HIDDEN])


def product_prompt(surface: Column, audience: Column, state: Column, category: Column, current: Column, code: Column, constraints: str) -> Column:
    """The prompt that models were tuned on; its labels are fixed values."""
    fields = {"Product surface": surface, "Audience": audience, "User state": state, "Content type": category, "Current copy": current}
    shown = F.concat(F.lit("Code/context:\n"), F.coalesce(code, F.lit("")))
    return F.concat_ws("\n", prompt(fields), shown, F.lit(f"Constraints: {constraints}"))


#: What the prompts of a run say beside the copy.
KEEP_BEHAVIOUR = "Preserve the intended product behavior."
ONLY_WITH_CONTEXT = f"Suggest a UX writing rewrite only if the context supports it. {KEEP_BEHAVIOUR}"


def brief_prompt(category: Column, surface: Column, current: Column) -> Column:
    """The prompt of an arena brief."""
    state = F.concat(F.lit("interacting with this "), F.replace(category, F.lit("_"), F.lit(" ")))
    return product_prompt(surface, F.lit("general product user"), state, category, current, current, KEEP_BEHAVIOUR)


def review_prompt(path: Column, line: Column, kind: Column, current: Column, context: Column) -> Column:
    """The prompt of a string that a scan found."""
    state = F.concat(F.lit("using the screen that contains "), path, F.lit(":"), line.cast("string"))
    return product_prompt(F.lit("existing codebase"), F.lit("product user"), state, kind, current, context, ONLY_WITH_CONTEXT)


def rubric(rules: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """(group, rubric): the rules of each group as bullet lines, in order. Rubrics are a page of text."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.concat(F.lit("- "), x[text]))
    return rules.groupBy(group).agg(F.array_join(lines, "\n").alias("rubric"))
