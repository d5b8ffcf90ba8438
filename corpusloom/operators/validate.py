"""Row validation as columns: an array of what is wrong, empty for good rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.contract import issues_contract, rewrite_contract
from corpusloom.functions.text import estimated_tokens, flat_content
from corpusloom.operators.leakage import copies_source

ROLES = ("system", "user", "assistant")
#: Labels and provenances of an evaluation manifest.
RECOGNIZED = ("duplication", "plural", "brand", "casing", "tone", "terminology")
PROVENANCES = ("natural", "planted")


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``turns`` with n, their place in the conversation, from 1."""
    return turns.withColumn("n", F.row_number().over(Window.partitionBy(conv).orderBy(turn)))


def folded(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", most: int = len(ROLES) + 1) -> DataFrame:
    """(conv, messages array<struct<turn, role, content>>) in order of turns: the first ``most`` of each conversation, by
    which too long ones are told, so that no conversation is gathered whole."""
    message = F.struct(F.col(turn).alias("turn"), F.col("role"), F.col("text").alias("content"))
    return numbered(turns, conv, turn).where(F.col("n") <= most).groupBy(conv).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def tokens(messages: Column) -> Column:
    return F.aggregate(F.transform(messages, lambda m: estimated_tokens(m["content"])), F.lit(0).cast("long"), lambda a, x: a + x)


def modality(declared: Column, task: Column, listed: Column) -> Column:
    """The declared modality or task decides; else content in parts means vision."""
    return (
        F.when((declared == "vision") | (task == "consistency"), "vision")
        .when((declared == "text") | (task == "rewrite"), "text")
        .when(listed, "vision")
        .otherwise("text")
    )


def chat_errors(messages: Column, most_tokens: int, contract_error: Column | None = None, policy_ids: Column | None = None) -> Column:
    """Errors of a text chat: three messages (else nothing more is looked at), the sequence of roles, contents,
    the token budget, and where given the contract of the answer and the provenance."""
    roles = F.transform(messages, lambda m: m["role"])
    empty = F.transform(messages, lambda m, k: F.when(F.trim(F.coalesce(m["content"], F.lit(""))) == "", F.concat(F.lit("empty:"), k.cast("string"))))
    checks = [
        F.when(~roles.eqNullSafe(F.array(*[F.lit(r) for r in ROLES])), "roles"),
        F.when(tokens(messages) > most_tokens, "tokens"),
    ]
    if contract_error is not None:
        checks.append(F.when(contract_error != "", F.concat(F.lit("contract:"), contract_error)))
    if policy_ids is not None:
        checks.append(F.when(F.coalesce(F.size(policy_ids), F.lit(0)) < 1, "provenance"))
    rest = F.array_compact(F.concat(F.array(*checks), empty))
    return F.when(F.coalesce(F.size(messages), F.lit(0)) != len(ROLES), F.array(F.lit("messages"))).otherwise(rest)


def vision_errors(system: Column, parts: Column, answer: Column, image: Column) -> Column:
    """Errors of a chat whose user message is parts array<struct<type, text>>."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.array_compact(
        F.array(
            F.when(blank(system), "system"),
            F.when(parts.isNull(), "parts"),
            F.when(parts.isNotNull() & ~F.exists(parts, lambda p: p["type"].eqNullSafe(F.lit("image"))), "no image part"),
            F.when(parts.isNotNull() & ~F.exists(parts, lambda p: p["type"].eqNullSafe(F.lit("text")) & ~blank(p["text"])), "no text part"),
            F.when(blank(answer), "assistant"),
            F.when(blank(image), "image"),
        )
    )


def row_errors(rows: DataFrame, most_tokens: int, sources: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(id, errors) of chat rows of both modalities. ``rows`` has id, messages array<struct<role, content, parts>> (a content
    is a string or parts), modality, task, image and provenance struct<source_policy_ids, license, url>.

    Not three messages: nothing more is looked at. Else roles, contents by modality, the token budget, the contract
    of the answer, phrases that a keyed-out answer copies from ``sources`` (text), and the provenance of its
    modality. Copies are found by one join over all answers."""
    m, p = F.col("messages"), F.col("provenance")
    three = F.coalesce(F.size("messages"), F.lit(0)) == len(ROLES)
    vision = modality(F.col("modality"), F.col("task"), F.exists(m, lambda x: x["parts"].isNotNull())) == "vision"
    seen = rows.select(F.col(id_col).alias("id"), "messages", "image", "provenance", three.alias("_three"), F.when(three, vision).otherwise(False).alias("_vision"))
    answer = F.when(F.col("_three"), m[2]["content"])
    fault = F.when(F.col("_vision"), issues_contract(answer)).otherwise(F.coalesce(rewrite_contract(answer)["error"], F.lit("")))
    seen = seen.withColumn("_contract", F.when(F.col("_three"), fault))
    copied = F.lit(False)
    if sources is not None:
        said = seen.where("_three AND _contract = ''").select("id", answer.alias("text"))
        seen = seen.join(copies_source(said, sources, "id").withColumn("_copied", F.lit(True)), "id", "left")
        copied = F.coalesce("_copied", F.lit(False))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = F.transform(m, lambda x, k: F.when(blank(x["content"]), F.concat(F.lit("empty:"), k.cast("string"))))
    contents = F.when(F.col("_vision"), vision_errors(m[0]["content"], m[1]["parts"], m[2]["content"], F.col("image"))).otherwise(empty)
    total = F.aggregate(F.transform(m, lambda x: estimated_tokens(flat_content(x["parts"], x["content"]))), F.lit(0).cast("long"), lambda a, x: a + x)
    policies = F.coalesce(F.size(p["source_policy_ids"]), F.lit(0)) > 0
    licensed = F.col("_vision") & (~blank(p["license"]) | ~blank(p["url"]))
    rest = F.concat(
        F.array(F.when(~F.transform(m, lambda x: x["role"]).eqNullSafe(F.array(*[F.lit(r) for r in ROLES])), "roles")),
        contents,
        F.array(
            F.when(total > most_tokens, "tokens"), F.when(F.col("_contract") != "", F.concat(F.lit("contract:"), "_contract")), F.when(copied, "copy"),
            F.when(~(policies | licensed), "provenance"),
        ),
    )
    return seen.select(F.col("id").alias(id_col), F.when(F.col("_three"), F.array_compact(rest)).otherwise(F.array(F.lit("messages"))).alias("errors"))


def missing_keys(raw: Column, required: list[str]) -> Column:
    """array<string>: ``missing:`` and the name of each key that the JSON object does not have."""
    gone = F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")))
    return F.transform(gone, lambda k: F.concat(F.lit("missing:"), k))


def manifest_errors(df: DataFrame, known_images: DataFrame | None = None, raw: str | None = None, required: list[str] | None = None) -> DataFrame:
    """``df`` (id, image, clean, gold_types, n_issues, within_screen, provenance, planted_from) with errors.
    Ids are counted by an aggregation, and images looked up by a join, so no table is gathered. ``raw`` names a
    column with the row's JSON, in which all ``required`` keys have to stand."""
    counts = df.groupBy("id").agg(F.count(F.lit(1)).alias("_copies"))
    out = df.join(counts, "id", "left")
    found = F.lit(True)
    if known_images is not None:
        out = out.join(known_images.select("image").distinct().withColumn("_found", F.lit(True)), "image", "left")
        found = F.coalesce("_found", F.lit(False))
    types, planted = F.coalesce("gold_types", F.array().cast("array<string>")), F.coalesce("planted_from", F.lit("")) != ""
    odd = F.array_except(types, F.array(*[F.lit(t) for t in RECOGNIZED]))
    clean, bug = F.col("clean"), ~F.col("clean")
    errors = F.array_compact(
        F.array(
            F.when(F.col("_copies") > 1, "duplicate id"),
            F.when(F.size(odd) > 0, "unknown type"),
            F.when(~F.coalesce(F.col("provenance").isin(*PROVENANCES), F.lit(False)), "provenance"),
            F.when(clean & (F.size(types) > 0), "clean with types"),
            F.when(bug & (F.size(types) == 0), "bug without types"),
            F.when(bug & (F.coalesce("n_issues", F.lit(0)) == 0), "bug without issues"),
            F.when(bug & ~F.coalesce("within_screen", F.lit(False)), "bug outside the screen"),
            F.when((F.col("provenance") == "planted") & ~planted, "planted from nothing"),
            F.when((F.col("provenance") == "natural") & planted, "natural but planted"),
            F.when(~found, "no image"),
        )
    )
    if raw is not None:
        errors = F.concat(missing_keys(F.col(raw), required or []), errors)
    return out.withColumn("errors", errors).select(*df.columns, "errors")


def count_errors(df: DataFrame, errors: str = "errors") -> DataFrame:
    """(error, n) over all rows."""
    return df.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


#: Fixed value: any bare address of mail.
MAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"


def mail_fields(df: DataFrame, id_col: str, fields: list[str], names: list[str] | None = None) -> DataFrame:
    """(id, field) of the text fields with an address of mail, or one of the names."""
    pattern = "|".join([MAIL, *[f"(?i:{n})" for n in names or ()]])
    hits = F.array_compact(F.array(*[F.when(F.col(f).rlike(pattern), f) for f in fields]))
    return df.select(id_col, F.explode(hits).alias("field"))
