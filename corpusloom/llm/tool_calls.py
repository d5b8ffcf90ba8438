"""Tool-call linking in DataFrame and SQL functions only.

Calls and results of chat conversations are joined by (conversation, identifier). Calls are put in
topological order: a call whose arguments refer to another call's result, as {"$ref": "<identifier>"},
comes a level after it, a result belongs to its call's level, and inside a level calls go by turn and place.
Arguments are validated against the tools' schemas, and every call with its result is serialised as
canonical JSON: keys sorted, no white space, strict JSON only: a text that goes on after its value is none.

Conversations are never gathered: a conversation of any length is joined row by row, and identifiers that
many rows share are aggregated before they are shuffled. Chains of calls that refer to one other call each are
followed by pointer doubling, in as many rounds as the logarithm of their length; calls that refer to
several wait for those, a round for each such call on the longest path.

Defined results: of several calls, or results, with one identifier in a conversation the first by turn,
then by content, counts and ``copies`` says how many there were; results without a call are rows of their
own with status "orphan", and so are tool turns that are no envelope, with an error and their text as result
(equal ones of one turn are one row); calls whose arguments are no JSON object, or break the schema, or refer to one
another in a circle (level null) stay, with their errors; rows without a conversation or identifier never
link; null, empty and very long texts are contents like others; calls of equal level, turn and place go by identifier; empty tables give an empty result; only the named
columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut

#: Names of variant types that satisfy a schema type.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}
Schemas = dict[str, dict[str, tuple[str, bool]]]  # tool: argument: (type, required)

#: A reference and its identifier as a JSON string; the key's first quote is no escaped one.
REF = r'(?<!\\)"\$ref"\s*:\s*("(?:[^"\\]|\\.)+")'


CALLS = "try_variant_get(v, '$.tool_calls', 'array<variant>')"


def strict(text: str) -> str:
    """SQL of the variant of a JSON text, null where it is none. The parser takes a text that goes on after its value, so
    it gets an array that ends with the text's checksum, and has to find both."""
    array = f"try_variant_get(try_parse_json(concat('[', {text}, ',', crc32({text}), ']')), '$', 'array<variant>')"
    return f"transform(array({array}), a -> if(size(a) = 2 AND try_variant_get(a[1], '$', 'bigint') = crc32({text}), a[0], NULL))[0]"


def _braced() -> Column:
    return F.coalesce(F.col("text").rlike(r"^[\x20\t\n\r]*\{"), F.lit(False))


def holds_calls() -> Column:
    """Whether an assistant turn's ``text`` is an envelope of one call or more."""
    some = F.expr(f"coalesce(size({CALLS.replace('(v,', '(' + strict('text') + ',')}), 0) > 0")
    return F.when(_braced(), some).otherwise(False)


def events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages (conv_id, turn, role, text) in envelopes: {"tool_calls": [{"id", "name",
    "arguments"}]} in assistant turns, {"tool_call_id", "content"} in tool turns. Tool turns that are none are
    results without an identifier, with an error."""
    envelope = _braced()
    parsed = messages.where((F.col("role") == "tool") | (envelope & (F.col("role") == "assistant"))).select(
        "conv_id", "turn", "role", "text", F.when(envelope, F.expr(strict("text"))).alias("v")
    )
    one = F.posexplode(F.expr(CALLS)).alias("place", "c")
    calls = parsed.where("role = 'assistant'").select("conv_id", "turn", one).select(
        "conv_id", "turn", "place",
        F.expr("try_variant_get(c, '$.id', 'string')").alias("call_id"),
        F.expr("try_variant_get(c, '$.name', 'string')").alias("name"),
        F.expr("to_json(try_variant_get(c, '$.arguments', 'variant'))").alias("arguments"),
    )
    results = parsed.where("role = 'tool'").select(
        "conv_id", "turn",
        F.expr("try_variant_get(v, '$.tool_call_id', 'string')").alias("call_id"),
        F.expr("to_json(try_variant_get(v, '$.content', 'variant'))").alias("content"),
        quoted(F.coalesce("text", F.lit(""))).alias("whole"),
    ).select(
        "conv_id", "turn", "call_id",
        F.when(F.col("call_id").isNull(), F.col("whole")).otherwise(F.col("content")).alias("content"),
        F.when(F.col("call_id").isNull(), F.lit("result:no envelope")).alias("error"),
    )
    return calls, results


def schema_errors(schemas: Schemas) -> Column:
    """array<string> of what is wrong with ``arguments`` (and ``v``, parsed) of a call to tool ``name``."""
    kind = lambda arg: F.regexp_extract(F.expr(f"schema_of_variant(try_variant_get(v, '$.{arg}', 'variant'))"), "^[A-Z]+", 0)
    by_tool = F.lit(None).cast("array<string>")
    for tool, fields in schemas.items():
        found = []
        for arg, (wanted, required) in fields.items():
            present = F.array_contains("keys", arg)
            if required:
                found.append(F.when(~present, F.lit(f"missing:{arg}")))
            found.append(F.when(present & ~F.coalesce(kind(arg).isin(*TYPES[wanted]), F.lit(False)), F.lit(f"type:{arg}")))
        names = F.array(*[F.lit(a) for a in fields]) if fields else F.array().cast("array<string>")
        extra = F.transform(F.array_sort(F.array_except("keys", names)), lambda k: F.concat(F.lit("unknown:"), k))
        own = F.concat(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), extra)
        by_tool = F.when(F.col("name") == tool, own).otherwise(by_tool)
    return (
        F.when(F.col("v").isNull() | F.col("keys").isNull(), F.array(F.lit("arguments:not an object")))
        .when(by_tool.isNull(), F.array(F.lit("tool:unknown")))
        .otherwise(by_tool)
    )


def references() -> Column:
    """array<string> of the identifiers that a call's ``arguments`` refer to, escapes decoded."""
    texts = F.regexp_extract_all("arguments", F.lit(REF), F.lit(1))
    return F.transform(texts, lambda x: F.try_variant_get(F.try_parse_json(x), "$", "string"))


def levels(calls: DataFrame) -> DataFrame | None:
    """(conv_id, call_id, level) of calls that depend on others, None if none does. Calls in a circle, or after one, are
    missing."""
    ids = calls.select("conv_id", F.col("call_id").alias("dep")).where("conv_id IS NOT NULL AND dep IS NOT NULL")
    refs = calls.select("conv_id", "call_id", F.explode(references()).alias("dep"))
    deps = cut(refs.join(ids, ["conv_id", "dep"], "left_semi").distinct())
    if deps.isEmpty():
        return None
    same = ["conv_id", "call_id"]
    number = deps.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep"))
    free = deps.select("conv_id", F.col("dep").alias("call_id")).distinct().join(number.select(*same), same, "left_anti")
    ways = _followed(cut(number.where("n = 1").select(*same, "dep")))
    known = [cut(free.withColumn("level", F.lit(0).cast("long")))]
    # Calls with several dependencies, each at the end of a way or met at once.
    end = ways.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("end"), F.col("far").alias("more"))
    single = number.where("n = 1").select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("single"))
    waiting = (
        deps.join(number.where("n > 1").select(*same), same).join(end, ["conv_id", "dep"], "left").join(single, ["conv_id", "dep"], "left")
        .select(*same, F.when(F.col("single"), F.col("end")).otherwise(F.col("dep")).alias("dep"), (1 + F.coalesce("more", F.lit(0))).alias("far"))
        .withColumn("top", F.lit(None).cast("long"))
    )
    waiting = cut(waiting)
    while not waiting.isEmpty():
        now = known[-1].select("conv_id", F.col("call_id").alias("dep"), "level")
        met = waiting.join(now, ["conv_id", "dep"], "left").select(*same, "dep", "far", F.coalesce("top", F.col("level") + F.col("far")).alias("top"))
        waiting = cut(met)
        ready = waiting.groupBy(*same).agg(F.max("top").alias("level"), F.count_if(F.col("top").isNull()).alias("open"))
        new = cut(ready.where("open = 0").select(*same, "level"))
        if new.isEmpty():
            break  # what is left waits for circles
        known.append(new)
        waiting = cut(waiting.join(new.select(*same), same, "left_anti"))
    ends = reduce(DataFrame.union, known)
    last = ends.select("conv_id", F.col("call_id").alias("dep"), "level")
    return ends.union(ways.join(last, ["conv_id", "dep"]).select(*same, (F.col("level") + F.col("far")).alias("level")))


def _followed(ways: DataFrame) -> DataFrame:
    """(conv_id, call_id, dep, far): where the way of each call (conv_id, call_id, dep) ends, and after how many steps, by
    doubling. Ways that run in circles are missing."""
    own = ways.select("conv_id", F.col("call_id").alias("dep"), F.lit(False).alias("ended"))
    first = cut(ways.join(own, ["conv_id", "dep"], "left").select("conv_id", "call_id", "dep", F.lit(1).cast("long").alias("far"), F.coalesce("ended", F.lit(True)).alias("ended")))
    done, going = [first.where("ended")], first.where("NOT ended")
    while not going.isEmpty():
        ahead = reduce(DataFrame.union, [*done, going]).select(
            "conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("next"), F.col("far").alias("more"), F.col("ended").alias("ends")
        )
        step = cut(going.join(ahead, ["conv_id", "dep"]).select("conv_id", "call_id", F.col("next").alias("dep"), (F.col("far") + F.col("more")).alias("far"), F.col("ends").alias("ended")))
        new, going = step.where("ended"), step.where("NOT ended")
        if new.isEmpty():
            break
        done.append(new)
    return reduce(DataFrame.union, done).drop("ended")


def _first(df: DataFrame, *content: str) -> DataFrame:
    """One row per (conv_id, call_id): the first by turn, then content; ``copies`` counts them."""
    return (
        df.groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", *content)).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("conv_id", "call_id", "first.*", "copies")
    )


def canonical(fields: dict[str, Column]) -> Column:
    """A JSON object of fields that are JSON texts (null: left out), keys sorted."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(text: Column) -> Column:
    """A string as a JSON text, null as null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and per orphan result (``results`` may have an ``error``): conv_id, call_id, status (linked, open, orphan), turn,
    result_turn, level, errors, copies, record (canonical JSON)."""
    calls = cut(_first(calls, "place", "name", "arguments"))
    if "error" not in results.columns:
        results = results.withColumn("error", F.lit(None).cast("string"))
    sound = _first(results.where("error IS NULL"), "content").withColumn("error", F.lit(None).cast("string"))
    broken = results.where("error IS NOT NULL").groupBy("conv_id", "call_id", "turn", "content", "error").agg(F.count(F.lit(1)).alias("copies"))
    results = sound.unionByName(broken).select(
        F.col("conv_id").alias("r_conv"), F.when(F.col("error").isNull(), F.col("call_id")).alias("r_id"),
        F.col("turn").alias("result_turn"), "content", F.col("error").alias("r_error"), F.col("copies").alias("r_copies"),
    )
    order = levels(calls)
    if order is None:
        calls = calls.withColumn("level", F.lit(0))
    else:
        deps = F.size(F.regexp_extract_all("arguments", F.lit(REF), F.lit(1))) > 0
        circle = order.select("conv_id", "call_id", "level", F.lit(True).alias("ordered"))
        refs = calls.select("conv_id", "call_id", F.explode(references()).alias("dep"))
        ids = calls.select("conv_id", F.col("call_id").alias("dep"))
        bound = refs.join(ids, ["conv_id", "dep"], "left_semi").select("conv_id", "call_id").distinct().withColumn("bound", F.lit(True))
        calls = (
            calls.join(circle, ["conv_id", "call_id"], "left").join(bound, ["conv_id", "call_id"], "left")
            .withColumn("level", F.when(F.col("ordered"), F.col("level")).when(deps & F.col("bound"), None).otherwise(0))
            .drop("ordered", "bound")
        )
    checked = (
        calls.withColumn("v", F.expr(strict("arguments")))
        .withColumn("keys", F.when(F.expr("schema_of_variant(v)").startswith("OBJECT"), F.json_object_keys("arguments")))
        .withColumn("errors", F.concat(schema_errors(schemas), F.when(F.col("level").isNull(), F.array(F.lit("order:circle"))).otherwise(F.array().cast("array<string>"))))
        .withColumn("plain", F.expr("to_json(v)"))
    )
    joined = checked.join(results, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")), "full")
    known = F.col("errors").isNotNull()
    record = canonical(
        {
            "arguments": F.when(known, F.coalesce("plain", quoted(F.col("arguments")))),
            "conversation": F.coalesce("conv_id", "r_conv").cast("string"),
            "id": quoted(F.coalesce("call_id", "r_id")),
            "name": quoted(F.col("name")),
            "result": F.col("content"),
        }
    )
    return joined.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"),
        F.coalesce("call_id", "r_id").alias("call_id"),
        F.when(~known, "orphan").when(F.col("result_turn").isNull(), "open").otherwise("linked").alias("status"),
        F.col("turn").cast("long").alias("turn"),
        F.col("result_turn").cast("long").alias("result_turn"),
        F.col("level").cast("long").alias("level"),
        F.array_join(F.coalesce("errors", F.array_compact(F.array("r_error"))), ";").alias("errors"),
        (F.coalesce("copies", F.lit(0)) + F.coalesce("r_copies", F.lit(0))).cast("long").alias("copies"),
        record.alias("record"),
    )
