"""Checks of JSON that models return.

Columns are checked by built-in functions: Spark's variants, made strict, and a state machine over braces and quotes that
finds objects in prose. Functions of a single reply are around Python's decoder, for predictors that answer one by one and as a
plain statement of the same rules. They differ in two cases: columns refuse objects that repeat a key, and NaN or Infinity."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REWRITE = "ok boolean, rewrite string, reason string, risk string, error string"


def _refuse(reason: str) -> dict:
    return {"ok": False, "rewrite": None, "reason": None, "risk": None, "error": reason}


def _accept(o: dict) -> dict:
    text = lambda k: o[k] if isinstance(o.get(k), str) else None
    return {"ok": True, "rewrite": text("rewrite"), "reason": text("reason"), "risk": text("risk"), "error": None}


def check_rewrite(text: str | None) -> dict:
    """The whole text is an object with non-empty strings rewrite and reason, and a string risk if any."""
    try:
        o = json.loads(text or "")
    except ValueError:
        return _refuse("not json")
    if not isinstance(o, dict):
        return _refuse("not an object")
    for k in ("rewrite", "reason"):
        if not isinstance(o.get(k), str) or not o[k].strip():
            return _refuse(f"{k} missing")
    if "risk" in o and not isinstance(o["risk"], str):
        return _refuse("risk not a string")
    return _accept(o)


def last_object(text: str | None) -> dict:
    """The last object with a string rewrite after the last </think>; nested objects belong to the outer one."""
    answer, decoder, at, found = (text or "").rsplit("</think>", 1)[-1], json.JSONDecoder(), 0, None
    while (at := answer.find("{", at)) >= 0:
        try:
            value, at = decoder.raw_decode(answer, at)
        except ValueError:
            at += 1
            continue
        if isinstance(value, dict) and isinstance(value.get("rewrite"), str):
            found = value
    return _accept(found) if found is not None else _refuse("no object")


def widest_object(text: str | None) -> dict:
    """The object from the first to the last brace after the last </think>, with a non-empty rewrite."""
    answer = (text or "").rsplit("</think>", 1)[-1]
    low, high = answer.find("{"), answer.rfind("}")
    try:
        o = json.loads(answer[low : high + 1]) if 0 <= low < high else None
    except ValueError:
        o = None
    if not isinstance(o, dict) or not isinstance(o.get("rewrite"), str) or not o["rewrite"].strip():
        return _refuse("no object")
    return _accept(o | {"rewrite": o["rewrite"].strip()})


def check_issues(text: str | None) -> str:
    """'' for an object with a list of strings, inventory, and a list of issues of strings; else what is wrong."""
    try:
        o = json.loads(text or "")
    except ValueError:
        return "not json"
    if not isinstance(o, dict):
        return "not an object"
    strings = lambda x: isinstance(x, list) and all(isinstance(s, str) for s in x)
    if not strings(o.get("inventory")):
        return "inventory"
    if not isinstance(o.get("issues"), list):
        return "issues"
    for issue in o["issues"]:
        if not isinstance(issue, dict) or not strings(issue.get("strings")) or not issue["strings"]:
            return "strings"
        if any(not isinstance(issue.get(k), str) or not issue[k].strip() for k in ("type", "problem", "fix")):
            return "issue fields"
    return ""


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once: as the element of an array of one."""
    return F.transform(F.array(c), use)[0]


def blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strict(c: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; null for any other. The parser reads on past bad ends, so
    it gets an array that ends with the text's checksum and has to find two elements and the checksum."""

    def parsed(t: Column) -> Column:
        crc = F.crc32(t)
        both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), t, F.lit(","), crc.cast("string"), F.lit("]"))), "$", "array<variant>")
        return bound(both, lambda a: F.when((F.size(a) == 2) & (F.try_variant_get(a[1], "$", "bigint") == crc), a[0]))

    return bound(c, parsed)


def kind(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, ... of a variant; null for null and for what is not there."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def string_in(v: Column, name: str) -> Column:
    """A member that is a string, else null."""
    return F.when(kind(member(v, name)) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v) == "OBJECT", F.lit(False))


def _outcome(v: Column, error: Column) -> Column:
    """struct REWRITE of a variant and what is wrong with it, null for nothing."""
    good = error.isNull()
    return F.struct(good.alias("ok"), *[F.when(good, string_in(v, k)).alias(k) for k in ("rewrite", "reason", "risk")], error.alias("error"))


def rewrite_contract(c: Column) -> Column:
    """See ``check_rewrite``."""

    def judged(v: Column) -> Column:
        error = F.when(v.isNull(), "not json").when(~is_object(v), "not an object")
        for k in ("rewrite", "reason"):
            error = error.when(F.coalesce(blank(string_in(v, k)), F.lit(True)), f"{k} missing")
        error = error.when(member(v, "risk").isNotNull() & string_in(v, "risk").isNull(), "risk not a string")
        return _outcome(v, error)

    return bound(strict(F.coalesce(c, F.lit(""))), judged)


def answer(c: Column) -> Column:
    """What follows the last </think>."""
    return F.substring_index(F.coalesce(c, F.lit("")), "</think>", -1)


def closed_at(text: Column) -> Column:
    """For a text that starts with a brace: the length up to the brace that closes it, 0 without one. Escaped characters are
    masked, so a string ends at the next quote; a token is a string, a brace or a lone quote and what stands before it, and
    the depth of braces runs over the tokens."""
    masked = F.regexp_replace(text, r"(?s)\\.", "__")
    tokens = F.regexp_extract_all(masked, F.lit(r'([^{}"]*+(?:"[^"]*+"|[{}"]))'), F.lit(1))

    def step(s: Column, token: Column) -> Column:
        last = F.right(token, F.lit(1))
        depth = s["depth"] + F.when(last == "{", 1).when(last == "}", -1).otherwise(0)
        return F.when(s["over"], s).otherwise(
            F.struct(depth.cast("int").alias("depth"), (s["length"] + F.length(token)).cast("int").alias("length"), (depth == 0).alias("over"))
        )

    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("over"))
    return F.aggregate(tokens, zero, step, lambda s: F.when(s["over"], s["length"]).otherwise(0))


def last_object_text(c: Column) -> Column:
    """The text of the last object with a string rewrite, null without one: as many steps as there are opening braces, each from
    the next brace that no object found before contains."""
    opening = lambda t: F.when(F.instr(t, "{") > 0, F.substring(t, F.instr(t, "{"), F.length(t))).otherwise("")

    def step(s: Column, _: Column) -> Column:
        def taken(piece: Column) -> Column:
            return bound(
                strict(piece),
                lambda v: F.struct(
                    opening(F.substring(s["rest"], F.when(v.isNull(), 1).otherwise(F.length(piece)) + 1, F.length(s["rest"]))).alias("rest"),
                    F.when(string_in(v, "rewrite").isNotNull(), piece).otherwise(s["found"]).alias("found"),
                ),
            )

        return F.when(s["rest"] == "", s).otherwise(bound(F.substring(s["rest"], F.lit(1), closed_at(s["rest"])), taken))

    def folded(text: Column) -> Column:
        braces = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
        zero = F.struct(opening(text).alias("rest"), F.lit(None).cast("string").alias("found"))
        return F.aggregate(F.sequence(F.lit(0), braces), zero, step, lambda s: s["found"])

    return bound(answer(c), folded)


def last_rewrite(c: Column) -> Column:
    """See ``last_object``."""
    return bound(strict(last_object_text(c)), lambda v: _outcome(v, F.when(v.isNull(), "no object")))


def widest(c: Column) -> Column:
    """The variant of the text from the first to the last brace of the answer, null if that is no object."""
    return bound(strict(F.regexp_extract(answer(c), r"(?s)(\{.*\})", 1)), lambda v: F.when(is_object(v), v))


def widest_rewrite(c: Column) -> Column:
    """See ``widest_object``."""

    def judged(v: Column) -> Column:
        missing = F.coalesce(blank(string_in(v, "rewrite")), F.lit(True))
        return _outcome(v, F.when(missing, "no object"))

    return bound(bound(widest(c), judged), lambda o: o.withField("rewrite", stripped(o["rewrite"])))


def has_rewrite(text: str | None) -> bool:
    """The object from the first to the last brace after the last </think> has a string rewrite, be it empty."""
    answer = (text or "").rsplit("</think>", 1)[-1]
    low, high = answer.find("{"), answer.rfind("}")
    try:
        o = json.loads(answer[low : high + 1]) if 0 <= low < high else None
    except ValueError:
        return False
    return isinstance(o, dict) and isinstance(o.get("rewrite"), str)


def valid_reply(c: Column) -> Column:
    """See ``has_rewrite``."""
    return bound(widest(c), lambda v: string_in(v, "rewrite").isNotNull())


def strict_object(text: str | None) -> str | None:
    """The text if all of it is a JSON object, else null."""
    try:
        return text if isinstance(json.loads(text or ""), dict) else None
    except ValueError:
        return None


def object_text(c: Column) -> Column:
    """See ``strict_object``."""
    return bound(c, lambda t: F.when(is_object(strict(t)), t))


def issues_contract(c: Column) -> Column:
    """See ``check_issues``."""
    listed = lambda v, name: F.try_variant_get(v, f"$.{name}", "array<variant>")
    strings = lambda items: F.coalesce(F.forall(items, lambda x: F.coalesce(kind(x) == "STRING", F.lit(False))), F.lit(False))

    def fault(issue: Column) -> Column:
        named = listed(issue, "strings")
        fields = [F.coalesce(blank(string_in(issue, k)), F.lit(True)) for k in ("type", "problem", "fix")]
        return F.when(~(strings(named) & (F.size(named) > 0)), "strings").when(fields[0] | fields[1] | fields[2], "issue fields")

    def judged(v: Column) -> Column:
        issues = listed(v, "issues")
        first = F.get(F.filter(F.transform(issues, fault), lambda e: e.isNotNull()), F.lit(0))
        return (
            F.when(v.isNull(), "not json").when(~is_object(v), "not an object").when(~strings(listed(v, "inventory")), "inventory")
            .when(issues.isNull(), "issues").otherwise(F.coalesce(first, F.lit("")))
        )

    return bound(strict(F.coalesce(c, F.lit(""))), judged)


ISSUES = "struct<inventory:array<string>,issues:array<struct<type:string,strings:array<string>,problem:string,fix:string>>>"
#: Kinds of issues that claim a difference between strings.
DIFFER = ("terminology", "brand", "casing")


def one_type(t: Column) -> Column:
    """The kind of an issue, one label."""
    t = F.lower(F.coalesce(t, F.lit("")))
    return (
        F.when(t.contains("terminolog") | t.contains("consist"), "terminology")
        .when(t.contains("brand"), "brand")
        .when(t.contains("cas"), "casing")
        .otherwise(t)
    )


def all_types(t: Column) -> Column:
    """array<string> of all kinds that an issue's type names."""
    t = F.lower(F.coalesce(t, F.lit("")))
    brand, terms = t.contains("brand"), t.contains("terminolog")
    return F.array_compact(
        F.array(
            F.when(t.contains("dup"), "duplication"),
            F.when(t.rlike("plural|number|agreement"), "plural"),
            F.when(brand, "brand"),
            F.when(t.rlike("casing|capital"), "casing"),
            F.when(t.contains("tone"), "tone"),
            F.when((t.rlike("terminolog|consist") & ~brand) | (terms & brand), "terminology"),
        )
    )


def real_issues(issues: Column) -> Column:
    """Without those that claim a difference between two or more strings that are all the same."""
    from corpusloom.functions.text import collapse

    def keep(i: Column) -> Column:
        strings = F.transform(F.filter(F.coalesce(i["strings"], F.array().cast("array<string>")), lambda s: s.isNotNull()), collapse)
        return ~(one_type(i["type"]).isin(*DIFFER) & (F.size(strings) >= 2) & (F.size(F.array_distinct(strings)) < 2))

    return F.filter(F.coalesce(issues, F.array().cast("array<struct<type:string,strings:array<string>,problem:string,fix:string>>")), keep)


def filtered_output(c: Column) -> Column:
    """struct<inventory, issues, parse_error>: what the text holds, without issues that are not real. A text that is no
    object, by a strict decoder, is a parse error."""

    def kept(v: Column) -> Column:
        return F.struct(
            F.coalesce(v["inventory"], F.array().cast("array<string>")).alias("inventory"),
            real_issues(v["issues"]).alias("issues"),
            (v.isNull() | (v["inventory"].isNull() & v["issues"].isNull())).alias("parse_error"),
        )

    return bound(F.from_json(object_text(c), ISSUES), kept)


def issue_types(issues: Column) -> Column:
    """array<string>: the kinds that any of the issues names, each once."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(issues, lambda i: all_types(i["type"])))))


def raw_types(c: Column) -> Column:
    """The kinds in an output as it is; none where it does not parse."""
    v = F.from_json(object_text(c), ISSUES)
    return F.coalesce(issue_types(v["issues"]), F.array().cast("array<string>"))
