"""Queries of gates, of the predictor boundary, and of comparisons of two systems."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import contract
from corpusloom.operators import arena, cost, gates, retries, review, rows, score, validate
from corpusloom.plans.corpus import _PHRASES
from corpusloom.plans.evaluation import _FLAGS, _GOLD, _SHEET, _checkpoint, _judged, _sheet
from corpusloom.plans.registry import query, table

_ROWS = "rows AS (SELECT doc_id AS id, lower(source) AS source, lang, text FROM documents WHERE doc_id % 4 = 0)"


@query(rf"""WITH {_ROWS}, known AS (SELECT sha256(text) AS h, min('doc' || doc_id) AS path FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1)
SELECT id, 'name' AS rule, 'screens/' || source || '.png' AS detail FROM rows WHERE source IN ('src1', 'es')
UNION ALL SELECT id, 'substrate', lang FROM rows WHERE contains(lower(lang), 'src1') OR contains(lower(lang), 'es')
UNION ALL SELECT id, 'content', path FROM rows JOIN known ON h = sha256(text)
UNION ALL SELECT id, 'personal', 'text' FROM rows WHERE regexp_matches(text, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b')""")
def leak_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    image = F.concat(F.lit("screens/"), F.lower("source"), F.lit(".png"))
    mine = docs.where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), image.alias("image"), F.col("lang").alias("planted_from"), "text")
    known = docs.where("doc_id % 4 <> 0").select("text", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"))
    return gates.problems(mine, ["SRC1", "es"], content="text", known=known, known_content="text", text_fields=["text"])


_ANSWER = """'{"rewrite":' || CAST(to_json(text) AS VARCHAR) || ',"reason":"r"}'"""


@query(rf"""WITH d AS (SELECT doc_id, doc_id % 8 AS k, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, k, text, {_ANSWER} AS answer, CASE WHEN k = 3 THEN ' ' ELSE text END AS asked FROM d),
b AS (SELECT *, CASE WHEN k = 4 THEN 'no json' WHEN k = 6 THEN '{{"inventory":["a"],"issues":[]}}' ELSE answer END AS said FROM a),
c AS (SELECT doc_id, k, CASE WHEN k = 4 THEN 'contract:not json' WHEN k <> 6 AND trim(regexp_replace(text, '\s', '', 'g')) = '' THEN 'contract:rewrite missing' END AS fault,
  CASE WHEN k <> 6 AND trim(asked) = '' THEN 'empty:1' END AS hollow,
  CASE WHEN 2 + (CASE WHEN k = 6 THEN 1 ELSE greatest(1, length(asked) // 4) END) + greatest(1, length(said) // 4) > 1000 THEN 'tokens' END AS tokens FROM b),
copied AS (SELECT DISTINCT doc_id FROM {_PHRASES.format(id="doc_id", t="(SELECT doc_id, said AS text FROM b)")} WHERE phrase IN (SELECT phrase FROM {_PHRASES.format(id="item_id", t="benchmark")})),
e AS (SELECT unnest(CASE WHEN k = 2 THEN ['messages'] ELSE list_filter([CASE WHEN k = 1 THEN 'roles' END, hollow, CASE WHEN k = 6 THEN 'no image part' END, CASE WHEN k = 6 THEN 'image' END, tokens, fault,
  CASE WHEN fault IS NULL AND doc_id IN (SELECT doc_id FROM copied) THEN 'copy' END, CASE WHEN k = 5 THEN 'provenance' END], lambda x: x IS NOT NULL) END) AS error FROM c)
SELECT error, count(*) AS n FROM e GROUP BY error""")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rows around the documents' texts, each with one fault in eight; long ones and copies have more."""
    k, text = F.col("doc_id") % 8, F.coalesce("text", F.lit(""))
    none = F.lit(None).cast("array<struct<type:string,text:string>>")
    message = lambda role, content, parts=none: F.struct(F.lit(role).alias("role"), content.alias("content"), parts.alias("parts"))
    answer = F.to_json(F.struct(text.alias("rewrite"), F.lit("r").alias("reason")))
    said = F.when(k == 4, "no json").when(k == 6, '{"inventory":["a"],"issues":[]}').otherwise(answer)
    parts = F.when(k == 6, F.array(F.struct(F.lit("text").alias("type"), F.lit("t").alias("text"))))
    system, reply = message("system", F.lit("Be brief.")), message("assistant", said)
    user = message("user", F.when(k == 3, " ").when(k != 6, text), parts)
    messages = F.when(k == 1, F.array(user, system, reply)).when(k == 2, F.array(system, user)).otherwise(F.array(system, user, reply))
    source = F.struct(
        F.when(k == 5, F.array().cast("array<string>")).when(k != 6, F.array(F.lit("p"))).alias("source_policy_ids"),
        F.when(k == 6, "mit").alias("license"), F.lit(None).cast("string").alias("url"),
    )
    made = table(spark, sf_dir, "documents", spread=True).select(
        "doc_id", messages.alias("messages"), F.lit(None).cast("string").alias("modality"), F.when(k == 6, "consistency").alias("task"),
        F.lit(None).cast("string").alias("image"), source.alias("provenance"),
    )
    return validate.count_errors(validate.row_errors(made, 1000, table(spark, sf_dir, "benchmark"), "doc_id"))


@query("""WITH r AS (SELECT unnest(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'missing:license' END, CASE WHEN doc_id % 5 = 0 THEN 'missing:image' END,
CASE WHEN NOT (toxic = 0) AND quality = 0 THEN 'bug without issues' END], lambda x: x IS NOT NULL)) AS error FROM labels) SELECT error, count(*) AS n FROM r GROUP BY error""")
def manifest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    raw = F.to_json(F.struct(d.alias("id"), F.when(d % 3 != 0, "mit").alias("license"), F.when(d % 5 != 0, "i").alias("image")))
    made = table(spark, sf_dir, "labels").select(
        F.monotonically_increasing_id().alias("id"), F.lit("i").alias("image"), (F.col("toxic") == 0).alias("clean"),
        F.when(F.col("toxic") == 1, F.array(F.lit("tone"))).otherwise(F.array().cast("array<string>")).alias("gold_types"),
        F.col("quality").alias("n_issues"), F.lit(True).alias("within_screen"), F.lit("natural").alias("provenance"), F.lit("").alias("planted_from"), raw.alias("raw"),
    )
    return validate.count_errors(validate.manifest_errors(made, raw="raw", required=["id", "license", "image"]))


def _model(prompts: list[str]) -> list[str]:
    """Answers with an edit, refuses prompts that begin with a T, and prattles on every third length."""
    if any(p[:1] == "T" for p in prompts):
        raise RuntimeError("no T")
    return ["well" if len(p) % 3 == 0 else "Here: " + json.dumps({"rewrite": p + "!", "reason": "louder"}) for p in prompts]


@query("""WITH u AS (SELECT conv_id, turn, text AS p FROM conversations WHERE role = 'user' AND text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN p[1] = 'T' OR length(p) % 3 = 0 THEN '' ELSE p || '!' END AS suggested_copy,
CASE WHEN p[1] = 'T' THEN 'request failed: no T' WHEN length(p) % 3 = 0 THEN 'well' ELSE 'louder' END AS reason,
CASE WHEN p[1] = 'T' THEN 'endpoint_error' WHEN length(p) % 3 = 0 THEN 'Model returned non-JSON output.' ELSE '' END AS risk FROM u""")
def review_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("p"))
    return review.review(asked, "p", _model).drop("p")


def _fussy(prompts: list[str]) -> list[str]:
    if any(p.startswith("T") for p in prompts):
        raise ValueError("no T")
    return ["first " + p for p in prompts]


@query("""SELECT conv_id, turn, CASE WHEN text[1] = 'T' THEN 'second ' ELSE 'first ' END || text AS reply, CASE WHEN text[1] = 'T' THEN 2 ELSE 1 END AS tries, CAST(NULL AS VARCHAR) AS error
FROM conversations WHERE role = 'user' AND text IS NOT NULL""")
def review_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with a model that fails on some rows, and a later one that asks for those alone."""
    rows, path = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", "text"), _checkpoint(spark)
    retries.answered(rows, ["conv_id", "turn"], "text", _fussy, path, tries=1, shares=1, at_once=8)
    second = retries.answered(rows, ["conv_id", "turn"], "text", lambda prompts: ["second " + p for p in prompts], path, tries=2, shares=1, at_once=8)
    return second.drop("text")


@query("""SELECT conv_id, turn, text AS rewrite, 'kept' AS reason, '' AS dry FROM conversations WHERE role = 'user' AND text IS NOT NULL""")
def review_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("p"))
    dry = review.review(asked, "p").withColumnRenamed("suggested_copy", "dry").drop("reason", "risk")
    return review.predictions(review.asked(dry, review.identity, "p")).select("conv_id", "turn", "rewrite", "reason", "dry")


@query("""SELECT CAST(turn % 4 AS INT) AS k, count(*) AS n, count(*) FILTER (WHERE turn % 4 IN (0, 1) OR turn % 4 = 3 AND turn > 4) AS valid FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def reply_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that hold an object, think before it, hold two, or break off; late ones of the last kind have no rewrite."""
    k = F.col("turn") % 4
    one = F.to_json(F.struct(F.col("text").alias("rewrite")))
    raw = F.when(k == 0, F.concat(F.lit("So: "), one)).when(k == 1, F.concat(F.lit("<think>{"), F.lit("</think>"), one)).when(k == 2, F.concat(one, F.lit(","), one))
    raw = raw.when(F.col("turn") > 4, F.lit('{"rewrite": ""}')).otherwise(F.lit('{"rewrite": 1}'))
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(k.cast("int").alias("k"), contract.valid_reply(raw).alias("ok"))
    return turns.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("valid"))


@query(f"""WITH j AS (SELECT doc_id, {_GOLD} AS g, {_FLAGS} AS p, lang FROM labels JOIN documents USING (doc_id)),
b AS (SELECT doc_id, g, lang, 'adapter' AS system, p FROM j UNION ALL SELECT doc_id, g, lang, 'base', CASE WHEN doc_id % 5 = 0 THEN [] ELSE list_concat(p, ['tone']) END FROM j),
s AS (SELECT system, unnest(list_filter(['full', CASE WHEN lang = 'en' THEN 'natural' END, CASE WHEN len(g) >= 2 THEN 'multi' END, CASE WHEN list_contains(g, 'casing') THEN 'type:casing' END,
  CASE WHEN list_contains(g, 'tone') THEN 'type:tone' END], lambda x: x IS NOT NULL)) AS slice, len(list_intersect(g, p)) AS tp, len(g) - len(list_intersect(g, p)) AS fn FROM b WHERE len(g) > 0),
f AS (SELECT system, slice, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, count(*) AS n FROM s GROUP BY ALL),
w AS (SELECT * FROM (VALUES ('natural'), ('full'), ('multi'), ('type:casing'), ('type:tone'), ('type:brand')) x(slice), (VALUES ('adapter'), ('base')) y(system))
SELECT system, slice, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) WHEN starts_with(slice, 'type:') THEN NULL ELSE 0 END AS recall,
CAST(NULL AS BIGINT) AS over_flags, coalesce(n, 0) AS n FROM w LEFT JOIN f USING (system, slice)
UNION ALL SELECT system, 'clean', NULL, NULL, NULL, CAST(sum(len(p)) AS BIGINT), count(*) FROM b WHERE len(g) = 0 GROUP BY system""")
def two_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of documents as one system, and outputs in JSON, some of them broken, as another one."""
    seen = _judged(spark, sf_dir).withColumnsRenamed({"g": "gold", "p": "a"}).withColumn("clean", F.size("gold") == 0)
    issue = lambda t: F.struct(t.alias("type"), F.array(F.lit("x")).alias("strings"), F.lit("p").alias("problem"), F.lit("f").alias("fix"))
    out = F.to_json(F.struct(F.array(F.lit("x")).alias("inventory"), F.transform(F.concat("a", F.array(F.lit("tone"))), issue).alias("issues")))
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(out, F.lit(" and so on"))).otherwise(out)
    whole = F.from_json(contract.object_text(F.col("raw")), "issues array<struct<type:string>>")
    seen = seen.withColumn("raw", raw).withColumns({"b": contract.raw_types(F.col("raw")), "n_b": F.coalesce(F.size(whole["issues"]), F.lit(0)), "n_a": F.size("a")})
    found = score.two_systems(seen, {"adapter": ("a", "n_a"), "base": ("b", "n_b")}, F.col("lang") == "en", ("casing", "tone", "brand"))
    return found.withColumn("recall", F.round("recall", 6))


@query("""SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'quality' END AS bucket, count(*) FILTER (WHERE doc_id % 3 > 0) AS ok, count(*) AS total
FROM labels WHERE toxic = 1 OR quality = 0 GROUP BY 1""")
def failure_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.ok_of_total(table(spark, sf_dir, "labels"), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "quality"), F.col("doc_id") % 3 > 0)


@query("""SELECT page_id, 'Product surface: web' || chr(10) || 'Audience: general product user' || chr(10) || 'User state: interacting with this empty state' || chr(10) || 'Content type: empty_state' || chr(10)
|| 'Current copy: ' || url || chr(10) || 'Code/context:' || chr(10) || url || chr(10) || 'Constraints: Preserve the intended product behavior.' AS prompt,
CASE WHEN CAST(('0x' || right(sha1(CAST(page_id AS VARCHAR) || '|finetune|base'), 1)) AS INT) % 2 = 0 THEN 'finetune' ELSE 'base' END AS a_is FROM pages""")
def brief_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    briefs = table(spark, sf_dir, "pages")
    made = rows.brief_prompt(F.lit("empty_state"), F.lit("web"), F.col("url"))
    return briefs.select("page_id", made.alias("prompt"), arena.dealt_arm(F.col("page_id").cast("string")).alias("a_is"))


@query("SELECT page_id, url FROM pages ORDER BY sha1('camp' || CAST(page_id AS VARCHAR)) LIMIT 1")
def brief_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.drawn(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("page_id"), "camp")


@query(f"WITH {_SHEET} SELECT id, a_is, b_is FROM sheet")
def ab_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.after_vote(_sheet(spark, sf_dir), "id")


@query("""SELECT item_id, 'Product surface: existing codebase' || chr(10) || 'Audience: product user' || chr(10) || 'User state: using the screen that contains b/' || item_id || '.ts:' || (item_id % 9) || chr(10)
|| 'Content type: body_copy' || chr(10) || 'Current copy: ' || text || chr(10) || 'Code/context:' || chr(10) || '1: ' || text || chr(10)
|| 'Constraints: Suggest a UX writing rewrite only if the context supports it. Preserve the intended product behavior.' AS prompt FROM benchmark""")
def review_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    path = F.concat(F.lit("b/"), F.col("item_id").cast("string"), F.lit(".ts"))
    made = rows.review_prompt(path, F.col("item_id") % 9, F.lit("body_copy"), F.col("text"), F.concat(F.lit("1: "), F.col("text")))
    return items.select("item_id", made.alias("prompt"))


@query("""SELECT CAST(page_id AS VARCHAR) AS id, 'consistency' AS task, 'vision' AS modality, 'synthetic' AS source, 'train' AS split, 'screens/' || page_id || '.png' AS image,
CASE WHEN page_id % 2 = 0 THEN 'mit' ELSE 'cc0' END AS license FROM pages""")
def vision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("page_id").cast("string")
    source = lambda name: F.struct(F.lit(name).alias("license"))
    made = table(spark, sf_dir, "pages").select(
        id_.alias("id"), F.array(F.struct(F.lit("user").alias("role"), F.col("url").alias("content"))).alias("messages"),
        F.create_map(F.lit("k"), F.lit("v")).alias("metadata"), F.when(F.col("page_id") % 2 == 0, source("mit")).alias("provenance"),
    )
    tagged = rows.tagged(made, "consistency", "vision", F.lit("synthetic"), "train", F.concat(F.lit("x/y/"), F.col("id"), F.lit(".png")), source("cc0"))
    stored = rows.storage(tagged)
    return stored.select("id", "task", "modality", "source", "split", "image", F.from_json("provenance_json", "license string")["license"].alias("license"))


@query("""SELECT u.conv_id, u.turn, a.text AS a, b.text || '!' AS b FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
JOIN conversations b ON b.conv_id = u.conv_id AND b.turn = u.turn + 1 AND b.role = 'assistant' AND b.conv_id % 3 > 0 WHERE u.role = 'user' AND u.conv_id % 4 > 0""")
def two_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    bench = turns.where("role = 'user' AND conv_id % 4 > 0").select("conv_id", "turn")
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    other = said.where("conv_id % 3 > 0").withColumn("prediction", F.concat("prediction", F.lit("!")))
    return arena.paired(bench, said, other, ["conv_id", "turn"])
