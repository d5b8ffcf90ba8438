"""Queries over documents, benchmark and conversations: splits, gates, validation, row construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import leakage, rows, split, validate
from corpusloom.plans.registry import query, table

_COPY = "regexp_replace(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')"
_SPLIT = f"""
keyed AS (SELECT doc_id, lang, {_COPY} AS copy, sha1(concat_ws('::', lang, {_COPY})) AS k FROM documents),
held AS (SELECT DISTINCT k FROM keyed WHERE copy <> '' ORDER BY k LIMIT 60),
ranked AS (SELECT doc_id, lang, copy, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n, k IN (SELECT k FROM held) AS h FROM keyed),
parts AS (SELECT doc_id, lang, copy, CASE WHEN h THEN 'eval' ELSE 'train' END AS split FROM ranked WHERE (h AND n = 1) OR (NOT h AND n <= 3))
"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return split.split_dedup(docs, F.col("lang"), T.collapse(F.col("text")), "doc_id", eval_size=60, cap=3)


@query(f"WITH {_SPLIT} SELECT doc_id, split FROM parts")
def split_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("doc_id", "split")


@query(f"""WITH {_SPLIT}, shared AS (SELECT lang, copy FROM parts GROUP BY ALL HAVING count(DISTINCT split) > 1)
SELECT split, count(*) AS n_rows, CAST(count(DISTINCT (lang, copy)) AS BIGINT) AS n_keys, (SELECT count(*) FROM shared) AS n_shared FROM parts GROUP BY split""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).withColumn("key", F.sha1(F.concat_ws("::", "lang", T.collapse(F.col("text")))))
    shared = split.shared_keys(parts, F.col("key")).agg(F.count(F.lit(1)).alias("n_shared"))
    sizes = parts.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("key").alias("n_keys"))
    return sizes.crossJoin(F.broadcast(shared))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY 2")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return split.first_by(docs, [F.col("sha")], "doc_id")


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha"))
    return grouped.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("copies > 1")


@query("SELECT doc_id, lang FROM documents ORDER BY sha1('20260612' || CAST(doc_id AS VARCHAR)) LIMIT 200")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("doc_id"), 200, "20260612")


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z][A-Za-z''-]+')"
_PHRASES = "(SELECT {id}, array_to_string(w[i:i+13], ' ') AS phrase FROM (SELECT {id}, w, unnest(range(1, len(w) - 12)) AS i FROM (SELECT {id}, " + _WORDS + " AS w FROM {t})))"


@query(f"SELECT DISTINCT doc_id FROM {_PHRASES.format(id='doc_id', t='documents')} WHERE phrase IN (SELECT phrase FROM {_PHRASES.format(id='item_id', t='benchmark')})")
def contaminated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.copies_source(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"), "doc_id")


@query(f"SELECT item_id, CAST(count(DISTINCT phrase) AS BIGINT) AS n_phrases FROM {_PHRASES.format(id='item_id', t='benchmark')} GROUP BY item_id")
def copy_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.phrases(T.words(F.col("text")))).alias("phrase"))
    return items.groupBy("item_id").agg(F.count_distinct("phrase").alias("n_phrases"))


@query("""SELECT conv_id, CAST(sum(greatest(1, length(coalesce(text, '')) // 4)) AS BIGINT) AS tokens,
sum(greatest(1, length(coalesce(text, '')) // 4)) > 900 AS over_budget FROM conversations GROUP BY conv_id""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"))
    return tokens.withColumn("over_budget", F.col("tokens") > 900)


@query("""WITH f AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(coalesce(text, '') ORDER BY turn) AS texts,
  sum(greatest(1, length(coalesce(text, '')) // 4)) AS tokens FROM conversations GROUP BY conv_id),
e AS (SELECT unnest(CASE WHEN len(roles) <> 3 THEN ['messages'] ELSE
  list_filter([CASE WHEN roles <> ['system', 'user', 'assistant'] THEN 'roles' END, CASE WHEN tokens > 300 THEN 'tokens' END]
  || list_transform(range(1, 4), lambda i: CASE WHEN trim(texts[i]) = '' THEN 'empty:' || CAST(i - 1 AS VARCHAR) END), lambda x: x IS NOT NULL) END) AS error FROM f)
SELECT error, count(*) AS n FROM e GROUP BY error""")
def validate_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = validate.folded(table(spark, sf_dir, "conversations"))
    return validate.count_errors(chats.select(validate.chat_errors(F.col("messages"), 300).alias("errors")))


@query("""SELECT CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'vision' WHEN doc_id % 5 = 1 OR doc_id % 7 = 1 THEN 'text' WHEN lang = 'en' THEN 'text' ELSE 'vision' END AS modality,
lang, source, count(*) AS n FROM documents GROUP BY ALL""")
def modality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda n, a, b: F.when(F.col("doc_id") % n == 0, a).when(F.col("doc_id") % n == 1, b).otherwise("")
    kind = validate.modality(said(5, "vision", "text"), said(7, "consistency", "rewrite"), F.col("lang") != "en")
    docs = table(spark, sf_dir, "documents").withColumn("modality", kind)
    return docs.groupBy("modality", "lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, 'text' AS field FROM documents WHERE regexp_matches(text, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b')")
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.mail_fields(table(spark, sf_dir, "documents"), "doc_id", ["text"])


_DENIED = ("src1", "src3", "src17")


@query("""SELECT page_id, by_name, by_substrate FROM (SELECT page_id,
lower(regexp_replace(regexp_replace(url, '^.*/', ''), '^(.+)\\.[^.]*$', '\\1')) IN ('src1', 'src3', 'src17', '25', '825') AS by_name,
contains(lower(url), 'src1') OR contains(lower(url), 'src3') OR contains(lower(url), 'src17') OR contains(lower(url), '25') OR contains(lower(url), '825') AS by_substrate
FROM pages) WHERE by_name OR by_substrate""".replace("\\\\", "\\"))
def denylist_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return leakage.denied(pages, [*_DENIED, "25", "825"], F.col("url"), F.col("url")).select("page_id", "by_name", "by_substrate")


@query("""SELECT doc_id FROM documents WHERE source = 'src0' AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE source <> 'src0')""")
def hash_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the evaluation source whose content a training source has as well."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return leakage.same_content(docs.where("source = 'src0'"), docs.where("source <> 'src0'"), "text", "text").select("doc_id")


_UUID = """lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
substr('89ab', 1 + (CAST(('0x' || substr(h, 17, 1)) AS INT) % 4), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""
_NAMED = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({}))"


@query(f"SELECT doc_id, {_UUID} AS id FROM (SELECT doc_id, {_NAMED.format('lang || chr(58) || chr(58) || CAST(doc_id AS VARCHAR)')} AS h FROM documents)")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.stable_id(F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


_VARIANTS = [("web", "new users", "short"), ("mobile", "all users", "plain"), ("email", "owners", "warm"), ("cli", "developers", "exact")]


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.lit("body_copy").alias("category"), F.lit("bench").alias("area"), F.lit("reads").alias("state"),
        T.collapse(F.col("text")).alias("current"), F.concat(F.lit("New: "), T.collapse(F.col("text"))).alias("rewrite"), F.lit("newer").alias("reason"), F.lit("").alias("risk"),
        F.array(F.concat(F.lit("p"), (F.col("item_id") % 7).cast("string"))).alias("policy_ids"), "item_id",
    )


_TEXT = "regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')"


@query(f"""WITH v(surface, audience, cons) AS (VALUES {", ".join(map(str, _VARIANTS))}),
b AS (SELECT {_TEXT} AS c, 'New: ' || {_TEXT} AS r, item_id FROM benchmark)
SELECT {_UUID} AS id, user_text, answer, policy FROM (SELECT {_NAMED.format("'body_copy::' || c || '::' || surface")} AS h,
  'Surface: ' || surface || chr(10) || 'Audience: ' || audience || chr(10) || 'State: reads' || chr(10) || 'Type: body_copy' || chr(10) || 'Current copy: ' || c || chr(10)
  || 'Code: // on ' || surface || ', bench' || chr(10) || '<Button title="' || c || '">' || c || '</Button>' || chr(10) || 'Constraint: ' || cons AS user_text,
  r AS answer, 'p' || CAST(item_id % 7 AS VARCHAR) AS policy FROM b CROSS JOIN v)""")
def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = spark.createDataFrame(_VARIANTS, "surface string, audience string, constraint string")
    made = rows.chat_rows(_scenarios(spark, sf_dir), variants, "Answer in JSON.")
    answer = F.from_json(rows.gold_answer(F.col("messages")), "rewrite string")["rewrite"]
    return made.select("id", F.col("messages")[1]["content"].alias("user_text"), answer.alias("answer"), F.col("provenance.source_policy_ids")[0].alias("policy"))


@query(f"""WITH v(surface, audience, cons) AS (VALUES {", ".join(map(str, _VARIANTS))}), rules AS (SELECT i AS theme, 'p' || CAST(i AS VARCHAR) AS policy FROM range(0, 5) t(i))
SELECT item_id, policy, surface FROM benchmark JOIN rules ON item_id % 7 = theme CROSS JOIN v""")
def policy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(5).select(F.col("id").alias("theme"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("policy"))
    items = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 7).alias("theme"))
    variants = spark.createDataFrame(_VARIANTS, "surface string, audience string, constraint string").select("surface")
    return items.join(F.broadcast(rules), "theme").crossJoin(F.broadcast(variants)).select("item_id", "policy", "surface")


@query("""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS position FROM conversations""")
def turn_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = validate.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn"))
    return placed.select("conv_id", "turn", F.col("n").cast("long").alias("position"))


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE n <= 2) AS prompt, first(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS gold,
count(*) FILTER (WHERE role <> 'assistant') AS n_rest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id""")
def prompts_and_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    start = validate.folded(turns, most=2)
    first = F.array_join(F.transform(rows.prompt_part(F.col("messages")), lambda x: x["content"]), "\n")
    said = F.col("role") == "assistant"
    rest = turns.groupBy("conv_id").agg(F.min_by("text", F.when(said, F.col("turn"))).alias("gold"), F.count_if(~said).alias("n_rest"))
    return start.select("conv_id", first.alias("prompt")).join(rest, "conv_id").select("conv_id", "prompt", "gold", "n_rest")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, 'rewrite' AS task, 'text' AS modality, source, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, '' AS image,
lang AS messages_lang FROM documents""")
def storage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.array(F.struct(F.lit("user").alias("role"), F.col("lang").alias("content"))).alias("messages"),
        F.create_map(F.lit("n"), F.col("n_chars").cast("string")).alias("metadata"), F.struct(F.lit("x").alias("license")).alias("provenance"), "source", "doc_id",
    )
    made = rows.tagged(docs, "rewrite", "text", F.col("source"), "train").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    back = F.from_json("messages_json", "array<struct<role:string,content:string>>")[0]["content"]
    return rows.storage(made).select("id", "task", "modality", "source", "split", "image", back.alias("messages_lang"))


@query("""WITH m AS (SELECT doc_id % 350 AS id, toxic = 0 AS clean, CASE WHEN toxic = 1 THEN ['tone'] WHEN quality = 0 THEN ['odd'] ELSE [] END AS types,
  CASE WHEN doc_id % 5 = 0 THEN 'planted' WHEN doc_id % 5 = 1 THEN 'found' ELSE 'natural' END AS prov, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE '' END AS pf, doc_id % 3 AS n_issues FROM labels),
e AS (SELECT unnest(list_filter([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' END, CASE WHEN types = ['odd'] THEN 'unknown type' END,
  CASE WHEN prov = 'found' THEN 'provenance' END, CASE WHEN clean AND len(types) > 0 THEN 'clean with types' END, CASE WHEN NOT clean AND len(types) = 0 THEN 'bug without types' END,
  CASE WHEN NOT clean AND n_issues = 0 THEN 'bug without issues' END, CASE WHEN prov = 'planted' AND pf = '' THEN 'planted from nothing' END,
  CASE WHEN prov = 'natural' AND pf <> '' THEN 'natural but planted' END], lambda x: x IS NOT NULL)) AS error FROM m)
SELECT error, count(*) AS n FROM e GROUP BY error""")
def manifest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 5
    rows_ = table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % 350).alias("id"), F.lit("i").alias("image"), (F.col("toxic") == 0).alias("clean"),
        F.when(F.col("toxic") == 1, F.array(F.lit("tone"))).when(F.col("quality") == 0, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("gold_types"),
        (F.col("doc_id") % 3).alias("n_issues"), F.lit(True).alias("within_screen"),
        F.when(d == 0, "planted").when(d == 1, "found").otherwise("natural").alias("provenance"), F.when(F.col("doc_id") % 10 == 0, "x").otherwise("").alias("planted_from"),
    )
    return validate.count_errors(validate.manifest_errors(rows_))


@query("""SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)""")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    return leakage.not_done(events, events.where("event_id % 3 = 0"), "event_id")


@query("""SELECT a.p AS position, doc_id, item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents) a
JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS p FROM benchmark) b ON a.p = b.p""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.by_position(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "benchmark").select("item_id"), "item_id")


@query("""SELECT name, first_source FROM (SELECT doc_id % 400 AS name, min(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END) AS p FROM documents GROUP BY 1) JOIN (VALUES (0, 'even'), (1, 'odd')) t(p, first_source) USING (p)""")
def screen_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = [docs.where(F.col("doc_id") % 2 == k).select((F.col("doc_id") % 400).alias("name"), F.lit(w).alias("first_source")) for k, w in ((0, "even"), (1, "odd"))]
    return leakage.by_priority(parts, "name")


@query("""SELECT source, string_agg('- ' || lang, chr(10) ORDER BY lang) AS rubric FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source""")
def rubric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "documents").select("source", "lang", F.col("lang").alias("o")).distinct()
    return rows.rubric(rules, "source", "lang", "o")


@query("""SELECT url, 'oss_n' || CASE WHEN r < 10 THEN '0' ELSE '' END || CAST(r AS VARCHAR) AS id FROM (SELECT url, row_number() OVER (ORDER BY url) AS r FROM (SELECT DISTINCT url FROM pages))""")
def named_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by the order of names."""
    placed = split.ranked(table(spark, sf_dir, "pages").select("url").distinct(), "url", "r")
    return rows.numbered_ids(placed, F.lit("oss"), F.col("r")).select("url", "id")


@query("""SELECT page_id, 'oss_n' || CASE WHEN r < 10 THEN '0' ELSE '' END || CAST(r AS VARCHAR) AS id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS r FROM pages)""")
def numbered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = split.ranked(table(spark, sf_dir, "pages").select("page_id"), "page_id", "r")
    return rows.numbered_ids(placed, F.lit("oss"), F.col("r")).select("page_id", "id")
