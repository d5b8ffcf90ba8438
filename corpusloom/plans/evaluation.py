"""Queries over conversations, labels, events and embeddings: scores, votes, costs, norms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import arena, cost, rows, score, split, tensors
from corpusloom.plans.extraction import TAG_TEXTS_SQL, tag_texts
from corpusloom.plans.registry import query, table
from corpusloom.streaming import votes

_W = "regexp_extract_all(lower(coalesce({0}, '')), '[A-Za-z][A-Za-z''-]+')"
_IN = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_LIST = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"


def _metrics_sql(current: str, rewrite: str, category: str) -> str:
    low, words = f"lower(trim(coalesce({rewrite}, '')))", _W.format(rewrite)
    generic = f"{low} IN {_IN(score.GENERIC)}"
    return f"""CASE WHEN {generic} THEN 0.0::DOUBLE ELSE 1.0 END AS not_generic,
 CASE WHEN len({words}) <= 12 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - (len({words}) - 12)::DOUBLE / 12) END AS concise,
 CASE WHEN len(list_intersect({words}, {_LIST(score.SPECIFIC)})) > 0 THEN 1.0::DOUBLE ELSE 0.5 END AS specific_action,
 CASE WHEN len(list_intersect({words}, {_LIST(score.BLAME)})) > 0 AND {category} <> 'inline_error' THEN 0.0::DOUBLE ELSE 1.0 END AS no_blame,
 CASE WHEN {low} = array_to_string({_W.format(current)}, ' ') AND {generic} THEN 0.0::DOUBLE ELSE 1.0 END AS changed_when_needed"""


_PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS current, a.text AS rewrite, CASE WHEN u.conv_id % 3 = 0 THEN 'inline_error' ELSE 'body' END AS category
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""
_SCORED = f"{_PAIRS}, scored AS (SELECT *, (not_generic + concise + specific_action + no_blame + changed_when_needed) / 5 AS overall FROM (SELECT conv_id, turn, category, rewrite, {_metrics_sql('current', 'rewrite', 'category')} FROM pairs))"
_MEANS = ", ".join(f"round(avg({m}), 4) AS {m}" for m in score.METRICS)
_SUM = " + ".join(score.METRICS)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn after them, null where there is none."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("current"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("rewrite"))
    return asked.join(said, ["conv_id", "turn"], "left").withColumn("category", F.when(F.col("conv_id") % 3 == 0, "inline_error").otherwise("body"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.rewrite_metrics(_pairs(spark, sf_dir), F.col("current"), F.col("rewrite"), F.col("category"))


@query(f"WITH {_SCORED} SELECT conv_id, turn, round(concise, 6) AS concise, not_generic, specific_action, no_blame, changed_when_needed, round(overall, 6) AS overall FROM scored WHERE rewrite IS NOT NULL")
def rewrite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _scored(spark, sf_dir).where("rewrite IS NOT NULL")
    return rated.select("conv_id", "turn", F.round("concise", 6).alias("concise"), "not_generic", "specific_action", "no_blame", "changed_when_needed", F.round("overall", 6).alias("overall"))


@query(f"""WITH {_SCORED}, g AS (SELECT category, count(*) AS n_rows, {_MEANS} FROM scored WHERE rewrite IS NOT NULL GROUP BY category
UNION ALL SELECT '*', count(*), {_MEANS} FROM scored WHERE rewrite IS NOT NULL) SELECT *, round(({_SUM}) / 5, 4) AS overall FROM g""")
def rewrite_score_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _scored(spark, sf_dir).where("rewrite IS NOT NULL")
    return score.mean_metrics(rated, ["category"], total="*")


@query(f"""WITH {_SCORED}, h AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE rewrite IS NULL) AS n_missing,
{", ".join(f"round(avg(CASE WHEN rewrite IS NULL THEN 0.0::DOUBLE ELSE {m} END), 4) AS {m}" for m in score.METRICS)} FROM scored) SELECT *, round(({_SUM}) / 5, 4) AS overall FROM h""")
def honest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = score.honest(_scored(spark, sf_dir), F.col("rewrite").isNotNull())
    missing = rated.agg(F.count_if(F.col("rewrite").isNull()).alias("n_missing"))
    return score.mean_metrics(rated).crossJoin(F.broadcast(missing))


@query(f"""WITH {_PAIRS}, f AS (SELECT current, coalesce(nullif(rewrite, ''), upper(current)) AS rewrite, category FROM pairs),
s AS (SELECT {_metrics_sql('current', 'rewrite', 'category')} FROM f), h AS (SELECT count(*) AS n_rows, {_MEANS} FROM s) SELECT *, round(({_SUM}) / 5, 4) AS overall FROM h""")
def gold_fallback_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.coalesce(F.nullif("rewrite", F.lit("")), F.upper("current"))
    pairs = _pairs(spark, sf_dir).withColumn("rewrite", filled)
    return score.mean_metrics(score.rewrite_metrics(pairs, F.col("current"), F.col("rewrite"), F.col("category")))


@query(f"""WITH {_SCORED}, m AS (SELECT category, turn % 2 AS k, overall FROM scored) SELECT category, round(avg(overall) FILTER (WHERE k = 0), 6) AS even, round(avg(overall) FILTER (WHERE k = 1), 6) AS odd,
round(avg(overall) FILTER (WHERE k = 1) - avg(overall) FILTER (WHERE k = 0), 6) AS delta FROM m GROUP BY category""")
def model_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _scored(spark, sf_dir).withColumn("model", F.when(F.col("turn") % 2 == 0, "even").otherwise("odd"))
    return score.by_model(rated, ["even", "odd"]).select("category", *[F.round(c, 6).alias(c) for c in ("even", "odd", "delta")])


_GOLD = "CASE WHEN quality = 0 AND toxic = 1 THEN ['casing', 'tone'] WHEN quality = 0 THEN ['casing'] WHEN toxic = 1 THEN ['tone'] ELSE [] END"
_FLAGS = """list_filter([CASE WHEN regexp_matches(text, '[A-Z]{4}') THEN 'casing' END, CASE WHEN regexp_matches(text, '(?i)idiot|stupid|trash') THEN 'tone' END], lambda x: x IS NOT NULL)"""
_JUDGED = f"j AS (SELECT doc_id, {_GOLD} AS g, {_FLAGS} AS p, lang FROM labels JOIN documents USING (doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_compact(F.array(F.when(F.col("text").rlike("[A-Z]{4}"), "casing"), F.when(F.col("text").rlike("(?i)idiot|stupid|trash"), "tone")))
    gold = F.array_compact(F.array(F.when(F.col("quality") == 0, "casing"), F.when(F.col("toxic") == 1, "tone")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", found.alias("p"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", gold.alias("g")), "doc_id")


@query(f"""WITH {_JUDGED}, s AS (SELECT unnest(list_filter(['full', CASE WHEN lang = 'en' THEN 'natural' END, CASE WHEN len(g) >= 2 THEN 'multi' END, CASE WHEN list_contains(g, 'casing') THEN 'type:casing' END,
CASE WHEN list_contains(g, 'tone') THEN 'type:tone' END], lambda x: x IS NOT NULL)) AS slice, len(list_intersect(g, p)) AS tp, len(g) - len(list_intersect(g, p)) AS fn FROM j WHERE len(g) > 0)
SELECT slice, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / sum(tp + fn), 6) AS recall FROM s GROUP BY slice""")
def sliced_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score.slices(_judged(spark, sf_dir), "g", "p", F.col("lang") == "en", ("casing", "tone"))
    return found.withColumn("recall", F.round("recall", 6))


@query(f"WITH {_JUDGED} SELECT CAST(sum(len(p)) AS BIGINT) AS over_flags, count(*) AS n_clean FROM j WHERE len(g) = 0")
def clean_over_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.over_flags(_judged(spark, sf_dir), "g", F.size("p"))


_SIDE = "CAST(('0x' || right(sha1(CAST(conv_id * 100 + turn AS VARCHAR) || '|user|assistant'), 1)) AS INT) % 2"
_SHEET = f"""{_PAIRS}, sheet AS (SELECT conv_id * 100 + turn AS id, CASE WHEN {_SIDE} = 0 THEN current ELSE rewrite END AS option_a, CASE WHEN {_SIDE} = 0 THEN rewrite ELSE current END AS option_b,
CASE WHEN {_SIDE} = 0 THEN 'user' ELSE 'assistant' END AS a_is, CASE WHEN {_SIDE} = 0 THEN 'assistant' ELSE 'user' END AS b_is FROM pairs WHERE rewrite IS NOT NULL)"""


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).where("rewrite IS NOT NULL").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    return arena.blind(pairs, "id", "current", "rewrite", "user", "assistant")


@query(f"WITH {_SHEET} SELECT id, sha256(option_a) AS option_a, sha256(option_b) AS option_b FROM sheet")
def ab_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.before_vote(_sheet(spark, sf_dir)).select("id", F.sha2("option_a", 256).alias("option_a"), F.sha2("option_b", 256).alias("option_b"))


@query(f"""WITH {_SHEET}, v AS (SELECT id, a_is, b_is, ['A', 'option b', 'Tie', 'both bad', '', '?'][1 + id % 6] AS said FROM sheet)
SELECT id, CASE id % 6 WHEN 0 THEN a_is WHEN 1 THEN b_is WHEN 2 THEN 'tie' WHEN 3 THEN 'both_bad' END AS winner FROM v WHERE id % 6 < 4""")
def ab_unblind(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = F.array(*[F.lit(x) for x in ("A", "option b", "Tie", "both bad", "", "?")])
    sheet, key = _sheet(spark, sf_dir).select("id"), _sheet(spark, sf_dir).select("id", "a_is", "b_is")
    filled = sheet.withColumn("choice", arena.choice(F.element_at(answers, (F.col("id") % 6 + 1).cast("int")))).where("choice IS NOT NULL")
    return filled.join(key, "id").select("id", arena.winner(F.col("choice"), F.col("a_is"), F.col("b_is")).alias("winner"))


_CHOICES = {"click": "finetune", "view": "base", "purchase": "tie", "signup": "both_bad"}
_WINNER = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CHOICES.items()) + " END"
_TALLY = f"t AS (SELECT w.winner, count(e.winner) AS n FROM (VALUES ('finetune'), ('base'), ('tie'), ('both_bad')) w(winner) LEFT JOIN (SELECT {_WINNER} AS winner FROM events) e USING (winner) GROUP BY 1)"


def _winner():
    out = F.lit(None).cast("string")
    for kind, w in _CHOICES.items():
        out = F.when(F.col("event_type") == kind, w).otherwise(out)
    return out


def _tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.tally(table(spark, sf_dir, "events").select(_winner().alias("winner")))


@query(f"WITH {_TALLY} SELECT winner, n, CAST(greatest(4, round(100 * n / greatest(1, max(n) OVER ()))) AS INT) AS width FROM t")
def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.bars(_tally(spark, sf_dir))


@query(f"""WITH {_TALLY} SELECT CAST(sum(n) FILTER (WHERE winner IN ('finetune', 'base')) AS BIGINT) AS decisive,
round(sum(n) FILTER (WHERE winner = 'finetune') / sum(n) FILTER (WHERE winner IN ('finetune', 'base')), 6) AS win_rate FROM t""")
def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.win_rate(_tally(spark, sf_dir)).select("decisive", F.round("win_rate", 6).alias("win_rate"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream. A file source reads folders and patterns, so the one file is given as a pattern."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@query("SELECT event_type AS winner, count(*) AS n FROM events GROUP BY 1")
def vote_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = votes.running_tally(_stream(spark, sf_dir), "event_type")
    return votes.drained(counted, "complete", _checkpoint(spark))


@query("""SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type AS winner, count(*) AS n FROM events GROUP BY ALL""")
def vote_stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = votes.windowed_tally(_stream(spark, sf_dir), "ts", "365 days", "1 day", "event_type")
    day = F.date_format("start", "yyyy-MM-dd")
    out = votes.drained(counted, "complete", _checkpoint(spark))
    return out.select(day.alias("day"), "winner", "n")


def _checkpoint(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder; a local one only where none is named."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{shared}/stream-{uuid.uuid4()}" if shared else tempfile.mkdtemp()


_RUN = """r AS (SELECT count(*) AS strings, CAST(sum(greatest(1, length(current) // 4)) AS BIGINT) AS prompt_tokens, CAST(sum(greatest(1, length(coalesce(rewrite, '')) // 4)) AS BIGINT) AS completion_tokens,
count(*) FILTER (WHERE rewrite IS NOT NULL) AS valid_json, count(*) FILTER (WHERE rewrite IS NOT NULL AND turn % 4 = 0) AS changed FROM pairs)"""


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumns({"p": T.estimated_tokens(F.col("current")), "c": T.estimated_tokens(F.col("rewrite"))})
    valid = F.col("rewrite").isNotNull()
    return cost.run_summary(pairs, "p", "c", valid, valid & (F.col("turn") % 4 == 0), 90.0, 10.0, 2.5)


@query(f"""WITH {_PAIRS}, {_RUN} SELECT strings, prompt_tokens, completion_tokens, valid_json, changed, strings - changed AS kept, CAST(round(strings / 90.0 * 3600) AS BIGINT) AS strings_per_hour,
round(1000 / (strings::DOUBLE / 90 * 3600) * 2.5, 2) AS usd_per_1k_strings, 0.07::DOUBLE AS measured_usd FROM r""")
def throughput_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)


_PRICES = [("small", 10.0, 40.0), ("medium", 300.0, 1500.0), ("large", 1500.0, 7500.0)]


@query(f"""WITH {_PAIRS}, {_RUN}, p(model, i, o) AS (VALUES {", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in _PRICES)}),
u AS (SELECT model, round(prompt_tokens::DOUBLE / 1e6 * i + completion_tokens::DOUBLE / 1e6 * o, 2) AS usd, strings FROM p CROSS JOIN r)
SELECT model, usd, round(usd / strings * 1000, 2) AS usd_per_1k_strings, round(usd / 0.07::DOUBLE, 1) AS multiple FROM u""")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame(_PRICES, "model string, input double, output double")
    return cost.at_list_prices(_run(spark, sf_dir), prices)


@query("""SELECT batch, tokens, CAST(sum(tokens) OVER (ORDER BY batch) AS BIGINT) AS total_tokens FROM
(SELECT conv_id // 16 AS batch, CAST(sum(greatest(1, length(coalesce(text, '')) // 4)) AS BIGINT) AS tokens FROM conversations GROUP BY 1)""")
def running_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "conversations").groupBy(F.floor(F.col("conv_id") / 16).alias("batch")).agg(F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"))
    return cost.running_totals(batches, "batch", ["tokens"])


@query("""SELECT lang, x, n, round(x / n, 6) AS share, round((x / n + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 / (1 + 3.8416 / n) * sqrt(x / n * (1 - x / n) / n + 3.8416 / (4.0 * n * n)), 6) AS low,
round((x / n + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 / (1 + 3.8416 / n) * sqrt(x / n * (1 - x / n) / n + 3.8416 / (4.0 * n * n)), 6) AS high
FROM (SELECT lang, count(*) FILTER (WHERE toxic = 1) AS x, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    found = cost.rates(judged, ["lang"], F.col("toxic") == 1)
    return found.select("lang", "x", "n", *[F.round(c, 6).alias(c) for c in ("share", "low", "high")])


@query("""WITH k AS (SELECT CASE WHEN toxic = 1 THEN 'error_toxic' WHEN quality = 0 THEN 'error_quality' ELSE 'clean' END AS label FROM labels), g AS (SELECT label, count(*) AS n FROM k GROUP BY label)
SELECT * FROM g UNION ALL SELECT 'error*', CAST(sum(n) AS BIGINT) FROM g WHERE starts_with(label, 'error')""")
def disposition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "error_toxic").when(F.col("quality") == 0, "error_quality").otherwise("clean")
    return cost.rollup_prefix(table(spark, sf_dir, "labels").select(label.alias("label")), "label", "error")


_CELL = "list_sum(list_transform(range(0, 8), lambda k: b.embedding[8 * {i} + k + 1]::DOUBLE * a.embedding[8 * k + {j} + 1]::DOUBLE))"
_NORM = "sqrt(" + " + ".join(f"pow({_CELL.format(i=i, j=j)}, 2)" for i in range(8) for j in range(8)) + ")"


@query(f"""SELECT layer, module, round(norm, 5) AS norm, round(norm / max(norm) OVER (), 5) AS intensity FROM
(SELECT CAST(a.vec_id // 2 AS INT) AS layer, 'm' AS module, {_NORM} AS norm FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1)""")
def lora_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("base.layers."), F.floor(F.col("vec_id") / 2).cast("string"), F.lit(".m.lora_"), F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B"), F.lit(".weight"))
    factors = tensors.pair_factors(table(spark, sf_dir, "embeddings").select(name.alias("name"), F.col("embedding").alias("data")))
    norms = factors.select("layer", "module", tensors.low_rank_norm(F.col("a"), F.col("b"), 8).alias("norm"))
    return tensors.intensities(norms).select("layer", "module", F.round("norm", 5).alias("norm"), F.round("intensity", 5).alias("intensity"))


@query("""SELECT CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'vision' ELSE 'language' END AS tower, lang AS suffix, count(*) AS n FROM documents GROUP BY ALL""")
def module_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select(F.concat_ws(".", "source", "lang").alias("name"))
    tower = F.when(F.substring_index("name", ".", 1).isin("src0", "src1", "src2"), "vision").otherwise("language")
    return tensors.module_counts(names, tower)


@query(f"""SELECT page_id, v AS before, v || ' now' AS after FROM (SELECT DISTINCT page_id, v FROM {TAG_TEXTS_SQL}) WHERE length(v) BETWEEN 4 AND 60 AND length(v) + 4 <= 70 ORDER BY page_id, v LIMIT 48""")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 48 short edits, where every tag text is edited."""
    cands = tag_texts(spark, sf_dir).distinct().select("page_id", F.col("v").alias("current_copy"))
    preds = cands.select("page_id", "current_copy", F.concat("current_copy", F.lit(" now")).alias("suggested_copy"), F.lit("").alias("reason"), F.lit("").alias("risk"))
    done = rows.reviewed(cands, preds, ["page_id", "current_copy"]).withColumn("valid_json", F.lit(True))
    return rows.highlights(done, ["page_id", "current_copy"]).select("page_id", "before", "after")


@query("""SELECT slot, nation FROM (SELECT i AS slot, i % 25 AS k FROM range(0, 60) t(i)) JOIN (SELECT n_name AS nation, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) USING (k)""")
def row_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    return split.cycled(names, "n_nationkey", 60).select("slot", "nation")


@query("SELECT n_name, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 4 AS INT) AS page FROM nation")
def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.pages(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("n_name", "page")


@query("""SELECT source, is_new, CAST(row_number() OVER (ORDER BY is_new DESC, source) AS INT) AS place, n FROM
(SELECT source, source NOT IN ('src1', 'src10', 'src2') AS is_new, count(*) AS n FROM documents GROUP BY source)""")
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return score.new_first(counts, "source", ["src1", "src10", "src2"])
