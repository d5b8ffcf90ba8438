"""Queries of readers, sinks and streams: a given table is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import arena, leakage, score, tensors, validate
from corpusloom.plans.evaluation import _SHEET, _checkpoint, _sheet, _stream
from corpusloom.plans.registry import query, table
from corpusloom.sources import committed, readers, tensor_files, workbooks, writers
from corpusloom.streaming import sessions


@query("SELECT event_type AS winner, count(*) AS n FROM events GROUP BY 1")
def vote_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the votes were counted by a batch scan; the stream has all of them, and comes twice."""
    path = _checkpoint(spark)
    vote = ["cast(user_id AS string) AS session", "cast(event_id AS string) AS vote", "event_type AS winner", "ts"]
    for _ in range(2):
        stream = _stream(spark, sf_dir).selectExpr(*vote)
        before = table(spark, sf_dir, "events").where("event_id % 3 = 0").selectExpr(*vote)
        sessions.resume(stream, f"{path}/tally", f"{path}/checkpoint", lambda: before, late="800 days", shares=2)
    return sessions.totals(spark, f"{path}/tally")


@query("SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS n_ids, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def append_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that ended after a third of the documents, one that does the rest, and one that is not needed."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), _checkpoint(spark)
    for part in (docs.where("doc_id % 3 = 0"), docs, docs):
        writers.append_missing(part, path, "doc_id")
    done = readers.jsonl(spark, path, "doc_id bigint, lang string, text string")
    return done.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_ids"), F.sum(F.length("text")).alias("chars"))


@query("SELECT CAST(doc_id % 7 AS BIGINT) AS k, count(*) AS n FROM documents GROUP BY 1")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each seventh of the documents, all asked for twice; the log has what each wrote."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang"), _checkpoint(spark)
    for k in [*range(7), *range(7)]:
        part = docs.where(F.col("doc_id") % 7 == k)
        committed.commit({"rows": (part, committed.json_line(part), path)}, path, job=f"job-{k}")
    return committed.jobs(spark, path).select(F.substring_index("job", "-", -1).cast("long").alias("k"), F.col("rows")["rows"].alias("n"))


@query(f"WITH {_SHEET} SELECT id, sha256(option_a) AS option_a, a_is, b_is, '' AS preferred FROM sheet")
def sheet_with_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _checkpoint(spark)
    writers.sheets(_sheet(spark, sf_dir), f"{path}/sheet", f"{path}/key", "id", [])
    both = readers.csv(spark, f"{path}/sheet").join(readers.csv(spark, f"{path}/key"), "id")
    return both.select(F.col("id").cast("long").alias("id"), F.sha2("option_a", 256).alias("option_a"), "a_is", "b_is", F.coalesce("preferred", F.lit("")).alias("preferred"))


def _tensors(spark: SparkSession, sf_dir: str) -> str:
    """The embeddings as tensor files: even ones are the factors A of layers, odd ones the factors B."""
    path = _checkpoint(spark)
    name = F.concat(F.lit("base.layers."), F.floor(F.col("vec_id") / 2).cast("string"), F.lit(".m.lora_"), F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B"))
    tensor_files.write(table(spark, sf_dir, "embeddings").select(name.alias("name"), F.array(F.lit(8), (F.size("embedding") / 8).cast("int")).alias("shape"), F.col("embedding").alias("data")), path)
    return path


@query("""SELECT CAST(vec_id // 2 AS INT) AS layer, CAST(len(embedding) AS BIGINT) AS n, CAST(ceil(len(embedding) / 20) AS BIGINT) AS n_slices,
embedding[1]::DOUBLE AS head, embedding[-1]::DOUBLE AS last, list_max(embedding)::DOUBLE AS peak FROM embeddings WHERE vec_id % 2 = 0""")
def tensor_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors A alone, 20 elements at a time."""
    found = tensor_files.slices(spark, _tensors(spark, sf_dir), 80, partitionbytes="1000000").where(F.col("name").endswith(".lora_A"))
    return found.groupBy(F.regexp_extract("name", r"layers\.(\d+)\.", 1).cast("int").alias("layer")).agg(
        F.sum(F.size("data")).alias("n"), F.count(F.lit(1)).alias("n_slices"), F.min_by(F.get("data", F.lit(0)), "first").cast("double").alias("head"),
        F.max_by(F.element_at("data", -1), "first").cast("double").alias("last"), F.max(F.array_max("data")).cast("double").alias("peak"),
    )


@query("SELECT CAST(1 AS BIGINT) AS n_modules, CAST(max(vec_id) // 2 + 1 AS BIGINT) AS n_layers FROM embeddings")
def adapter_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules and layers, from headers alone."""
    names = tensor_files.listing(spark, _tensors(spark, sf_dir))
    parts = names.select(F.regexp_extract("name", r"layers\.(\d+)\.", 1).cast("int").alias("layer"), F.regexp_extract("name", r"\.(\w+)\.lora_", 1).alias("module"))
    return tensors.extent(parts)


@query("""SELECT CAST(vec_id % 5 AS INT) AS layer, vec_id, round(n / max(n) OVER (PARTITION BY vec_id % 5), 6) AS share
FROM (SELECT vec_id, list_max(embedding)::DOUBLE AS n FROM embeddings)""")
def layer_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 5).cast("int").alias("layer"), F.array_max("embedding").cast("double").alias("norm"))
    return tensors.peak_share(peaks, "layer").select("layer", "vec_id", F.round("share", 6).alias("share"))


@query("SELECT CAST(vec_id // 2 AS INT) AS layer, CAST(vec_id AS VARCHAR) AS module FROM embeddings ORDER BY list_max(embedding) DESC, 1, 2 LIMIT 1")
def hottest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 2).cast("int").alias("layer"), F.col("vec_id").cast("string").alias("module"), F.array_max("embedding").alias("norm")
    )
    return tensors.hottest(cells).select("layer", "module")


@query("""WITH s AS (SELECT doc_id, source || '/' || (doc_id % 50) AS screen FROM documents)
SELECT DISTINCT screen FROM s WHERE screen NOT IN (SELECT screen FROM s WHERE doc_id < 50)""")
def missing_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")).alias("screen"))
    return leakage.missing(docs, docs.where("doc_id < 50").select("screen").distinct(), "screen")


@query("SELECT lang, source, max(doc_id) AS doc_id FROM documents WHERE (lang, source) IN (SELECT lang, source FROM documents WHERE doc_id < 9) GROUP BY ALL")
def pinned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    return arena.pinned(docs, docs.where("doc_id < 9").select("lang", "source").distinct(), ["lang", "source"], "doc_id")


@query("SELECT doc_id, sha256(text) AS h FROM documents ORDER BY lang, doc_id LIMIT 300")
def jsonl_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 lines of files that are sorted by language and id."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), _checkpoint(spark)
    writers.jsonl(docs.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id"), path)
    return readers.jsonl_head(spark, path, "doc_id bigint, text string", 300).select("doc_id", F.sha2("text", 256).alias("h"))


@query("""SELECT CASE WHEN grouping(m) = 1 THEN '*' ELSE m END AS modality, CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, count(*) AS n FROM
(SELECT lang, CASE WHEN lang = 'en' THEN 'text' ELSE 'vision' END AS m FROM documents) GROUP BY ROLLUP (m, lang)""")
def modality_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with their subtotals in one pass."""
    kind = validate.modality(F.lit(""), F.lit(""), F.col("lang") != "en")
    return score.with_totals(table(spark, sf_dir, "documents").withColumn("modality", kind), ["modality", "lang"], [F.count(F.lit(1)).alias("n")])


@query("SELECT doc_id, lang, sha256(text) AS h FROM documents WHERE doc_id % 4 < 2")
def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as lines of a source tree, half of them below folders that a scan skips."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h")), _checkpoint(spark)
    for k, folder in enumerate(("app/_pages", "lib/.hidden", "app/node_modules/a", "lib/vendor")):
        part = docs.where(F.col("doc_id") % 4 == k).withColumn("by", F.coalesce("lang", F.lit("none")))
        part.write.partitionBy("by").option("maxRecordsPerFile", 5000).json(f"{path}/{folder}")
    lines = readers.source_tree(spark, path).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.from_json("line", "doc_id bigint, lang string, h string").alias("r")).select("r.*")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(lang, '') AS lang, nullif(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars,
sha256(text) AS h FROM documents""")
def workbook_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of the documents in workbooks of one sheet, read back."""
    docs, path = table(spark, sf_dir, "documents"), _checkpoint(spark)
    workbooks.write(docs.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("h")), path, "catalogue")
    return workbooks.sheet_rows(spark, path, "catalogue")
