"""Readers of the formats that corpora come in. All paths may be on any store that Spark reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusloom.operators.extract import EXTENSIONS, MOST_BYTES, SKIPPED_FOLDERS, decoded, scannable
from corpusloom.sources import stores, tensor_files, trees


class BadLine(ValueError):
    """A line that is not an object of the schema; the message names the file, the line's number and its text."""


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Objects of a JSON-lines file or folder; blank lines are skipped. A line that does not fit the schema
    raises BadLine before anything is returned (strict) or is left out."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("file"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = lines.select("file", "value", F.from_json("value", f"{schema}, _bad string", options).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if strict:
        first = rows.where(bad).select("file", "value").first()
        if first is not None:
            raise BadLine(f"{first['file']}:{_line_number(spark, first['file'], first['value'])}: {first['value'][:200]}")
    return rows.where(~bad).select("r.*").drop("_bad")


def _line_number(spark: SparkSession, file: str, line: str) -> int:
    """Where a line first stands in a file, from 1. The file is only read again when it is known to be at fault."""
    lines = spark.read.text(file).select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("block"))
    first = lines.where(F.col("value") == line).orderBy("block", "at").select("block", "at").first()
    return 1 + lines.where((F.col("block") < first["block"]) | ((F.col("block") == first["block"]) & (F.col("at") < first["at"]))).count()


def jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """No rows where there is no such path."""
    try:
        return jsonl(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def jsonl_head(spark: SparkSession, path: str, schema: str, most: int) -> DataFrame:
    """The first ``most`` objects in the order of files and lines: a top-k, no global sort."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    head = lines.select("value", *place).orderBy("_file", "_block", "_at").limit(most)
    return head.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def split_rows(spark: SparkSession, path: str, task: str | None = None, split: str | None = None, modality: str | None = None) -> DataFrame:
    """Storage rows as ``writers.by_split`` wrote them; folders of other splits and tasks are not read."""
    rows = spark.read.parquet(path)
    for column, value in (("split", split), ("task", task), ("modality", modality)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(theme, source_policy_ids) of documents {"derived_rules": [{theme, source_policy_ids}]}."""
    schema = "derived_rules array<struct<theme:string,source_policy_ids:array<string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("derived_rules").alias("r")).select("r.*")


def guides(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of guide documents: markdown, else content; unreadable files have ''."""
    read = spark.read.schema("markdown string, content string").option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    text = F.coalesce(F.nullif("markdown", F.lit("")), F.nullif("content", F.lit("")), F.lit(""))
    return read.select(F.col("_metadata.file_path").alias("path"), text.alias("text"))


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to the root, text) of the scannable files under a folder, hidden ones too. Tasks list the tree, level by
    level, and never open a skipped folder. Stores that only Spark reaches are listed by it: their skipped folders are
    listed, not read, and names that start with _ or . are left out, as Spark does."""
    return trees.source_tree(spark, root) if stores.reachable(root) else listed_tree(spark, root)


def listed_tree(spark: SparkSession, root: str) -> DataFrame:
    """``source_tree`` by Spark's own listing. The extension is a glob of the listing, the skipped folders a condition on the
    files' metadata, and the size one that the scan takes, so no content is read of files that they drop."""
    either = ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{either}}}").load(root)
    base = re.sub("^[a-z]+:/*", "/", root.rstrip("/") + "/")
    folders = "|".join(re.escape(f) for f in SKIPPED_FOLDERS)
    outside = ~F.col("_metadata.file_path").rlike(rf"^(?:[a-z]+:/*)?/?{re.escape(base.lstrip('/'))}(?:.*/)?(?:{folders})/")
    own = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    relative = F.when(own.startswith(base), F.substring(own, F.lit(len(base) + 1), F.length(own))).otherwise(own)
    kept = files.where(outside & (F.col("length") <= MOST_BYTES))
    return scannable(kept.withColumn("path", relative)).select("path", decoded(F.col("content")).alias("text"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of strings of a CSV file with a header; quoted fields may span lines."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, sha256) of the PNG files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, dtype, shape, data) of the floating-point tensors of safetensors files; ``tensor_files.slices`` has those
    that are too large for a row."""
    return tensor_files.whole(spark, path)


def votes(spark: SparkSession, path: str, schema: str, batch: int | None = None) -> DataFrame:
    """A stream of votes from a folder of JSON-lines files, one for each session; ``batch`` files in a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader if batch is None else reader.option("maxFilesPerTrigger", batch)).json(path)
