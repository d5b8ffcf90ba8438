"""Source trees, listed by tasks: the folders of a level are a table, and a round opens all of them.

Folders that a scan skips are never opened, however much lies in them, and no listing of the tree is made in the driver: it
learns how many folders a level has. A level is written to the shared checkpoint folder before the next one starts,
so that a lost executor repeats its share of one level. A single folder is listed by one task."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.extract import MOST_BYTES, SKIPPED_FOLDERS, decoded, scannable
from corpusloom.sources import stores

ENTRY = "path string, length bigint, folder boolean"
#: (name, bytes, whether it is a folder) of what lies in a folder.
Lister = Callable[[str], list[tuple[str, int, bool]]]


def entries(folder: str) -> list[tuple[str, int, bool]]:
    """What a folder holds: files and folders, hidden ones too, but no links to folders (they may lead back up) and no dead
    links. A folder that is gone holds nothing."""
    store, inner = stores.at(folder)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    local = isinstance(store, fs.LocalFileSystem)
    out = []
    for f in found:
        if f.type == fs.FileType.File:
            out.append((f.base_name, f.size, False))
        elif f.type == fs.FileType.Directory and not (local and os.path.islink(f.path)):
            out.append((f.base_name, 0, True))
    return out


def walk(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED_FOLDERS, lister: Lister = entries) -> DataFrame:
    """(path relative to the root, length, folder) of what lies under a folder, outside folders of the skipped names. Those names
    themselves have a row. A root that is missing, or is no folder, raises FileNotFoundError."""
    base = root.rstrip("/") or "/"
    store, inner = stores.at(base)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    levels = f"{shared}/tree-{uuid.uuid4()}" if shared else tempfile.mkdtemp()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = lister(f"{base}/{folder}" if folder else base)
                paths = [f"{folder}/{name}" if folder else name for name, _, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(paths, pa.string()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([d for _, _, d in found], pa.bool_())], names=["path", "length", "folder"]
                )

    cores = spark.sparkContext.defaultParallelism
    frontier, depth, open_now = spark.createDataFrame([("",)], "path string"), 0, 1
    while open_now:
        level = f"{levels}/level={depth}"
        frontier.repartition(max(1, min(open_now, 4 * cores))).mapInArrow(opened, ENTRY).write.parquet(level)
        below = spark.read.schema(ENTRY).parquet(level).where("folder")
        frontier = below.where(~F.substring_index("path", "/", -1).isin(*skipped)).select("path")
        open_now, depth = frontier.count(), depth + 1
    return spark.read.schema(ENTRY).parquet(*[f"{levels}/level={k}" for k in range(depth)])


def source_tree(spark: SparkSession, root: str, lister: Lister = entries) -> DataFrame:
    """(path relative to the root, text) of the scannable files under a folder. Only files that are kept are read, a file at a
    time, in as many tasks as their bytes ask for; one that has gone since it was listed has no row."""
    base = root.rstrip("/") or "/"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    content = stores.read(f"{base}/{path}")
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], names=["path", "content"])

    files = scannable(walk(spark, root, lister=lister).where(~F.col("folder"))).select("path", "length")
    size = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).first()
    parts = max(1, min(size["n"], max(spark.sparkContext.defaultParallelism, (size["bytes"] or 0) // (32 * MOST_BYTES))))
    found = files.select("path").repartition(parts).mapInArrow(read, "path string, content binary")
    return found.select("path", decoded(F.col("content")).alias("text"))
