"""Tensor files by byte range: headers are read when a query is planned, and tasks read the ranges that they need.

A file is the length of its header, the header, a JSON object {name: {dtype, shape, data_offsets}}, and the tensors' bytes one
after the other. The driver reads headers only, some files at a time; tensors are cut into slices of ``slice_bytes`` at most,
and neighbours in a file are read together up to that size, so a partition holds about as much whatever the tensors and
files are. Conditions on name and dtype are pushed into the source: bytes of other tensors are never read."""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from corpusloom.sources import stores

ENDING = ".safetensors"
SCHEMA = "path string, name string, dtype string, shape array<int>, first bigint, data array<float>"
#: Bytes of the floating-point types that are read, and the longest header that the format allows.
WIDTH = {"F32": 4, "F16": 2, "BF16": 2}
MOST_HEADER = 100_000_000
SLICE_BYTES = 32_000_000


class BadTensorFile(ValueError):
    """A file whose header does not describe it; the message names it."""


@dataclass
class Piece:
    """Elements [first, first + count) of a tensor, and where their bytes begin in the file."""

    name: str
    dtype: str
    shape: list[int]
    first: int
    count: int
    at: int

    @property
    def size(self) -> int:
        return self.count * WIDTH[self.dtype]


@dataclass
class TensorPartition(InputPartition):
    path: str
    pieces: list[Piece]

    def __init__(self, path: str, pieces: list[Piece]):
        super().__init__(path)
        self.path, self.pieces = path, pieces


def header(path: str) -> list[Piece]:
    """A file's floating-point tensors in the order of their bytes. Only the header is read."""
    store, inner = stores.at(path)
    with store.open_input_file(inner) as f:
        whole = f.size()
        size = struct.unpack("<Q", f.read_at(8, 0))[0] if whole >= 8 else math.inf
        if size > min(whole - 8, MOST_HEADER):
            raise BadTensorFile(f"{path}: a header of {size} bytes in a file of {whole}")
        try:
            about = json.loads(f.read_at(int(size), 8))
        except ValueError as e:
            raise BadTensorFile(f"{path}: {e}") from None
    found = []
    for name, t in about.items():
        if name == "__metadata__" or t["dtype"] not in WIDTH:
            continue
        low, high = t["data_offsets"]
        count = math.prod(t["shape"])
        if high - low != count * WIDTH[t["dtype"]] or 8 + size + high > whole:
            raise BadTensorFile(f"{path}: {name} has no {count} elements at {low} to {high}")
        found.append(Piece(name, t["dtype"], t["shape"], 0, count, 8 + int(size) + low))
    return sorted(found, key=lambda p: p.at)


def cut_up(pieces: list[Piece], most: int, together: int) -> Iterator[list[Piece]]:
    """Groups of neighbours of ``together`` bytes at most, of tensors and of slices, ``most`` bytes each, of larger ones."""
    group: list[Piece] = []
    for p in pieces:
        step = max(1, most // WIDTH[p.dtype])
        for first in range(0, p.count, step) if p.count else (0,):
            part = Piece(p.name, p.dtype, p.shape, first, min(step, p.count - first), p.at + first * WIDTH[p.dtype])
            if group and part.at + part.size - group[0].at > together:
                yield group
                group = []
            group.append(part)
    if group:
        yield group


def floats(raw: bytes, dtype: str) -> np.ndarray:
    if dtype == "BF16":  # the upper half of a float32
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    return np.frombuffer(raw, "<f4" if dtype == "F32" else "<f2").astype(np.float32)


def _test(f: Filter):
    """The condition on a tensor that a filter is, or None."""
    if getattr(f, "attribute", None) not in (("name",), ("dtype",)):
        return None
    column, value = f.attribute[0], getattr(f, "value", None)
    tests = {
        EqualTo: lambda v: v == value, In: lambda v: v in value, StringStartsWith: lambda v: v.startswith(value),
        StringEndsWith: lambda v: v.endswith(value), StringContains: lambda v: value in v,
    }
    test = tests.get(type(f))
    return test and (lambda p: test(getattr(p, column)))


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("slicebytes", SLICE_BYTES))
        self.together = max(self.most, int(options.get("partitionbytes", self.most)))
        self.whole = options.get("whole", "false") == "true"
        self.listing = options.get("listing", "false") == "true"
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def partitions(self) -> list[TensorPartition]:
        files = stores.files_in(self.path, ENDING)
        if not files and not stores.exists(self.path):
            raise FileNotFoundError(self.path)
        tests = [_test(f) for f in self.pushed]
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(header, files))
        parts = []
        for path, pieces in zip(files, headers):
            wanted = [p for p in pieces if all(t(p) for t in tests)]
            if self.listing:
                groups = [wanted] if wanted else []
            elif self.whole:
                groups = [[p] for p in wanted if p.size > self.most]
                groups += cut_up([p for p in wanted if p.size <= self.most], self.most, self.together)
            else:
                groups = cut_up(wanted, self.most, self.together)
            parts += [TensorPartition(path, g) for g in groups]
        return parts or [TensorPartition("", [])]

    def read(self, partition: TensorPartition) -> Iterator[pa.RecordBatch]:
        if not partition.pieces:
            return
        store, inner = stores.at(partition.path)
        with store.open_input_file(inner) as f:
            for p in partition.pieces:
                data = None if self.listing else pa.array(floats(f.read_at(p.size, p.at), p.dtype), pa.float32())
                column = pa.nulls(1, pa.list_(pa.float32())) if data is None else pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), data)
                columns = [pa.array([partition.path]), pa.array([p.name]), pa.array([p.dtype]), pa.array([p.shape], pa.list_(pa.int32())), pa.array([p.first], pa.int64()), column]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "name", "dtype", "shape", "first", "data"])


@dataclass
class TensorsWritten(WriterCommitMessage):
    files: list[str]


class TensorWriter(DataSourceArrowWriter):
    """Writes rows (name, shape, data) as files of about ``filebytes``, hidden until the job commits."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"].rstrip("/"), int(options.get("filebytes", 4 * SLICE_BYTES))
        self.staged = f"{self.path}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TensorsWritten:
        part, files, held, size = TaskContext.get().partitionId(), [], [], 0

        def flush() -> None:
            about, at = {}, 0
            for name, shape, raw in held:
                about[name] = {"dtype": "F32", "shape": shape, "data_offsets": [at, at + len(raw)]}
                at += len(raw)
            head = json.dumps(about).encode()
            stores.make(self.staged)
            files.append(f"part-{part:05d}-{uuid.uuid4().hex}{ENDING}")
            stores.write(f"{self.staged}/{files[-1]}", struct.pack("<Q", len(head)) + head + b"".join(raw for _, _, raw in held))
            held.clear()

        for batch in iterator:
            names, shapes, data = (batch.column(batch.schema.get_field_index(c)) for c in ("name", "shape", "data"))
            for k in range(batch.num_rows):
                raw = data[k].values.to_numpy(zero_copy_only=False).astype("<f4").tobytes()
                held.append((names[k].as_py(), shapes[k].as_py(), raw))
                size += len(raw)
                if size >= self.most:
                    flush()
                    size = 0
        if held:
            flush()
        return TensorsWritten(files)

    def commit(self, messages: list) -> None:
        stores.make(self.path)
        for m in messages:
            for name in m.files if m else []:
                stores.move(f"{self.staged}/{name}", f"{self.path}/{name}")
        stores.remove(self.staged)

    def abort(self, messages: list) -> None:
        stores.remove(self.staged)


class Tensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TensorWriter:
        return TensorWriter(dict(self.options))


def slices(spark: SparkSession, path: str, slice_bytes: int = SLICE_BYTES, **options: str) -> DataFrame:
    """(path, name, dtype, shape, first, data): the floating-point tensors of a file or a folder of files, in slices that
    begin at element ``first``; ``partitionbytes`` has a task read more than one. Conditions on name and dtype reach the source; Spark has a setting for that, which this sets."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tensors)
    return spark.read.format("tensors").options(slicebytes=str(slice_bytes), **options).load(path)


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, dtype, shape, data): a row a tensor, for tensors that fit in a task."""
    return slices(spark, path, whole="true").drop("first")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, dtype, shape) from the headers alone."""
    return slices(spark, path, listing="true").drop("first", "data")


def write(df: DataFrame, path: str) -> None:
    """Adds rows (name, shape, data) to a folder as 32-bit tensors, all of them or none."""
    df.sparkSession.dataSource.register(Tensors)
    df.selectExpr("name", "cast(shape AS array<int>) AS shape", "cast(data AS array<float>) AS data").write.format("tensors").option("path", path).mode("append").save()
