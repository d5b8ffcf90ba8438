"""Python over Arrow batches, with memory bounded by small batches and small slices of each batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Input characters that are turned into Python objects at once.
SLICE_BYTES = 4_000_000
#: Bytes from which on a task sends a batch to Python, a little under a slice; a batch ends with the row that reaches them.
BATCH_BYTES = 3_800_000
#: Spark's setting of it, and the default: a task would hold several times 64 MB, as vectors, as their stream and in its worker.
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of about ``BATCH_BYTES``. The bound is a setting of the session, which has to hold when the
    rows are asked for; one that the caller has set stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``limit`` bytes, one row at least."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, int(rows * limit / max(batch.nbytes, 1)))
    for k in range(0, rows, step):
        yield batch.slice(k, step)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """``make()`` runs once per task and returns a function from a slice's columns (lists) to output rows."""
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(struct)
        work = make()
        for batch in batches:
            for part in slices(batch):
                rows = list(work(*[c.to_pylist() for c in part.columns]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds
                    )

    return map_batches(df, run, struct)
