"""Rows that hold a phrase of a source: rolling hashes, a Bloom filter of the sources, and an exact join of what passes it.

Words are hashed once, and all n-word phrases of a text by prefix sums: with the powers of an odd base, which has an inverse
modulo 2^64, the hash of a phrase is the difference of two sums of a running total, whatever n is. The sources' hashes set
bits of a Bloom filter in each task; the filters are joined word by word in an aggregation, and only the filter goes to the
tasks that read the rows. What passes it are the phrases that sources have, and a few by chance, so only these are spelled
out, on either side, and joined as texts. Neither side has to fit in memory anywhere: the filter's size is bounded, and the
phrases that meet are broadcast up to a number that is counted first."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions.text import WORD

#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bits a phrase of the filter, its largest size in bits, and the bits that a phrase sets.
BITS_EACH, MOST_BITS, PROBES = 12, 2**27, 4
#: Phrases that a join may broadcast; words that a task remembers the hashes of.
BROADCAST_PHRASES, REMEMBERED_WORDS = 1_000_000, 200_000
_WORDS = re.compile(WORD)
U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def powers(of: int, n: int) -> np.ndarray:
    """1, of, of^2, ... modulo 2^64."""
    factors = np.full(n, of, dtype=U)
    factors[:1] = 1
    return np.cumprod(factors, dtype=U)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n neighbours."""
    m = len(hashes)
    if m < n:
        return hashes[:0]
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(hashes * powers(BASE, m), dtype=U)])
    h = (sums[n:] - sums[:-n]) * powers(INVERSE, m - n + 1)
    h ^= h >> U(31)  # the low bits of the sums are those of few low bits
    return h * U(BASE) ^ (h * U(BASE) >> U(29))


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, phrases): the bits of a filter of ``bits``, a power of two, that each phrase sets."""
    step = (h >> U(32)) | U(1)
    return np.stack([(h + U(k) * step) & U(bits - 1) for k in range(PROBES)])


def passing(h: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    at = probes(h, len(bloom) * 64)
    return (bloom[at >> U(6)] >> (at & U(63)) & U(1)).all(axis=0)


def _texts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, pa.RecordBatch, list[str], np.ndarray]]:
    """(row, its batch, its words, the hashes of its phrases) of each row with a phrase; the text is the last column."""
    known = WordHashes()
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for k in range(batch.num_rows):  # one text at a time is a Python object
            found = _WORDS.findall(column[k].as_py() or "")
            if len(found) >= n:
                yield k, batch, found, rolling(np.fromiter(map(known.__getitem__, found), dtype=U, count=len(found)), n)


def _lowered(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.lower(text).alias("_text"))


def bloom_of(sources: DataFrame, text: str, n: int) -> np.ndarray | None:
    """A filter of the sources' phrases as 64-bit words; None without any phrase."""
    # A word takes two letters and a space at least, so this bounds the phrases from above.
    most = sources.select(F.sum(F.greatest(F.length(text) / 3 - (n - 1), F.lit(0.0)))).first()[0] or 0
    if most < 1:
        return None
    bits = min(MOST_BITS, max(2**12, 1 << math.ceil(math.log2(most * BITS_EACH / 2))))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits // 64, dtype=U)
        for _, _, _, h in _texts(batches, n):
            at = probes(h, bits).ravel()
            np.bitwise_or.at(mine, at >> U(6), U(1) << (at & U(63)))
        used = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(mine[used].view(np.int64))], names=["at", "bits"])

    parts = _lowered(sources, F.col(text)).mapInArrow(partial, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bloom = np.zeros(bits // 64, dtype=U)  # at most MOST_BITS bits come to the driver, and go to the tasks
    bloom[parts.column("at").to_numpy()] = parts.column("bits").to_numpy().view(U)
    return bloom


def phrases_in(df: DataFrame, text: str, n: int, bloom: np.ndarray, *keep: str) -> DataFrame:
    """(*keep, h, phrase): the phrases of each row that pass the filter, each once a row."""
    held = df.sparkSession.sparkContext.broadcast(bloom)
    out = _lowered(df, F.col(text), *keep)
    schema = df.select(*keep, F.lit(0).cast("long").alias("h"), F.lit("").alias("phrase")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for row, batch, found, h in _texts(batches, n):
            at = np.flatnonzero(passing(h, held.value))
            if len(at):
                at = at[np.unique(h[at], return_index=True)[1]]
                same = [pa.repeat(batch.column(c)[row], len(at)) for c in range(len(keep))]
                spelled = pa.array([" ".join(found[k : k + n]) for k in at.tolist()], pa.string())
                arrays = [*same, pa.array(h[at].view(np.int64)), spelled]
                yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, kinds.types)], schema=kinds)

    return out.mapInArrow(run, schema)


def holding(df: DataFrame, sources: DataFrame, id_col: str, text: str = "text", source_text: str = "text", n: int = 14) -> DataFrame:
    """(id) of the rows that hold an n-word phrase of a source; null texts and texts of fewer words hold none."""
    bloom = bloom_of(sources, source_text, n)
    if bloom is None:
        return df.select(id_col).limit(0)
    known = phrases_in(sources, source_text, n, bloom).distinct()  # all of the sources' phrases
    if known.limit(BROADCAST_PHRASES + 1).count() <= BROADCAST_PHRASES:
        known = F.broadcast(known)
    return phrases_in(df, text, n, bloom, id_col).join(known, ["h", "phrase"], "left_semi").select(id_col).distinct()
