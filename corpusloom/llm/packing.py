"""Best-fit packing of tokenised documents under several capacities.

A document is the ids of its text followed by an end id; only documents longer than a sequence are cut,
into full pieces and a shorter last one. Pieces are packed by vector best-fit, in order of decreasing
length: a bin has residual tokens, residual documents and residual attention cost (the sum of squared
lengths); of the bins in which a piece fits under every capacity the one with the least weighted norm of
what would be left is chosen. ``tighten`` lowers the capacities of documents and attention as far as the packing
still needs no more sequences than one by tokens alone, so that no sequence is a heap of scraps; full pieces, which
nothing can join, are sequences of their own and set no limit.

Pieces of one length are alike, so the packing is decided on the histogram of lengths, which has at most
``max_tokens`` entries at any corpus size. Bins with equal content are one group with a count. The pieces
are then dealt to the places of their length by rank, in a distributed way: a rank inside (length, salt)
plus the offset of the salt. No piece is dropped and no task sees more than its share of a hot length.

Defined results: null and empty texts are documents of the end id alone; very long texts are tokenised whole and cut into
as many pieces as they fill; of equally good bins the one made first is taken, and pieces of one length are dealt by the hash
and then the order of their ids, so ties never change the number of sequences; repeated rows are documents of their own; an
empty table packs into nothing; other columns are not read.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm.arrow import map_rows
from corpusloom.llm.common import cut
from corpusloom.llm.memory import held

#: Words and pieces from which on a worker's memory of ids is a generation, of which the last two are kept; words encoded at once.
REMEMBERED_WORDS, WORDS_AT_ONCE = 150_000, 8_192
#: str.split() takes these as white space, the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Fixed value: the pattern by which the tokenizer cuts its normalised (NFC, lower case) text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters, numbers and white space of the first 256 characters, in lower case, and the same pattern for these.
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r\x20\x85\xa0"
_PIECES = re.compile(f"[{_LETTERS}]++|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACES}{_LETTERS}{_NUMBERS}]++")


def _shown() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible ones as they are, the others as characters from 256 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in visible)
    return {b: chr(256 + k) for k, b in enumerate(others)}


def _cuts_alike(path: str) -> bool:
    """Whether a tokenizer's file says that it normalises and cuts texts as ``_PIECES`` does."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = [(p["type"], p.get("pattern"), p.get("add_prefix_space")) for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return (
        steps == ["NFC", "Replace", "Lowercase"] and cuts == [("Split", {"Regex": PATTERN}, None), ("ByteLevel", None, False)]
        and spec["model"]["type"] == "BPE"
    )


class WordIds(dict):
    """Ids (little-endian uint32 bytes) of the pieces that the tokenizer cuts a text into, and of whole words that hold
    characters beyond the first 256. The tokenizer drops white space and no token spans a piece, so the ids of a text are
    those of its pieces and words in order. Pieces are fewer than words (case and punctuation are cut off),
    and their ids come from the merges alone. A tokenizer that cuts in another way is asked for whole words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model if _cuts_alike(path) else None
        self.shown = _shown()
        self.before: dict[str, bytes] = {}  # the generation before: keys that recur are taken over from it

    def _odd(self, text: str) -> bool:
        """Beyond the first 256 characters, or perhaps with a special token: left to the tokenizer."""
        if self.merges is None or "<|" in text:
            return True
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return True
        return False

    def learn(self, texts: list[str | None]) -> None:
        """Remembers the words of some texts that the tokenizer has to be asked for, encoded together."""
        odd = {w for t in texts if t and self._odd(t) for w in t.split() if len(w) <= 64 and self._odd(w)}
        missing = [w for w in odd if w not in self and w not in self.before]
        for k in range(0, len(missing), WORDS_AT_ONCE):
            part = missing[k : k + WORDS_AT_ONCE]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self._remember(word, np.asarray(found.ids, dtype="<u4").tobytes())

    def _remember(self, key: str, ids: bytes) -> None:
        if len(self) >= REMEMBERED_WORDS:
            self.before = dict(self)
            self.clear()
        self[key] = ids

    def direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.merges.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, key: str) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.direct(key) if self._odd(key) else self._merged(key)
        if len(key) <= 64:
            self._remember(key, ids)
        return ids

    def _keys(self, text: str) -> list[str]:
        if not self._odd(text):
            return _PIECES.findall(text.lower())
        return [k for w in text.split() for k in ((w,) if self._odd(w) else _PIECES.findall(w.lower()))]

    def ids(self, text: str) -> bytes:
        if _SEPARATORS.search(text):
            return self.direct(text)
        return b"".join(map(self.__getitem__, self._keys(text)))


def word_ids(path: str) -> WordIds:
    """One memory of words for all tasks that a Python worker runs."""
    return held(f"word ids {path}", lambda: WordIds(path))


def _tokenise(path: str, end_id: int, max_tokens: int, keep_ids: bool):
    def make():
        words = word_ids(path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        width = 4 * max_tokens

        def work(docs: list, texts: list):
            words.learn(texts)
            for doc, text in zip(docs, texts, strict=True):
                ids = (words.ids(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part))
                    yield (*row, part) if keep_ids else row

        return work

    return make


def token_pieces(
    df: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids binary]) of every document."""
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_rows(
        df.select(id_col, text_col),
        _tokenise(tokenizer_path, end_id, max_tokens, keep_ids),
        schema + ", ids binary" * keep_ids,
    )


@dataclass
class Group:
    """``count`` bins with equal content: runs of (length, copies)."""

    runs: tuple[tuple[int, int], ...]
    count: int


def best_fit(
    histogram: dict[int, int],
    max_tokens: int,
    max_docs: int,
    max_attention: int,
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001),
) -> list[Group]:
    """Vector best-fit decreasing over a histogram of lengths; equal pieces and equal bins move together."""
    if not any(histogram.values()):
        return []
    capacity = np.array([max_tokens, max_docs, max_attention], dtype=np.float64)
    weight = np.asarray(weights) / capacity
    left = np.zeros((1024, 3), dtype=np.int64)
    counts = np.zeros(1024, dtype=np.int64)
    runs: list[tuple[tuple[int, int], ...]] = []
    closed: list[Group] = []

    def add(residual, content, count) -> None:
        nonlocal left, counts
        n = len(runs)
        if n == len(counts):
            left, counts = np.concatenate([left, np.zeros_like(left)]), np.concatenate([counts, np.zeros_like(counts)])
        left[n], counts[n] = residual, count
        runs.append(content)

    def fits(residual, demand) -> int:
        return int(min(r // d for r, d in zip(residual, demand, strict=True)))

    lengths = sorted((k for k, n in histogram.items() if n), reverse=True)
    for size in lengths:
        demand, todo = np.array([size, 1, size * size], dtype=np.int64), int(histogram[size])
        if fits(capacity.astype(np.int64), demand) < 1:
            raise ValueError(f"a piece of {size} tokens is over a capacity")
        while todo:
            n = len(runs)
            open_ = (counts[:n] > 0) & (left[:n] >= demand).all(axis=1)
            if not open_.any():
                each = fits(capacity.astype(np.int64), demand)
                for copies, bins in ((each, todo // each), (todo % each, 1)):
                    if copies and bins:
                        add(capacity.astype(np.int64) - copies * demand, ((size, copies),), bins)
                todo = 0
                break
            at = np.flatnonzero(open_)
            norm = (((left[at] - demand) * weight) ** 2).sum(axis=1)
            g = int(at[np.argmin(norm)])
            copies = min(fits(left[g], demand), todo)
            bins = min(int(counts[g]), todo // copies)
            counts[g] -= bins
            todo -= bins * copies
            add(left[g] - copies * demand, (*runs[g], (size, copies)), bins)
        # Bins in which not even the smallest piece fits need no more looks.
        n, least = len(runs), np.array([lengths[-1], 1, lengths[-1] ** 2])
        shut = (counts[:n] > 0) & ~(left[:n] >= least).all(axis=1)
        if shut.any() or (counts[:n] == 0).sum() > 256:
            closed += [Group(runs[k], int(counts[k])) for k in np.flatnonzero(shut)]
            keep = np.flatnonzero((counts[:n] > 0) & ~shut)
            left[: len(keep)], counts[: len(keep)] = left[keep], counts[keep]
            counts[len(keep) :] = 0
            runs = [runs[k] for k in keep]
    return closed + [Group(r, int(c)) for r, c in zip(runs, counts[: len(runs)], strict=True) if c]


def used(groups: list[Group], k: int) -> int:
    """The most documents (0) or attention (1) of a bin."""
    return max((sum(n * (s * s if k else 1) for s, n in g.runs) for g in groups), default=0)


def tightest(histogram: dict[int, int], max_tokens: int, tries: int = 6) -> tuple[list[Group], int, int]:
    """(groups, max_docs, max_attention): the packing under the least limits found that needs no more sequences than tokens
    alone do, and the limits that all sequences keep. Full pieces are sequences of their own, whatever the limits, so these are
    sought for the others: first of documents, then of attention, halving what lies between a sequence's average and the
    most that the best packing so far puts into one. Each try is over the histogram only."""
    others = {s: n for s, n in histogram.items() if n and s < max_tokens}
    full = histogram.get(max_tokens, 0)
    limits = [max_tokens, max_tokens**2]
    best = best_fit(others, max_tokens, *limits) if others else []
    bins = sum(g.count for g in best)
    total = [sum(others.values()), sum(s * s * n for s, n in others.items())]
    for k in (0, 1):
        if not best:
            break
        low, limits[k] = max(total[k] // bins, (max(others) ** 2 if k else 1) - 1), used(best, k)
        for _ in range(tries):
            if limits[k] - low <= 1:
                break
            limit = (low + limits[k]) // 2
            tried = best_fit(others, max_tokens, *(limit if j == k else limits[j] for j in (0, 1)))
            if sum(g.count for g in tried) <= bins:
                best, bins, limits[k] = tried, sum(g.count for g in tried), used(tried, k)
            else:
                low = limit
    if full:
        best, limits = [Group(((max_tokens, 1),), full), *best], [max(limits[0] if others else 1, 1), max_tokens**2]
    return best, *limits


def places(groups: list[Group]) -> dict[str, np.ndarray]:
    """For each run of each group the ranks of its length that it takes: key = length << 44 | first rank."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for g in groups:
        offset = 0
        for size, copies in g.runs:
            first = taken.get(size, 0)
            taken[size] = first + copies * g.count
            rows.append((size << 44 | first, first, copies, base, offset))
            offset += size * copies
        base += g.count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "copies", "base", "offset"), table.T.copy(), strict=True))


def ranked(pieces: DataFrame, id_col: str, salts: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each length, without gathering a length in one task."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy(id_col, "piece")
    return (
        salted.withColumn("inside", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "salt"])
        .withColumn("rank", F.col("inside") + F.col("before"))
        .drop("inside", "before", "salt")
    )


def pack(
    pieces: DataFrame,
    id_col: str = "doc_id",
    max_tokens: int = 4096,
    max_docs: int | None = None,
    max_attention: int | None = None,
    tighten: bool = False,
) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (id_col, piece, length, ...).

    ``max_docs`` pieces and a sum of squared lengths of ``max_attention`` per sequence; where they are None
    the token capacity implies them (max_tokens and max_tokens squared), or, with ``tighten``, the least limits hold that
    cost no sequence."""
    pieces = cut(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if tighten and max_docs is None and max_attention is None:
        groups = tightest(histogram, max_tokens)[0]
    else:
        groups = best_fit(histogram, max_tokens, max_docs or max_tokens, max_attention or max_tokens**2)
    at = places(groups)
    total = sum(histogram.values())
    salts = min(65_536, max(16, math.ceil(total / 200_000)))
    names = [c for c in pieces.columns]
    ready = ranked(pieces, id_col, salts).select(*names, "rank")
    out = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(at["key"], size << 44 | rank, side="right") - 1
            past = rank - at["first"][k]
            seq, off = at["base"][k] + past // at["copies"][k], at["offset"][k] + past % at["copies"][k] * size
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                names=[*b.schema.names[:-1], "sequence_id", "offset"],
            )

    return ready.mapInArrow(place, out)


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 1, max_tokens: int = 4096, **limits) -> DataFrame:
    """Pieces of all documents with their places in as few sequences as best-fit finds."""
    return pack(token_pieces(df, tokenizer_path, end_id, max_tokens), max_tokens=max_tokens, **limits)
