"""Quality classifier by importance resampling.

Two generative bag-of-n-grams models over hashed features: the target model from documents labelled good
(a bounded sample, ``most_target``), the raw model from all documents. A document's log weight is the sum
over its n-grams of log p_target - log p_raw, tempered to ``TEMPER`` n-grams where it has more, so that long texts
do not drown the noise. Sampling without replacement in proportion to the weights is Gumbel top-k: the k
largest of log weight + Gumbel noise. The noise is a hash of the id, so that a rerun takes the same sample.
k is either given, or follows from the labels: the cut in the bare weights that best parts good from bad
labelled documents (losing a good one counts ``good_cost`` times), and k is the number of documents above it.

n-grams are words and runs of punctuation, pairs of neighbours, and one feature for a token that repeats
the one before.

Defined results: null, empty and other texts without n-grams carry no evidence, have log weight 0 and the key
infinity, and are always kept; texts of any length are read whole, a slice of rows at a time; at equal keys the
lesser id goes first, and rows equal in both stay together; rows without an id draw one noise; repeated
labels of a document count once, the least of them; with no good labels all weights are 0, and with only
one class of labels all documents are kept; an empty table gives an empty result; other columns pass
through ``keep_good`` untouched and are otherwise not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusloom.llm.arrow import map_batches, slices
from corpusloom.llm.common import cut
from corpusloom.llm.memory import held
from corpusloom.llm.shingles import U, mix

TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS = 16
BUCKETS = 1 << BITS
REPEAT = 0
#: n-grams whose evidence counts in full; of a longer text the mean of all counts as often.
TEMPER = 20
REMEMBERED_WORDS = 200_000


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value


def token_hashes() -> TokenHashes:
    """One memory of tokens for all tasks that a Python worker runs."""
    return held("token hashes", TokenHashes)


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's n-grams, with repeats."""
    found = TOKEN.findall(text or "")
    h = np.fromiter(map(token_hashes().__getitem__, found), dtype=U, count=len(found))
    if not len(h):
        return h.astype(np.int64)
    shift = U(64 - BITS)
    pair = mix(h[:-1] * U(3) + h[1:]) >> shift
    pair[h[1:] == h[:-1]] = REPEAT
    return np.concatenate([h >> shift, pair]).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, good) to this task's (bucket, raw, target)."""
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for part in slices(batch):
            for text, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                f = features(text)
                one = np.bincount(f, minlength=BUCKETS) if len(f) > 4096 else None
                for counts, wanted in ((raw, True), (target, good == 1)):
                    if wanted and one is not None:
                        counts += one
                    elif wanted:
                        np.add.at(counts, f, 1)
    at = np.flatnonzero(raw)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], target[at])], names=["bucket", "raw", "target"])


@dataclass
class Model:
    log_ratio: np.ndarray  # by bucket, float64
    cut: float = -math.inf  # k is the number of documents whose weight is not under it


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw with one occurrence added to every bucket."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def gumbel(ids: list, seed: int) -> np.ndarray:
    u = np.array([xxhash.xxh64_intdigest(str(i).encode(), seed=seed) for i in ids], dtype=np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**64))


def weight_of(ratio: np.ndarray, text: str | None) -> float:
    """The tempered log weight of a text; nan without n-grams."""
    f = features(text)
    return float(ratio[f].sum() * min(1.0, TEMPER / len(f))) if len(f) else math.nan


def _weigh(ratio: np.ndarray, seed: int, edge: tuple | None, id_at: int, text_at: int):
    """Adds (log_weight, key) as the last columns; with an edge (key, id), keeps the rows up to it and adds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column(id_at).to_pylist()
                weight = np.array([weight_of(ratio, t) for t in part.column(text_at).to_pylist()])
                key = np.where(np.isnan(weight), np.inf, weight + gumbel(ids, seed))
                if edge is not None:
                    kept = [k > edge[0] or k == edge[0] and (i is None or edge[1] is not None and i <= edge[1]) for k, i in zip(key, ids, strict=True)]
                    yield part.filter(pa.array(kept, pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.nan_to_num(weight, nan=0.0)), pa.array(key)], names=[*part.schema.names, "log_weight", "key"]
                    )

    return run


def best_cut(weights: np.ndarray, good: np.ndarray, good_cost: float) -> float:
    """The cut with the least cost, in the middle of its widest equally good gap."""
    if len(set(good.tolist())) < 2:
        return -math.inf
    order = np.argsort(weights, kind="stable")
    k, g = weights[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g == 1)]) / (g == 1).sum() * good_cost
    kept = 1 - np.concatenate([[0], np.cumsum(g == 0)]) / (g == 0).sum()
    cost = lost + kept
    gap = np.diff(np.concatenate([[k[0] - 1], k, [k[-1] + 1]]))
    best = max(np.flatnonzero(cost <= cost.min() + 1e-12), key=lambda i: gap[i])
    edge = np.concatenate([[k[0] - 1], k, [k[-1] + 1]])
    return float((edge[best] + edge[best + 1]) / 2)


def train(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most_target: int = 12_000, most_bad: int = 6_000, good_cost: float = 20.0, seed: int = 11,
) -> Model:
    """Counts the raw model over all of ``documents`` and fits the target model and the cut on at most
    ``most_target`` good and ``most_bad`` bad labelled documents, the first by the hash of their id."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    )
    first = lambda y, n: known.where(F.col("good") == y).orderBy(F.xxhash64("id", F.lit(23)), "id").limit(n)
    sample = F.broadcast(first(1, most_target).union(first(0, most_bad)))  # at most most_target + most_bad ids
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = (
        map_batches(docs.join(sample, "id", "left").select("text", "good"), _counts, "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    model = Model(log_ratio(raw, target))
    judged = docs.join(sample, "id").select("id", "text", "good")
    schema = StructType([*judged.schema.fields, StructField("log_weight", DoubleType()), StructField("key", DoubleType())])
    rows = map_batches(judged, _weigh(model.log_ratio, seed, None, 0, 1), schema).where("key < double('inf')").select("log_weight", "good").collect()
    if rows:
        model.cut = best_cut(np.array([r["log_weight"] for r in rows]), np.array([r["good"] for r in rows]), good_cost)
    return model


def weigh(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """(id, log_weight, key) of every document, a map without a shuffle."""
    docs = df.select(id_col, text_col)
    schema = StructType([*docs.schema.fields, StructField("log_weight", DoubleType()), StructField("key", DoubleType())])
    return map_batches(docs, _weigh(model.log_ratio, seed, None, 0, 1), schema).drop(text_col)


def size_of(weighed: DataFrame, model: Model) -> int:
    """k: how many documents the model's cut would keep, those without n-grams included."""
    return weighed.where((F.col("log_weight") >= model.cut) | (F.col("key") == float("inf"))).count()


def keep_good(df: DataFrame, model: Model, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """The rows of ``df`` in the Gumbel top-k, with all their columns: texts are weighed again rather than shuffled."""
    weighed = cut(weigh(df, model, id_col, text_col, seed))
    edge = edge_of(weighed, size_of(weighed, model) if k is None else k, id_col)
    if edge is None:
        return df
    at = [df.columns.index(c) for c in (id_col, text_col)]
    return map_batches(df, _weigh(model.log_ratio, seed, edge, *at), df.schema)


def edge_of(weighed: DataFrame, k: int, id_col: str = "doc_id") -> tuple | None:
    """(key, id) of the last of the k rows with the largest keys (ties by id), found by narrowing a threshold, not by a
    global sort; None if all rows are among them."""
    finite = F.when(F.abs("key") < float("inf"), F.col("key"))
    spread = weighed.agg(F.min(finite), F.max(finite), F.count(F.lit(1)), F.count(F.when(F.col("key") == float("inf"), 1))).first()
    if spread[2] <= k:
        return None
    if k <= 0:
        return math.inf, None  # beyond all rows with an id
    low, high, above = spread[0], spread[1], spread[3]
    if above >= k:
        low = high = math.inf
        above = 0
    for _ in range(40):
        # ``above`` rows are over high; the threshold is in [low, high].
        width = (high - low) / 256
        if not 0 < width < math.inf:
            break
        slot = F.least(F.floor((F.col("key") - low) / width), F.lit(255))
        rows = weighed.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(slot.alias("s")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")
        )
        for r in sorted(rows.collect(), key=lambda r: -r["s"]):  # at most 256 rows
            if above + r["n"] >= k:
                low, high, inside = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
        if inside <= 1000 or low == high:
            break
    top = weighed.where((F.col("key") >= low) & (F.col("key") <= high)).orderBy(F.desc("key"), id_col).limit(k - above)
    last = top.orderBy("key", F.desc(id_col)).first()
    return last["key"], last[id_col]


def in_top(edge: tuple | None, id_col: str = "doc_id") -> Column:
    """Whether a row of (id, key) lies up to the edge."""
    if edge is None:
        return F.lit(True)
    same = F.col(id_col).isNull() if edge[1] is None else F.col(id_col).isNull() | (F.col(id_col) <= F.lit(edge[1]))
    return (F.col("key") > edge[0]) | (F.col("key") == edge[0]) & same


def gumbel_top_k(weighed: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k rows with the largest keys (ties by id; rows equal in both stay together)."""
    return weighed.where(in_top(edge_of(weighed, k, id_col), id_col))
