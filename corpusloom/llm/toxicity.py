"""Toxicity by multiple-instance learning: document labels train a scorer of sentences.

A sentence's logit is a bias plus the sum of the weights of its distinct words; a word's weight is the sum
of hashed features (the word, where it is frequent enough, and its leading characters). Sentence
probabilities are joined by noisy-or, 1 - prod(1 - p), and the likelihood of the document labels is climbed
with limited-memory BFGS. Nothing but text is an input of a score. The model is fitted on a bounded sample
of labelled documents (``most_toxic`` and ``most_clean`` rows by the hash of their id, weighted back to the
proportions of all labelled rows). Executors read the sample's texts once, into shards of feature numbers in the
shared checkpoint folder; each step sums the shards' gradients, and no text reaches the driver. Every
document is scored, and sentences over ``locate_at`` are located.

Defined results: null and empty texts have no sentences and score 0; texts of any length are read whole, sentence
by sentence; ties need no order, as equal texts score the same; repeated documents get repeated rows;
repeated labels of a document count once, the largest of them; of equal texts in the sample the one of the least
id is learnt from; without labels of both classes all score 0; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_batches, map_rows, slices
from corpusloom.llm.common import cut

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w[\w']*")
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6)
REMEMBERED_WORDS = 600_000
#: Features that fewer documents have only fit noise.
LEAST_DOCS = 4
DECAY = 5e-5
#: Tasks that sum gradients in a step.
SHARDS = 12


def buckets_of(word: str) -> list[int]:
    """Hashed features of a lower-cased word."""
    found = [zlib.crc32(f"w {word}".encode()) % BUCKETS]
    return found + [zlib.crc32(f"{n} {word[:n]}".encode()) % BUCKETS for n in PREFIXES if len(word) >= n]


@dataclass
class Model:
    weights: np.ndarray  # by bucket, float32
    bias: float


def sentences(text: str):
    """(start, end, distinct words) of the sentences that have words."""
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m[0].lower()))
        if words:
            yield m.start(), m.end(), words


@dataclass
class Shard:
    """Some documents in numbers: which words stand in which sentence, and sentences in which document."""

    y: np.ndarray  # of documents
    scale: np.ndarray  # of documents: their weight in the likelihood
    doc: np.ndarray  # of sentences
    sentence: np.ndarray  # of words in sentences
    word: np.ndarray  # of words in sentences: a row of the shard's vocabulary
    owner: np.ndarray  # of features of the vocabulary: the word
    bucket: np.ndarray  # of features of the vocabulary

    KINDS = ("<f8", "<f8", "<i4", "<i4", "<i4", "u1", "<i4")

    def pack(self) -> list[bytes]:
        """The arrays as bytes; those that only rise as how often each number occurs."""
        sizes = np.bincount(self.doc, minlength=len(self.y)), np.bincount(self.sentence, minlength=len(self.doc))
        parts = self.y, self.scale, *sizes, self.word, np.bincount(self.owner), self.bucket
        return [np.asarray(x, k).tobytes() for x, k in zip(parts, self.KINDS, strict=True)]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> Shard:
        y, scale, in_doc, in_sentence, word, of_word, bucket = (np.frombuffer(b, k) for b, k in zip(parts, cls.KINDS, strict=True))
        whole = lambda sizes: np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        return cls(y, scale, whole(in_doc), whole(in_sentence), word, whole(of_word), bucket)


def shard_of(texts: list[str], y: list[int], scale: list[float]) -> Shard:
    vocabulary: dict[str, int] = {}
    word_at, sentence_at, doc_at = [], [], []
    for d, text in enumerate(texts):
        for _, _, words in sentences(text or ""):
            s = len(doc_at)
            doc_at.append(d)
            for w in words:
                word_at.append(vocabulary.setdefault(w, len(vocabulary)))
                sentence_at.append(s)
    pairs = [(w, b) for text, w in vocabulary.items() for b in buckets_of(text)]
    owner, bucket = np.asarray(pairs, dtype=np.int32).reshape(-1, 2).T
    small = lambda x: np.asarray(x, dtype=np.int32)
    return Shard(np.asarray(y, dtype=np.float64), np.asarray(scale, dtype=np.float64), small(doc_at), small(sentence_at), small(word_at), owner, bucket)


def seen_in(shard: Shard) -> np.ndarray:
    """In how many documents each bucket occurs, a word's documents counted for all its buckets."""
    n_docs, n_words = len(shard.y), int(shard.owner.max(initial=-1)) + 1
    distinct = np.unique(shard.word.astype(np.int64) * max(n_docs, 1) + shard.doc[shard.sentence])
    docs_of_word = np.bincount(distinct // max(n_docs, 1), minlength=n_words)
    return np.bincount(shard.bucket, weights=docs_of_word[shard.owner], minlength=BUCKETS).astype(np.int64)


def loss_and_slope(shard: Shard, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
    """The negative log likelihood of the labels under noisy-or, and its gradient in the weights (by bucket) and the bias."""
    n_docs, n_words, n_sentences = len(shard.y), int(shard.owner.max(initial=-1)) + 1, len(shard.doc)
    value = np.bincount(shard.owner, weights=weights[shard.bucket], minlength=n_words)
    logit = np.clip(bias + np.bincount(shard.sentence, weights=value[shard.word], minlength=n_sentences), -30, 30)
    none = -np.bincount(shard.doc, weights=np.logaddexp(0, logit), minlength=n_docs)  # log(1 - p_doc)
    some = np.log(np.maximum(-np.expm1(none), 1e-12))
    loss = -(shard.scale * np.where(shard.y > 0, some, none)).sum()
    pull = np.where(shard.y > 0, -np.exp(none - some), 1.0) * shard.scale
    g_sentence = pull[shard.doc] / (1 + np.exp(-logit))
    g_word = np.bincount(shard.word, weights=g_sentence[shard.sentence], minlength=n_words)
    return loss, np.bincount(shard.bucket, weights=g_word[shard.owner], minlength=BUCKETS), float(g_sentence.sum())


Evaluate = Callable[[np.ndarray, float], tuple[float, np.ndarray, float]]


def climb(evaluate: Evaluate, used: np.ndarray, steps: int = 30, decay: float = DECAY, memory: int = 8) -> Model:
    """Limited-memory BFGS from no weights and a bias of -6. ``evaluate`` gives loss and gradient over all shards for
    the weights of the buckets in ``used``."""

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g, g_bias = evaluate(x[:-1], float(x[-1]))
        return loss + decay / 2 * float(x[:-1] @ x[:-1]), np.append(g + decay * x[:-1], g_bias)

    x = np.zeros(len(used) + 1)
    x[-1] = -6.0
    loss, g = at(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, factors = g.copy(), []
        for s, t in reversed(past):
            factors.append(s @ d / (s @ t))
            d -= factors[-1] * t
        if past:
            s, t = past[-1]
            d *= (s @ t) / (t @ t)
        else:
            d /= max(1.0, float(np.abs(g).max()) * 10) or 1.0
        for (s, t), f in zip(past, reversed(factors), strict=True):
            d += s * (f - t @ d / (s @ t))
        slope = float(g @ d)
        if not slope > 1e-12:
            break
        rate = 1.0 if past else 1.0 / max(1e-9, float(np.abs(d).max()))
        for _ in range(12):
            new = x - rate * d
            new_loss, new_g = at(new)
            if new_loss <= loss - 1e-4 * rate * slope:
                break
            rate /= 3
        else:
            break
        s, t = new - x, new_g - g
        if s @ t > 1e-12:
            past = [*past[1 - memory :], (s, t)]
        done = loss - new_loss < 1e-6 * max(1.0, abs(loss)) and rate == 1.0
        x, loss, g = new, new_loss, new_g
        if done:
            break
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = x[:-1]
    return Model(weights, float(x[-1]))


def fit(texts: list[str], toxic: np.ndarray, sample_weight: np.ndarray, least_docs: int = LEAST_DOCS, **options) -> Model | None:
    """The model of texts at hand. None if one class is missing."""
    if len(set(toxic.tolist())) < 2:
        return None
    shard = shard_of(texts, toxic.tolist(), (sample_weight / sample_weight.sum()).tolist())
    used = np.flatnonzero(seen_in(shard) >= least_docs)

    def evaluate(w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        full = np.zeros(BUCKETS)
        full[used] = w
        loss, g, g_bias = loss_and_slope(shard, full, bias)
        return loss, g[used], g_bias

    return climb(evaluate, used, **options)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y, scale) of a task, of which few have rows, to shards and how many documents have which bucket."""
    for batch in batches:
        for part in slices(batch):
            shard = shard_of(*(c.to_pylist() for c in part.columns))
            seen = seen_in(shard)
            at = np.flatnonzero(seen)
            blobs = [*shard.pack(), at.astype("<i4").tobytes(), seen[at].astype("<i4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=[f"c{k}" for k in range(len(blobs))])


def _slopes(used: np.ndarray, w: np.ndarray, bias: float):
    """Shards to one row (loss, gradient in the weights of ``used``, in the bias) a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, loss, g_bias = np.zeros(BUCKETS), 0.0, 0.0
        full[used] = w
        total = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, g, one_bias = loss_and_slope(Shard.unpack(list(row)), full, bias)
                loss, g_bias, total = loss + one, g_bias + one_bias, g if total is None else total + g
        if total is not None:
            columns = [pa.array([loss]), pa.array([total[used].tobytes()], pa.binary()), pa.array([g_bias])]
            yield pa.RecordBatch.from_arrays(columns, names=["loss", "g", "g_bias"])

    return run


def _score(model: Model | None, locate_at: float):
    def make():
        memory: dict[str, float] = {}

        def value(word: str) -> float:
            x = memory.get(word)
            if x is None:
                if len(memory) >= REMEMBERED_WORDS:
                    memory.clear()
                x = memory[word] = float(model.weights[buckets_of(word)].sum())
            return x

        def work(ids: list, texts: list):
            for i, text in zip(ids, texts, strict=True):
                if model is None or not text:
                    yield i, 0.0, []
                    continue
                where, logits = [], []
                for start, end, words in sentences(text):
                    where.append((start, end))
                    logits.append(model.bias + sum(map(value, sorted(words))))
                if not logits:
                    yield i, 0.0, []
                    continue
                x = np.clip(np.array(logits), -30, 30)
                score = float(-np.expm1(-np.logaddexp(0, x).sum()))
                p = 1 / (1 + np.exp(-x))
                yield i, score, [
                    {"start": where[k][0], "end": where[k][1], "score": float(p[k])} for k in np.flatnonzero(p >= locate_at)
                ]

        return work

    return make


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", locate_at: float = 0.3) -> DataFrame:
    """(id, score, sentences array<struct<start, end, score>>) of every document, a map without a shuffle."""
    kind = dict(df.dtypes)[id_col]
    return map_rows(
        df.select(id_col, text_col),
        _score(model, locate_at),
        f"{id_col} {kind}, score double, sentences array<struct<start:bigint,end:bigint,score:double>>",
    )


def train(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_toxic: int = 4000, most_clean: int = 8000, least_docs: int = LEAST_DOCS,
) -> Model | None:
    """Fits on at most ``most_toxic`` + ``most_clean`` labelled documents, the first by the hash of their id."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    )
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(17)), "id").limit(most) for y, most in ((1, most_toxic), (0, most_clean))
    ]
    sample = picked[0].union(picked[1])  # at most most_toxic + most_clean ids and labels
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    known = texts.join(F.broadcast(sample), "id").select("id", "y", F.sha2("text", 256).alias("digest"))
    rows = cut(known.groupBy("digest").agg(F.min(F.struct("id", "y")).alias("r")).select("r.*", "digest"))  # copies teach nothing new
    taken = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(taken) < 2:
        return None
    scale = F.when(F.col("y") == 1, total[1] / taken[1]).otherwise(total[0] / taken[0]) / sum(total[y] for y in taken)
    parts = max(1, min(SHARDS, sum(taken.values()) // 200))
    blobs = ", ".join(f"c{k} binary" for k in range(len(Shard.KINDS) + 2))
    chosen = F.broadcast(rows.select("id", "digest", "y", scale.alias("scale")))
    picked = texts.join(chosen, "id").where(F.sha2("text", 256) == F.col("digest"))
    picked = picked.repartition(parts, "digest").dropDuplicates(["digest"])  # rows that repeat an id
    shards = cut(map_batches(picked.select("text", "y", "scale"), _shards, blobs).coalesce(parts))
    seen = np.zeros(BUCKETS, dtype=np.int64)
    names = shards.columns
    for r in shards.select(*names[-2:]).collect():  # at most BUCKETS pairs of numbers a shard
        np.add.at(seen, np.frombuffer(r[0], "<i4"), np.frombuffer(r[1], "<i4"))
    used = np.flatnonzero(seen >= least_docs).astype(np.int32)
    shards = shards.select(*names[:-2])

    def evaluate(w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        got = shards.mapInArrow(_slopes(used, w, bias), "loss double, g binary, g_bias double").collect()  # a row a shard
        g = np.sum([np.frombuffer(r["g"]) for r in got], axis=0)
        return sum(r["loss"] for r in got), g, sum(r["g_bias"] for r in got)

    return climb(evaluate, used)
