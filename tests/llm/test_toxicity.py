import math
import random
import re
import zlib

import numpy as np

from corpusloom.llm import q_toxicity
from corpusloom.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = q_toxicity.op10_toxicity_mil(spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    auc = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean) / len(toxic) / len(clean)
    assert auc > 0.97 and sum(r.predicted for r in clean) <= 0.01 * len(clean) and sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    sample = got.limit(300).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in sample)


def made(spark, n=400):
    rng = random.Random(2)
    words = [f"plain{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            k = rng.randrange(6)
            sentences[k] = sentences[k].replace(" ", " vilest" + rng.choice("abcdef") + " ", 1)
        rows.append((i, ". ".join(sentences), "x"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_locates_the_sentence_and_generalises_by_stem(spark):
    docs, labels = made(spark)
    model = T.train(docs, labels)
    odd = [(1, "plain1 plain2. You vilestzz plain3. plain4", ""), (2, "plain1 plain2. plain5", ""), (3, None, ""), (4, "", ""), (5, "...", "")]
    odd += [(1, "plain1 plain2. You vilestzz plain3. plain4", "")]
    df = spark.createDataFrame(odd, "doc_id long, text string, score string")
    got = sorted((r.doc_id, r.score, [(s.start, s.end) for s in r.sentences]) for r in T.score(df, model).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4, 5] and got[0] == got[1]
    assert got[0][1] > 0.5 and got[0][2] == [(14, 34)] and got[2][1] < 0.2
    assert [g[1:] for g in got[3:]] == [(0.0, [])] * 3
    assert T.score(df.limit(0), model).count() == 0


def test_without_both_classes(spark):
    docs, labels = made(spark, 20)
    assert T.train(docs, labels.where("toxic = 0")) is None and T.train(docs, labels.limit(0)) is None
    assert {r.score for r in T.score(docs, None).collect()} == {0.0}


def plain(text, weights, bias):
    """The noisy-or score, a sentence and a word at a time."""
    miss = 1.0
    for s in re.split(r"[.!?\n]+", text or ""):
        words = set(re.findall(r"\w[\w']*", s.lower()))
        if words:
            miss *= 1 - 1 / (1 + math.exp(-(bias + sum(weights[b] for w in words for b in T.buckets_of(w)))))
    return 1 - miss


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    model = T.Model(rng.normal(0, 0.2, T.BUCKETS).astype(np.float32), -4.0)
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r.score for r in T.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), model).collect()}
    assert all(abs(got[r.doc_id] - plain(r.text, model.weights, model.bias)) < 1e-5 for r in rows) and len(got) == len(rows)


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    texts = ["one two. three four five! six", "two two three", "", "four.five.six seven", "..."]
    y, scale = [1, 0, 0, 1, 0], [0.3, 0.1, 0.2, 0.3, 0.1]
    shard = T.Shard.unpack(T.shard_of(texts, y, scale).pack())
    weights = rng.normal(0, 0.3, T.BUCKETS)
    loss, g, g_bias = T.loss_and_slope(shard, weights, -1.0)
    p = [plain(t, weights, -1.0) for t in texts]
    assert abs(loss + sum(s * math.log(x if k else 1 - x) for x, k, s in zip(p, y, scale))) < 1e-9
    for b in sorted({b for w in "one two three five seven".split() for b in T.buckets_of(w)}):
        more, less = weights.copy(), weights.copy()
        more[b] += 1e-5
        less[b] -= 1e-5
        assert abs((T.loss_and_slope(shard, more, -1.0)[0] - T.loss_and_slope(shard, less, -1.0)[0]) / 2e-5 - g[b]) < 1e-6
    assert abs((T.loss_and_slope(shard, weights, -1 + 1e-5)[0] - T.loss_and_slope(shard, weights, -1 - 1e-5)[0]) / 2e-5 - g_bias) < 1e-6


def test_fitting_on_executors_equals_fitting_at_hand(spark):
    docs, labels = made(spark)
    near, far = T.train(docs, labels), None
    rows = docs.join(labels, "doc_id").orderBy("doc_id").collect()
    y = np.array([r.toxic for r in rows])
    far = T.fit([r.text for r in rows], y, np.ones(len(y)))
    assert abs(near.bias - far.bias) < 0.05 and np.abs(near.weights - far.weights).max() < 0.05


def test_a_very_long_text(spark):
    docs, labels = made(spark)
    long = spark.createDataFrame([(9999, "plain1 plain2. " * 200_000 + "you vilesta", "")], docs.schema)
    model = T.train(docs.union(long), labels.union(spark.createDataFrame([(9999, 1)], labels.schema)))
    (row,) = T.score(long, model).collect()
    assert row.sentences[-1].end == 15 * 200_000 + 11
