import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import quality as Q

DATA = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels.where("doc_id % 3 > 0"))
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    judged = labels.where("doc_id % 3 = 0").join(kept.select("doc_id", F.lit(1).alias("kept")).distinct(), "doc_id", "left").collect()
    good, bad = [r.kept or 0 for r in judged if r.quality == 1], [r.kept or 0 for r in judged if r.quality == 0]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.02


def test_top_k_equals_a_sort(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x)) for i, x in enumerate(np.concatenate([rng.normal(size=3000), np.full(2500, 1.5)]))]
    df = spark.createDataFrame(rows, "doc_id long, key double").repartition(4)
    order = [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for k in (0, 1, 100, 1000, 3000, 5499, 5500, 9000):
        assert sorted(r.doc_id for r in Q.gumbel_top_k(df, k).collect()) == sorted(order[:k])


def test_weights_and_rows_equal_brute_force(spark):
    tables = {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")}
    docs = {r.doc_id: r.text for r in tables["documents"].collect()}
    good = {r.doc_id: r.quality for r in tables["labels"].collect()}
    slot = lambda h: h >> 48

    def mixed(x):
        x &= 2**64 - 1
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
        x = (x ^ x >> 29) * 0x9FB21C651E98DF25 % 2**64
        return x ^ x >> 32

    def grams(text):
        h = [xxhash.xxh64_intdigest(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
        return [slot(x) for x in h] + [0 if x == y else slot(mixed(x * 3 + y)) for x, y in zip(h, h[1:])]

    every = {i: grams(t) for i, t in docs.items()}
    raw = Counter(g for gs in every.values() for g in gs)
    target = Counter(g for i, gs in every.items() if good.get(i) == 1 for g in gs)
    of_target, of_raw = target.total() + 2**16, raw.total() + 2**16
    ratio = lambda g: math.log((target[g] + 1) / of_target) - math.log((raw[g] + 1) / of_raw)
    weight = {i: sum(map(ratio, gs)) * min(1, Q.TEMPER / len(gs)) if gs else 0 for i, gs in every.items()}
    noise = lambda i: -math.log(-math.log((xxhash.xxh64_intdigest(str(i).encode(), seed=11) + 0.5) / 2**64))
    model = Q.train(tables["documents"], tables["labels"])
    got = {r.doc_id: r for r in Q.weigh(tables["documents"], model).collect()}
    assert all(abs(got[i].log_weight - w) < 1e-6 and (not every[i] or abs(got[i].key - w - noise(i)) < 1e-6) for i, w in weight.items())
    assert min(w for i, w in weight.items() if good.get(i) == 1) > model.cut - 3

    order = sorted(docs, key=lambda i: (-(weight[i] + noise(i)) if every[i] else -math.inf, i))
    k = sum(w >= model.cut or not every[i] for i, w in weight.items())
    kept = {r.doc_id for r in Q.keep_good(tables["documents"], model).collect()}
    assert kept == set(order[:k]) and 0 < k < len(docs)
    # The noise decides: a smaller sample is another set than that of the largest weights.
    few = {r.doc_id for r in Q.keep_good(tables["documents"], model, k=300).collect()}
    assert few == set(order[:300]) != set(sorted(docs, key=lambda i: -weight[i])[:300])


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 1.0), (2, "bad ### ###", 1.0), (3, None, 1.0), (4, "", 1.0), (1, "good words here", 1.0)],
        "doc_id long, text string, key double",
    )
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    assert sorted(r.doc_id for r in Q.keep_good(docs, model).collect() if r.doc_id < 3) == [1, 1]
    weights = {r.doc_id: r.log_weight for r in Q.weigh(docs, model).collect()}
    assert weights[3] == weights[4] == 0 and weights[1] > weights[2]
    assert {3, 4} <= {r.doc_id for r in Q.keep_good(docs, model, k=2).collect()}
    long = spark.createDataFrame([(1, "good words here " * 200_000, 1.0), (None, "good", 1.0), (None, "x", 1.0)], docs.schema)
    assert Q.keep_good(long, model, k=3).count() == 3 and Q.weigh(long, model).where("log_weight > 0 AND doc_id = 1").count() == 1
    none = Q.train(docs, labels.limit(0))
    assert Q.keep_good(docs, none).count() == 5 and Q.train(docs.limit(0), labels).cut == -np.inf
    assert Q.keep_good(docs.limit(0), model).count() == 0
