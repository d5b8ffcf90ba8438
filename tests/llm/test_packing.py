import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from corpusloom.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_equal_whole_text_ids():
    rng = random.Random(1)
    words = K.WordIds(PATH)
    parts = ["a", "The", "don't", "'s", "é", "é", "́", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "1", "½",
             "%%", "<|endoftext|>", "<|startoftext|>", "Σ", "ΑΣ", "İ", "漢", "字", "😀", "​", "‍", "</w>", "_", "﻿", "\x00", "ﬁ"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert words.ids(text) == words.direct(text), repr(text)


def test_remembered_words_are_bounded_and_recurring_ones_stay(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED_WORDS", 50)
    monkeypatch.setattr(K, "WORDS_AT_ONCE", 7)
    words = K.WordIds(PATH)
    for k in range(40):
        texts = [None, "", " ".join(["the", "again", *(f"word{k}x{j}" for j in range(20))])]
        words.learn(texts)
        assert words.ids(texts[2]) == words.direct(texts[2])
        assert len(words) < 50 + 22 and len(words.before) < 50 + 22
    assert "again" in words


def one_by_one(hist, capacity):
    bins = []
    for size in sorted((k for k, n in hist.items() for _ in range(n)), reverse=True):
        k = min((k for k, left in enumerate(bins) if left >= size), key=lambda k: bins[k], default=None)
        if k is None:
            bins.append(capacity - size)
        else:
            bins[k] -= size
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_keeps_every_capacity(seed):
    rng = random.Random(seed)
    hist = {rng.randint(1, 100): rng.randint(1, 60) for _ in range(40)}
    for docs, attention in ((100, 10_000), (3, 10_000), (100, 4_000)):
        hist2 = {k: v for k, v in hist.items() if k * k <= attention}
        groups = K.best_fit(hist2, 100, docs, attention)
        placed = {}
        for g in groups:
            assert sum(s * n for s, n in g.runs) <= 100 and sum(n for _, n in g.runs) <= docs
            assert sum(s * s * n for s, n in g.runs) <= attention
            for s, n in g.runs:
                placed[s] = placed.get(s, 0) + n * g.count
        assert placed == hist2
        if docs == 100 and attention == 10_000:
            assert sum(g.count for g in groups) <= one_by_one(hist2, 100) * 1.01 + 1


def test_pieces_and_places(spark):
    long = " ".join(f"w{k}" for k in range(9000))
    rows = [(1, None, 0), (2, "", 0), (3, "hello world", 0), (3, "hello world", 0), (4, long, 1), (5, "x" * 200_000, 1)]
    rows += [(k, "some words here " * (k % 37), 0) for k in range(10, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int").repartition(5)
    got = K.pack_documents(df, PATH).toPandas()
    words = K.WordIds(PATH)
    want = sorted(
        (i, k, at, len(p) // 4, zlib.crc32(p))
        for i, t, _ in rows
        for ids in [words.direct(t or "") + np.array([1], "<u4").tobytes()]
        for k, at in enumerate(range(0, len(ids) // 4, 4096))
        for p in [ids[4 * at : 4 * at + 4 * 4096]]
    )
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 2
    assert K.pack_documents(df.limit(0), PATH).count() == 0


def test_tightest_limits_cost_no_sequence():
    rng = random.Random(9)
    hist = {4096: 40, **{rng.randint(1, 4000): rng.randint(1, 40) for _ in range(700)}, 1: 3000, 5: 900}
    alone = K.best_fit(hist, 4096, 4096, 4096**2)
    groups, docs, attention = K.tightest(hist, 4096)
    count = lambda gs: sum(g.count for g in gs)
    most = lambda gs: max(sum(n for _, n in g.runs) for g in gs)
    assert count(groups) <= count(alone) and most(groups) <= docs < 4096 and attention == 4096**2
    short = {k: n for k, n in hist.items() if k < 1000}
    groups, docs, attention = K.tightest(short, 4096)
    assert attention < 4096**2 and count(groups) <= count(K.best_fit(short, 4096, 4096, 4096**2))
    assert all(sum(s * s * n for s, n in g.runs) <= attention for g in groups)


def test_limits_bind_beside_full_pieces():
    rng = random.Random(4)
    hist = {4096: 25, **{rng.randint(1, 4000): rng.randint(1, 9) for _ in range(300)}, 2: 500, 3: 700}
    alone, (groups, docs, _) = K.best_fit(hist, 4096, 4096, 4096**2), K.tightest(hist, 4096)
    rest = lambda gs: [g for g in gs if g.runs != ((4096, 1),)]
    assert sum(g.count for g in groups) <= sum(g.count for g in alone) and sum(g.count for g in groups if g.runs == ((4096, 1),)) == 25
    assert K.used(groups, 0) == docs < K.used(rest(alone), 0) and K.used(rest(groups), 1) < 4096**2 * 0.99
    total = {}
    for g in groups:
        for s, n in g.runs:
            total[s] = total.get(s, 0) + n * g.count
    assert total == hist
    assert K.tightest({}, 4096)[0] == K.best_fit({}, 4096, 0, 0) == [] and K.tightest({4096: 3}, 4096) == ([K.Group(((4096, 1),), 3)], 1, 4096**2)


def test_the_vector_decides():
    hist = {27: 4, 22: 5, 43: 1, 29: 5, 56: 2, 38: 5, 18: 4, 8: 4, 60: 3, 41: 5, 17: 5}
    by = lambda weights: sorted((g.runs, g.count) for g in K.best_fit(hist, 100, 4, 4200, weights))
    scalar, vector = by((1.0, 0.0, 0.0)), by((0.1, 1.0, 1.0))
    assert scalar != vector
    for runs, _ in scalar + vector:
        assert sum(n for _, n in runs) <= 4 and sum(s * s * n for s, n in runs) <= 4200 and sum(s * n for s, n in runs) <= 100
