import itertools
import random
import re

import numpy as np
import pytest

from corpusloom.llm import jaccard_join as J


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def brute(rows, size=3, num=9, den=10):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and den * len(a & b) >= num * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("num,den", [(9, 10), (8, 10)])
def test_linked_sets_share_a_key(num, den):
    rng = np.random.default_rng(3)
    schemes = J.Schemes(num, den)
    tried = 0
    for _ in range(6000):
        n = int(rng.integers(1, 400)) if rng.random() < 0.5 else int(rng.integers(1, 40))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for most in (rng.integers(0, n // 8 + 2), n // 19, n // 10):
            drop = int(min(most, n - 1))
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1))).astype(np.uint64)])
            x, y = np.unique(a), np.unique(b)
            common = len(np.intersect1d(x, y))
            if common * (num + den) >= num * (len(x) + len(y)) and len(np.union1d(x, y)) > common:
                tried += 1
                assert len(np.intersect1d(J.keys_of(x, schemes), J.keys_of(y, schemes))), (len(x), len(y), common)
    assert tried > 1500


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(n // 12):
        base = [rng.choice(words) for _ in range(rng.choice((2, 5, 12, 20, 40, 90, 250)))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " \t\n"), (n + 4, "É one"), (n + 5, "é one"), (n + 6, "a b"), (n + 7, "A\x0bB")]
    return rows


@pytest.mark.parametrize("blocks,hot", [(J.BLOCK_ELEMENTS, J.HOT), (300, 2), (J.BLOCK_ELEMENTS, 3)])
def test_equals_brute_force(spark, blocks, hot):
    rows = corpus(blocks + hot)
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_shingles int").repartition(7)
    got = J.near_duplicates(df, block_elements=blocks, hottest=hot).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in J.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_rows_without_an_id(spark):
    long, other = (" ".join(f"{of}{k}" for k in range(60)) for of in "vw")
    rows = [(None, long), (None, long), (None, other), (None, None), (4, long), (5, long + " x"), (6, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, at int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 58, None)] * 3 + [(None, 0, None), (4, 58, 4), (5, 59, 4), (6, 0, 6)], key=repr)
    assert sorted(r["at"] for r in J.keep_first(df).collect()) == [4, 6]


def test_very_long_texts_and_a_large_group(spark):
    long = [f"v{k}" for k in range(300_000)]
    other = long[:290_000] + ["x"] + long[290_001:]
    rng = random.Random(3)
    base, passage = [f"b{k}" for k in range(80)], [f"p{k}" for k in range(40)]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:100_000]))]
    for k in range(400):  # one group of near copies, and texts that share a passage only
        copy = list(base)
        copy[rng.randrange(80)] = f"e{k}"
        rows.append((100 + k, " ".join(copy)))
        rows.append((1000 + k, " ".join([*passage, *(f"o{k}x{j}" for j in range(20))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in J.near_duplicates(df, block_elements=5_000).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3 and {got[k] for k in range(100, 500)} == {100}
    assert all(got[k] == k for k in range(1000, 1400))
