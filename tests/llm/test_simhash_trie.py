"""Fingerprints bit by bit, and classes from all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from corpusloom.llm import simhash_trie as S
from corpusloom.llm.q_simhash_trie import op12_simhash_trie

DOCS = "doc_id bigint, text string, print string, n int, least int"


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + size]).encode(), seed=42) for k in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=3):
    """The least index that links lead to, from all pairs."""
    p, root = np.array(prints, dtype=np.uint64), list(range(len(prints)))
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= radius
    for start in range(len(p)):
        if root[start] == start:
            todo = [start]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]).tolist():
                    if j > start and root[j] == j:
                        root[j] = start
                        todo.append(j)
    return root


def cloud(rng, n, centres, weak):
    """Fingerprints around centres, of which only some bits vary."""
    out = []
    for _ in range(n):
        x = rng.choice(centres)
        for b in weak:
            x ^= (rng.random() < 0.4) << b
        out.append(x)
    return out


def spread(rng, n):
    """Pairs at 2 to 5 bits from each other, anywhere."""
    out = []
    for _ in range(n):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(2, 5)):
            y ^= 1 << b
        out += [x, y]
    return out


def found(spark, prints, **options):
    from corpusloom.llm.graph import components

    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print bigint").distinct()
    root = {r.node: r.root for r in components(S.stars(df, **options)).collect()}
    groups = {}
    for i, p in enumerate(signed):
        groups.setdefault(root.get(p, p), []).append(i)
    out = [0] * len(signed)
    for members in groups.values():
        for i in members:
            out[i] = min(members)
    return out


@pytest.mark.parametrize("crowd", [S.CROWD, 40])
def test_links_against_all_pairs(spark, crowd):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = spread(rng, 400) + cloud(rng, 500, centres, rng.sample(range(64), 14)) + [0, 7, 15, 2**64 - 1, 2**64 - 8]
    prints += [centres[0] ^ (1 << b) for b in range(64)]
    assert found(spark, prints, crowd=crowd) == classes(prints)


def test_other_radius(spark):
    rng = random.Random(6)
    prints = spread(rng, 150) + cloud(rng, 150, [rng.getrandbits(64)], range(20, 44, 2))
    for radius in (0, 1, 2, 5):
        assert found(spark, prints, radius=radius, crowd=60) == classes(prints, radius)


def test_arrays_of_pairs_are_split(monkeypatch):
    rng = random.Random(7)
    keys = np.array(sorted(set(cloud(rng, 3000, [rng.getrandbits(48)], range(0, 48, 3)))), dtype=np.uint64)
    want = classes(keys)
    monkeypatch.setattr(S, "BLOCK", 64)
    ends = np.array([0]), np.array([len(keys)])
    assert S.Trie(keys, 48, 3).walk(*ends, *ends).tolist() == want


TEXTS = [None, "", " \t ", "one", "Two words", "a b c", "A B C", "ÄB é c d", "x " * 500, "tab\tand\nline\x0bfeed here"]


def test_fingerprints():
    rng = random.Random(3)
    for text in [*TEXTS, " ".join(rng.choice("abcdefgh") for _ in range(300)), "Ärger\u00a0mit \u2003 Raum " * 9]:
        assert S.fingerprint(text) & (2**64 - 1) == plain(text), text
    long = " ".join(f"w{k}" for k in range(150_000))
    assert S.fingerprint(long) & (2**64 - 1) == plain(long)


def test_documents(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["red", "blue", "sky", "sun", "sea", "tree", f"w{k}"]) for k in range(400)) for _ in range(12)]
    texts = [t for b in base for t in (b, b.upper(), b + " end", re.sub("sea", "lake", b, count=1))] + TEXTS
    rows = [(k * 5 % 131 + 1, t, "x", 1, 2) for k, t in enumerate(texts)]
    rows += [rows[3], (None, base[2], "x", 1, 2), (None, " ".join(map(str, range(90))), "x", 1, 2), (0, "", "x", 1, 2)]
    got = S.classes(spark.createDataFrame(rows, DOCS)).collect()
    prints = [plain(r[1]) for r in rows]
    root = classes(prints)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]] = min(r[0], least.get(root[k], r[0]))
    want = sorted((str(r[0]), f"{p:016x}", str(least.get(root[k]))) for k, (r, p) in enumerate(zip(rows, prints)))
    hexes = S.classes(spark.createDataFrame(rows, DOCS)).select(S.hexed("print").alias("h")).collect()
    assert sorted((str(r.doc_id), f"{r.print & (2**64 - 1):016x}", str(r.component_id)) for r in got) == want
    assert {r.h for r in hexes} == {w[1] for w in want}
    assert S.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    prints = [plain(r.text) for r in rows]
    root = classes(prints)
    least = {}
    for k, r in enumerate(rows):
        least[root[k]] = min(r.doc_id, least.get(root[k], r.doc_id))
    got = op12_simhash_trie(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, f"{p:016x}", least[root[k]]) for k, (r, p) in enumerate(zip(rows, prints)))
