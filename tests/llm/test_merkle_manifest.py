"""Manifests against trees that are built level by level from whole lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle_manifest as M
from corpusloom.llm import q_merkle  # noqa: F401

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, node string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    i, _, lang, source, n = row[:5]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes):
    """(root, for each leaf its runs and places)"""
    at, ways = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, way in enumerate(ways):
            run = nodes[at[k] // 3 * 3 : at[k] // 3 * 3 + 3]
            way.append((run, at[k] % 3))
            at[k] //= 3
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], ways


def brute(rows):
    low = lambda v: (v is not None, v)
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in sources:
        trees[s].sort(key=lambda r: (low(r[0]) if r[0] is not None else (False, 0), leaf_of(r, r[1])))
        done[s] = climb([leaf_of(r, r[1]) for r in trees[s]])
    root, over = climb([done[s][0] for s in sources])
    out = []
    for s, more in zip(sources, over):
        for r, way in zip(trees[s], done[s][1]):
            way = way + more
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            x = leaf_of(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for run, place in way:
                x = h(*run[:place], x, *run[place + 1 :])
            proof = h(*(d for run, place in way for k, d in enumerate(run) if k != place))
            out.append((str(r[0]), leaf_of(r, r[1]), done[s][0], root, proof, x, x == root))
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = M.verified(M.manifest(docs, tampered=even, **options)).collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got)


def rows_of(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            k = len(rows)
            text = rng.choice([f"a\nb {k}", f"plain {k}", "", None, "\n", "é\n" * rng.randint(1, 9)])
            rows.append((k * 3 % 1000 + k // 1000, text, rng.choice(["en", None, ""]), source, rng.choice([None, k]), "t", "n"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk,width", [(7, 2), (5, 3), (20_000, 256)])
def test_against_whole_lists(spark, chunk, width):
    rows = rows_of({None: 4, "": 1, "b": 100, "a": 28, "é": 3, "Z": 2, "-": 9, "=": 10, "big": 163})
    assert run(spark, rows, chunk=chunk, width=width) == brute(rows)


def test_odd_rows(spark):
    assert run(spark, []) == []
    one = [(2, "x\ny", "en", "s", 3, "t", "n")]
    got = run(spark, one)
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == h()
    same = [(5, "x\ny", "en", "s", 3, "t", "n")] * 50 + [(None, "q\n", None, None, None, "t", "n")] * 20 + [(5, "other", "en", "s", 3, "t", "n"), (6, None, "en", "s", 3, "t", "n")]
    assert run(spark, same, chunk=4, width=2) == brute(same)
    long = [(k, "long \n text " * 200_000, "en", "s", 3, "t", "n") for k in range(3)]
    assert run(spark, long) == brute(long)


def test_many_sources(spark):
    rows = rows_of({f"s{k}": 1 + k % 4 for k in range(70)})
    assert run(spark, rows, chunk=4, width=2) == brute(rows)


def test_stack():
    for size in range(1, 90):
        leaves = [M.Node(0, k, bytes([k]) * 32) for k in range(size)]
        (top,) = M.peaks(iter(leaves), size)
        for edge in (1, 4, size // 2, size - 1):
            parts = M.peaks(iter(leaves[:edge]), size) + M.peaks(iter(leaves[edge:]), size)
            merged = M.peaks(iter(M.Node(n.level, n.at, n.digest) for n in parts), size)
            assert [(n.level, n.at, n.digest) for n in merged] == [(top.level, top.at, top.digest)]
