import random
import re
from collections import Counter

from corpusloom.llm import decontaminate as D


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def bag(ws):
    return Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))


def brute(docs, items):
    out = {}
    for i, text in docs:
        ws = words(text)
        for j, item in items:
            it = words(item)
            if len(it) < 5 or len(ws) < 5:
                continue
            b = bag(it)
            if not b & bag(ws):
                continue
            for s in range(max(1, len(ws) - len(it) + 1)):
                a = bag(ws[s : s + len(it)])
                common = sum((a & b).values())
                sim = common / (a.total() + b.total() - common)
                if sim >= 0.8 and sim > out.get((i, j), (0, 0))[0] + 1e-12:
                    out[i, j] = (sim, s)
    return sorted((i, j, round(x, 9), s) for (i, j), (x, s) in out.items())


def test_equals_a_scan_of_every_window(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(j, text(rng.choice((5, 8, 15, 30, 60, 120)))) for j in range(24)]
    items += [(90, ["a", "b"] * 15), (91, text(4))]
    docs = []
    for i in range(120):
        _, item = rng.choice(items)
        copy = list(item)
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            k = rng.randrange(len(copy))
            copy[k : k + rng.randint(0, 1)] = text(rng.randint(0, 2))
        docs.append((i, text(rng.randint(0, 40)) + copy + text(rng.randint(0, 40))))
    docs = [(i, "\n".join(w) if i % 3 else ". ".join(w).upper()) for i, w in docs]
    docs += [(500, None), (501, ""), (502, "w1"), (503, "a b " * 40), (503, "a b " * 40)]
    items = [(j, " ".join(w)) for j, w in items] + [(92, None), (93, "")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for options in ({}, {"broadcast_rows": 0}):
        got = sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.start) for r in D.contaminated(d, b, **options).collect())
        assert got == want and len(want) > 60
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {w[0] for w in want}
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0


def rows_of(spark, docs, items, **options):
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(j, " ".join(w)) for j, w in items], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.start) for r in D.contaminated(d, b, **options).collect())
    return got, brute([(i, " ".join(w)) for i, w in docs], [(j, " ".join(w)) for j, w in items])


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(2)
    items = [(j, [f"w{j}x{rng.randrange(5000)}" for _ in range(n)]) for j, n in enumerate((24, 54, 104, 204))]
    docs = []
    for _, item in items:
        n = len(item) - 4
        for least in range(n * 7 // 10, n + 1, max(1, n // 20)):
            docs += [(len(docs), item[: least + 4]), (len(docs) + 1, item[n - least :])]
    docs.append((900, items[2][1][:90]))
    got, want = rows_of(spark, docs, items)
    assert got == want and (900, 2, 0.86, 0) in got and len(want) > 40
    assert any(len(docs[i][1]) < len(items[j][1]) and x < 8 / 9 for i, j, x, _ in want if i < 900)


def test_items_with_moved_parts(spark):
    rng = random.Random(5)
    text = lambda n, of: [f"{of}{rng.randrange(5000)}" for _ in range(n)]
    items = [(j, text(n, f"w{j}x")) for j, n in enumerate((54, 104, 204))] + [(7, ["a", "b", "c"] * 20)]
    docs = []
    for _, item in items:
        for parts in (2, 2, 3, 3):
            at = [0, *sorted(rng.sample(range(1, len(item)), parts - 1)), len(item)]
            moved = [item[a:b] for a, b in zip(at, at[1:])]
            rng.shuffle(moved)
            docs.append((len(docs), text(rng.randint(0, 300), "z") + sum(moved, []) + text(rng.randint(0, 300), "z")))
    docs += [(800, text(90, "z") + items[1][1][52:] + items[1][1][:52] + text(90, "z")), (801, text(150, "z") + ["a", "b", "c"] * 60)]
    docs += [(802, (items[0][1][27:] + items[0][1][:27]) * 3), (803, items[1][1][52:] + items[1][1][:52])]
    got, want = rows_of(spark, docs, items)
    assert got == want and (800, 1, round(96 / 104, 9), 90) in got and len(want) > 14


def test_simhash_of_bags_of_any_size(spark):
    rng = random.Random(4)
    bags = [[rng.randrange(-(2**63), 2**63) | rng.getrandbits(64) >> 1 for _ in range(n)] for n in (1, 9, 1000, 32767, 32768, 70000)]
    bags += [[h | 0x00FF00FF for h in bags[-1]] + [-1] * 65536]
    votes = lambda bag: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in bag) > len(bag))
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bags)], "k int, bag array<bigint>")
    got = [r.f % 2**64 for r in df.select("k", D.simhash("bag").alias("f")).orderBy("k").collect()]
    assert got == [votes(b) for b in bags]


def test_a_very_long_text(spark):
    rng = random.Random(7)
    item = [f"w{rng.randrange(400)}" for _ in range(60)]
    long = [f"v{k % 9973}" for k in range(400_000)] + item + [f"u{k}" for k in range(1000)]
    d = spark.createDataFrame([(1, " ".join(long)), (2, "v1 v2 v3 v4 v5 v6")], "doc_id long, text string")
    b = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.similarity, r.start) for r in D.contaminated(d, b).collect()] == [(1, 0, 1.0, 400_000)]
