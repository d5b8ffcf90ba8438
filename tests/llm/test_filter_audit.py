"""The audit against one that applies every order to every row."""

from itertools import permutations

import pytest

from corpusloom.llm import filter_audit

DOCS, LABELS = "doc_id bigint, text string, lang string, n int, part string", "doc_id bigint, quality int, toxic int"


def brute(rows, labels):
    """{(part, order, step): counts}"""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = {}
    for i, text, *_ in rows:
        if i is not None:
            ids[text or ""] = min(i, ids.get(text or "", i))
    tested = []
    for i, text, lang, *_ in rows:
        t = text or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > ids[t],
        }
        tested.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {t[0] for t in tested}:
        mine = [t for t in tested if t[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [t for t in left if f in t[1]], [t for t in left if f not in t[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in t[1] for t in mine) - len(gone), sum(t[1] == {f} for t in mine),
                    sum(t[2] for t in gone), sum(t[3] for t in gone),
                ]
        for (p, order, step), found in out.items():
            if p == part:
                found.append(total[order[step - 1]])
    return out


def check(spark, rows, labels):
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()}
    assert found == brute(rows, labels)
    return found


def prose(k, n=120):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_against_every_order(spark):
    texts = [prose(1), prose(2) + " #", prose(3).upper(), "few words", prose(4), "a b " * 80, "", None, " \t\n", "ÄÖ É" * 40, prose(1), "A" * 9 + " $", prose(6, 30) * 4]
    rows = [(i, texts[i * 7 % len(texts)], ("en", "de", None, "")[i % 4], 1, "x") for i in range(60)]
    rows += [(None, prose(1), "en", 1, "x"), (None, prose(1), "en", 1, "x"), (3, texts[8], "fr", 1, "x"), (3, texts[8], "de", 1, "x"), (3, texts[8], "de", 1, "x")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(4, None, None), (4, 1, 0), (None, 1, 1), (1, None, 1)]
    found = check(spark, rows, [(i, q, None if t is None else int(t)) for i, q, t in labels])
    assert {k[0] for k in found} == {"", "de", "en", "fr"} and len(found) == 4 * 600


def test_long_texts_copies_and_empty_tables(spark):
    long = " ".join(f"Wort{k % 50_000}" for k in range(200_000))
    rows = [(9, long, "de", 1, "x"), (4, long, "en", 1, "x"), (7, long + " ", "de", 1, "x")] + [(100 + i, "same", "de", 1, "x") for i in range(500)]
    found = check(spark, rows, [])
    assert found["de", "EABCD", 1][:2] == [2, 500] and found["en", "EABCD", 1][:2] == [1, 0]
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("n", [3, 17])
def test_partitions_change_nothing(spark, n):
    rows = [(i % 40, prose(i % 5), "de", 1, "x") for i in range(100)]  # five texts, of least ids 0 to 4, each in 20 rows
    docs = spark.createDataFrame(rows, DOCS).repartition(n)
    got = filter_audit.audit(docs, spark.createDataFrame([(1, 1, 1)], LABELS)).where("filter_order = 'EABCD' AND step = 1").select("kept", "removed").first()
    least = {t: min(i for i, u, *_ in rows if u == t) for _, t, *_ in rows}
    copies = sum(i > least[t] for i, t, *_ in rows)
    assert tuple(got) == (100 - copies, copies)
