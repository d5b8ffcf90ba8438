import random
import re

from corpusloom.llm import pii as P

BASE = {
    0: (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda x: True),
    1: (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda x: all(int(p) <= 255 for p in x.split("."))),
    2: (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda x: 12 <= len(P.digits_of(x)) <= 19 and P.luhn(P.digits_of(x))),
    3: (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda x: 9 <= len(P.digits_of(x)) <= 15),
    4: (re.compile(rf"(?:{'|'.join(sorted(P.SCHEMES, key=len, reverse=True))}){P.USERINFO.pattern}"), lambda x: True),
    5: (P.ACCOUNT, lambda x: True),
    6: (P.SSN, lambda x: True),
}


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text) if ok(m[0]))


def test_matches_a_plain_scan_on_random_texts():
    rng = random.Random(5)
    find = P.finder()
    parts = ["@", ".", "+", "-", " ", "(", ")", "1", "2", "25", "255", "256", "0", "4111111111111111", "a", "b.c", "é", "😀",
             "://", "http", "https", ":", "/", "user", "account", "IBAN", " no", "#", "ssn", "123-45-6789", "ABCDEFGH", "\n"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        assert find(text) == brute(text), text


def test_edges(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "mail a@b.co", "x"), (3, "mail a@b.co", "x"), (4, "é" * 300_000 + " a@b.co", "x")],
        "doc_id long, text string, spans string",
    )
    got = sorted((r.doc_id, [(s.start, s.end, s.kind) for s in r.spans]) for r in P.find_pii(df).collect())
    one = [(5, 11, "email")]
    assert got == [(1, []), (2, []), (3, one), (3, one), (4, [(300_001, 300_007, "email")])]
    assert P.find_pii(df.limit(0)).count() == 0
    masked = {r.doc_id: r.text for r in P.mask_pii(df).collect()}
    assert masked[3] == "mail <EMAIL>" and masked[1] is None and masked[2] == ""
    assert P.mask_pii(df).columns == df.columns
