import random

import numpy as np
import pytest

from corpusloom.operators import leakage, phrases


def brute(rows, sources, n):
    import re

    spelled = lambda t: {" ".join(w[k : k + n]) for w in [re.findall(r"[A-Za-z][A-Za-z'-]+", (t or "").lower())] for k in range(len(w) - n + 1)}
    known = set().union(*map(spelled, sources)) if sources else set()
    return sorted({str(i) for i, t in rows if spelled(t) & known})


def test_rolling_hashes():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 200).astype(np.uint64)
    h[50:70] = h[100:120]
    for n in (1, 2, 14, 20):
        r = phrases.rolling(h, n)
        assert len(r) == 201 - n and len(set(r.tolist())) == 201 - n - max(0, 21 - n)
        assert (r[50 : 71 - n] == r[100 : 121 - n]).all()
    assert len(phrases.rolling(h[:3], 4)) == 0


@pytest.mark.parametrize("n,most,broadcast", [(3, 2**27, 10**6), (14, 2**27, 0), (3, 2**12, 0), (1, 2**27, 10**6)])
def test_against_all_phrases(spark, monkeypatch, n, most, broadcast):
    """Also with a filter that is too small to hold anything back, and phrases that are not broadcast."""
    monkeypatch.setattr(phrases, "MOST_BITS", most)
    monkeypatch.setattr(phrases, "BROADCAST_PHRASES", broadcast)
    rng = random.Random(n)
    word = lambda: rng.choice(["Red", "don't", "x-ray", "sea", "ÄB", "a", "K9"]) + rng.choice(["", "s", "ly"])
    text = lambda k: " ".join(word() for _ in range(k))
    sources = [text(40) for _ in range(20)] + [None, "", "too short"]
    rows = [(k, text(rng.randint(0, 60))) for k in range(150)] + [(200 + k, text(5) + " " + s.upper() + "," + text(9)) for k, s in enumerate(sources[:8])]
    rows += [(300, None), (301, ""), (None, sources[0]), (302, sources[1]), (302, sources[1]), (303, text(30_000))]
    df = spark.createDataFrame(rows, "id int, said string").repartition(4)
    known = spark.createDataFrame([(s, 1) for s in sources], "text string, id int")
    assert sorted(str(r.id) for r in leakage.copies_source(df, known, "id", text="said", n=n).collect()) == brute(rows, sources, n)


def test_no_sources(spark):
    df = spark.createDataFrame([(1, "one two")], "id int, text string")
    for none in (spark.createDataFrame([], "text string"), spark.createDataFrame([(None,), ("ab",)], "text string")):
        assert leakage.copies_source(df, none, "id", n=2).count() == 0
    assert leakage.copies_source(df.limit(0), df, "id", n=2).count() == 0
