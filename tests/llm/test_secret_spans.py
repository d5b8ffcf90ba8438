"""Many spans in one text, and seen blobs whose texts do not move."""

import re
import time

import pytest

from corpusloom.llm import secret_scan as S

DOCS = "doc_id bigint, text string, blob string"


def plain(text):
    spans = []
    for rank, r in enumerate(S.RULES):
        for m in re.finditer(r.pattern, text):
            if len(m.group(r.group)) >= r.min_chars:
                spans.append((m.start(), rank, m.end(), r.kind))
    return sorted(spans)


def spans_of(df):
    return {r.doc_id: [tuple(s) for s in r.spans] for r in df.select("doc_id", "spans").collect()}


def test_many_spans_in_one_text(spark):
    few = "é " + "token=abcdefgh1234 " * 3
    texts = {1: few, 2: "key é api_key: 'short' password = longenough99 😀 " * 20_000, 3: "0123456789abcdef" * 2 + " ", 4: ("a" * 32 + "-") * 1000 + "AKIA" + "Z" * 12}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], DOCS)
    assert spans_of(S.scan_versions(df)) == {k: plain(t) for k, t in texts.items()}


def test_time_follows_the_spans(spark):
    def took(n):
        df = spark.createDataFrame([(1, "token=abcdefgh1234 " * n, "x")], DOCS)
        began = time.time()
        ledger, findings = S.scan_increment(df)
        assert len(spans_of(S.scan_versions(df, ledger=ledger, findings=findings))[1]) == n
        return time.time() - began

    took(1000)
    assert took(200_000) < 40 + 20 * took(20_000)


@pytest.mark.parametrize("most", [500_000, 20, 3])
def test_seen_blobs(spark, monkeypatch, most):
    """With done blobs that are sent, blobs left that are sent, and neither."""
    monkeypatch.setattr(S, "BROADCAST_BLOBS", most)
    rows = [(k, f"token=abcdefgh{k % 50:04d}", "x") for k in range(100)] + [(200, None, "x"), (201, "", "x")]
    df = spark.createDataFrame(rows, DOCS)
    ledger, findings = S.scan_increment(df.where("doc_id < 40 OR doc_id = 200"))
    want = {k: plain(t or "") for k, t, _ in rows}
    assert spans_of(S.scan_versions(df, ledger=ledger, findings=findings)) == want
    # A ledger that has not all rules of a blob, and findings that are told twice.
    part = ledger.where("kind <> 'assign'")
    assert spans_of(S.scan_versions(df, ledger=part, findings=findings.union(findings))) == want
