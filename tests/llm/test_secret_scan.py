import random
import re

from corpusloom.llm import secret_scan as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = [r.kind for r in S.RULES]


def brute(text):
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def test_base_spans_equal_a_plain_scan(spark):
    rng = random.Random(3)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abcdefgh", "x", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "é", "😀", "\n", "a/b+c"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(4000)]
    rows += [(5000, None), (5001, ""), (5002, "token=abcdefgh " * 300), (5003, rows[0][1]), (5003, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, blob string, spans int").repartition(6)
    got = sorted((r.doc_id, [(s.start, s.kind, s.end) for s in r.spans if s.kind in ("assign", "access", "hex")]) for r in S.scan_versions(df).collect())
    assert got == sorted((i, brute(t or "")) for i, t in rows)
    assert S.scan_versions(df.limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark):
    df = spark.createDataFrame([("a/1", "token=abcdefgh"), ("b/1", "token=abcdefgh"), ("c/1", "f" * 32)], "path string, text string")
    versions = df.selectExpr("path", "sha2(text, 256) AS blob", "text")
    blobs = S.unseen_blobs(versions, None)
    assert blobs.count() == 2
    ledger = S.ledger_rows(S.scan_blobs(blobs))
    assert ledger.count() == 2 * len(S.RULES) and S.unseen_blobs(versions, ledger).count() == 0
    newer = tuple(S.Rule(r.kind, r.version + (r.kind == "hex"), r.pattern, r.group, r.min_chars, r.hint) for r in S.RULES)
    todo = S.unseen_blobs(versions, ledger, newer).collect()
    assert {tuple(r.todo) for r in todo} == {("hex@2",)} and len(todo) == 2
    found = {r.path: [s.kind for s in r.spans] for r in S.scan_versions(df, "path", ledger=ledger, rules=newer).collect()}
    assert found == {"a/1": [], "b/1": [], "c/1": ["hex"]}
    more = S.scan_versions(spark.createDataFrame([("d", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "Zq" * 20)], "path string, text string"), "path").first()
    assert [s.kind for s in more.spans] == ["pem", "github"]


def test_findings_reach_paths_of_later_increments(spark):
    key, access = "token=abcdefgh", "AKIA" + "ABCDEFGH1234"
    first = spark.createDataFrame([("a/1", key), ("b/1", access + " " + "f" * 32), ("c/1", "plain")], "path string, text string")
    scanned = S.scan_blobs(S.unseen_blobs(first.selectExpr("sha2(text, 256) AS blob", "text"), None))
    ledger, findings = S.ledger_rows(scanned), S.finding_rows(scanned)
    assert findings.schema.simpleString() == spark.createDataFrame([], S.FINDINGS_SCHEMA).schema.simpleString()
    second = first.unionByName(spark.createDataFrame([("a/2", key), ("b/2", access + " " + "f" * 32), ("d/2", key + "\n" + key)], "path string, text string"))
    newer = tuple(S.Rule(r.kind, r.version + (r.kind == "hex"), "[0-9a-f]{40,}" if r.kind == "hex" else r.pattern, r.group, r.min_chars, r.hint) for r in S.RULES)
    spans = lambda df: {r.path: [tuple(s) for s in r.spans] for r in df.collect()}
    for rules in (S.RULES, newer):
        got = spans(S.scan_versions(second, "path", ledger=ledger, rules=rules, findings=findings.union(findings)))
        assert got == spans(S.scan_versions(second, "path", rules=rules))
        assert got["a/2"] == got["a/1"] == [(0, 0, 14, "assign")] and len(got["b/2"]) == (2 if rules is S.RULES else 1)


def test_increments_add_up(spark):
    texts = ["token=abcdefgh", "f" * 32, "plain", None, "token=abcdefgh " * 3, "AKIA" + "ABCDEFGH1234"]
    df = spark.createDataFrame([(k, texts[k % 6]) for k in range(60)], "doc_id long, text string")
    ledger, findings = S.scan_increment(df.where("doc_id < 8"))
    more = S.scan_increment(df.where("doc_id < 8"), ledger=ledger)
    assert [x.count() for x in more] == [0, 0] and ledger.count() == 6 * len(S.RULES)
    spans = lambda of: {r.doc_id: [tuple(s) for s in r.spans] for r in of.collect()}
    assert spans(S.scan_versions(df, ledger=ledger, findings=findings)) == spans(S.scan_versions(df))
