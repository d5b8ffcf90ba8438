"""Columns against the functions around Python's decoder, and plans without Python."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import contract
from corpusloom.plans import registry

GOOD = json.dumps({'rewrite': 'Say {x} "now" \\', 'reason': 'r'})
PIECES = [
    GOOD, '{"rewrite":"a","reason":"b","risk":null}', '{"rewrite":" ","reason":"b"}', '{"rewrite": 4, "reason": "b"}', '{"outer": {"rewrite": "in"}}',
    '{"rewrite":"x","more":[{"rewrite":"y"},{}]}', "{", "}", '"', "\\", "\\{", "</think>", "<think>", "prose ", "[", "]", ",", "\n", "null", "{}", '{"a":"}{"}', '{"rewrite":"\\u00e9\\ud83d\\ude00 é😀"}',
    '{"rewrite":"a\nb"}', "{'rewrite':'x'}", '{"rewrite":"x",}', '{"rewrite":"x"', ':"x"}', '{"inventory":["a"],"issues":[]}',
]
EDGES = [None, "", " ", "[]", "42", '"s"', "null", GOOD, GOOD + " x", " " + GOOD + "\n", GOOD * 3, '{"rewrite":"\u2003","reason":"r"}', '{"rewrite":"\u2003a\u00a0","reason":"\x0b"}', '\\{"rewrite":"x"}', '{"rewrite":"' + "long \\\\n " * 20_000 + '"}', "{" * 60 + GOOD]


def replies(seed, n=400):
    rng = random.Random(seed)
    return EDGES + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 7))) for _ in range(n)]


def issue(**over):
    return {"type": "t", "strings": ["a"], "problem": "p", "fix": "f"} | over


ISSUES = [None, "", "[]", "{}", *[
    json.dumps(o) for o in (
        {"inventory": ["a"], "issues": [issue()]}, {"inventory": [], "issues": []}, {"inventory": [1], "issues": []}, {"inventory": "a", "issues": []}, {"inventory": [None], "issues": []},
        {"inventory": ["a"]}, {"inventory": ["a"], "issues": {}}, {"inventory": ["a"], "issues": [1]}, {"inventory": ["a"], "issues": [issue(strings=[])]}, {"inventory": ["a"], "issues": [issue(strings=["a", 1])]},
        {"inventory": ["a"], "issues": [issue(), issue(fix=" ")]}, {"inventory": ["a"], "issues": [issue(type=3), issue(strings=None)]}, {"inventory": ["a"], "issues": [issue(strings="a"), issue(type="")]},
    )
]]


def both(spark, texts, column, plain):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(8)
    got = {r.k: r.x for r in df.select("k", column(F.col("t")).alias("x")).collect()}
    for k, t in enumerate(texts):
        x = got[k].asDict() if hasattr(got[k], "asDict") else got[k]
        assert x == plain(t), (t or "")[:300]


@pytest.mark.parametrize("column,plain", [
    (contract.rewrite_contract, contract.check_rewrite), (contract.last_rewrite, contract.last_object), (contract.widest_rewrite, contract.widest_object),
    (contract.valid_reply, contract.has_rewrite), (contract.object_text, contract.strict_object),
])
def test_columns(spark, column, plain):
    both(spark, replies(1), column, plain)


def test_issues_column(spark):
    both(spark, ISSUES + replies(2, 60), contract.issues_contract, contract.check_issues)


def test_what_columns_refuse(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one(contract.rewrite_contract, '{"rewrite":"a","rewrite":"b","reason":"r"}').error == "not json"
    assert one(contract.object_text, '{"a":NaN}') is None


@pytest.mark.parametrize("name", ["extract_contract", "reply_validity", "issue_filter"])
def test_no_python_in_the_plans(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("column", [
    contract.object_text, contract.rewrite_contract, contract.issues_contract, contract.valid_reply, contract.last_rewrite, contract.widest_rewrite, contract.filtered_output, contract.raw_types,
])
def test_a_reply_is_made_and_parsed_once(spark, column):
    made = column(F.reverse("t"))
    df = spark.createDataFrame([("a",)], "t string").select(made.alias("x")).select("x", F.col("x").alias("y"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1 and plan.count("from_json(") <= 1


def test_issue_filter_of_odd_texts_from_their_first_words_alone(spark, tmp_path):
    texts = [None, "", " ", "  ", "a", "a ", " a", "a a b", "a b a", 'q"u\\o q"u\\o x', "tab\tbed tab\tbed", "é😀 é😀", "a\na a\na", "x" * 5000, "{} {}", "a  a"]
    rows = [(k * len(texts) + j, t) for k in range(105) for j, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["issue_filter"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in out.collect()) == sorted(con.execute(registry.ORACLES["issue_filter"]).fetchall())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") <= 4  # read, cut and dropped: the words are taken from the start
